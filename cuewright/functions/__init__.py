"""Column functions: text in, column out; all stay in the JVM unless they say otherwise."""
