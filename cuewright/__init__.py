"""Question answering over timestamped text as Spark jobs: cleaning, passages, retrieval, citations and evaluation."""
