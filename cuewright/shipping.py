"""Sends this package to the executors, so that tasks can import it wherever they run."""

from __future__ import annotations

import importlib
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def named(name: str) -> Callable:
    """The function `package.module:name`; its module's code goes to the executors with the tasks that use it."""
    module, _, attribute = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, attribute)


def ship(spark: SparkSession) -> None:
    """Once for each context: a zip of the package's sources goes out with the context's files."""
    context = spark.sparkContext
    if getattr(context, "_cuewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cuewright_shipped = True
