"""Shared plumbing: reading, materialising in the shared folder, and Arrow maps that work in bounded slices."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to one Python step at a time; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests on one machine, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


def bucketed(df: DataFrame, column: str, *order: str, name: str = "table") -> DataFrame:
    """Write df to a table in the shared folder, in buckets of `column`, sorted by `order`; joins on it then need no shuffle of df.

    df must lie in partitions of `column` already, as after a group-by or a join on it, so that each bucket is one file.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"cuewright_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table_name}"
    out = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column)
    (out.sortBy(*order) if order else out).saveAsTable(table_name)
    kept = spark.table(table_name)
    kept._cuewright_table = table_name, path
    return kept


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    name, path = df._cuewright_table
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    delete_folder(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now; else they stay until the driver happens to run short of memory."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about SLICE_BYTES of text each, with their texts as bytes (null: empty)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate([*sizes, 0]):
        if i == len(sizes) or (held and held + size > SLICE_BYTES):
            if i > start:
                part = batch.slice(start, i - start)
                yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
            start, held = i, 0
        held += size


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_cuewright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cuewright_shipped = True


def prepare(df: DataFrame) -> None:
    """Bound the rows in an Arrow batch, unless the session has a bound of its own, and see that tasks can import what they run."""
    ship(df.sparkSession)
    rows, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(rows) == "10000":  # Spark's own
        conf.set(rows, str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in what runs inside; the session's own bound holds again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rank_among(edges: list, x: Column) -> Column:
    """How many of the sorted edges lie below x. About twice the square root of their number are looked at for each row."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges) - 1) + 1
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    count = lambda among: F.aggregate(among, F.lit(0), lambda n, e: n + (e < x).cast("int"))
    whole = count(F.array(*(F.lit(g[-1]) for g in groups)))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.least(whole + 1, F.lit(len(groups))))
    return F.when(x.isNotNull(), F.when(whole == len(groups), len(edges)).otherwise(whole * step + count(inside)))


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], setup: Callable[[], Callable[[list[bytes]], list[pa.Array]]]) -> DataFrame:
    """df with columns computed from the whole texts of text_col, slice by slice.

    setup() runs once in each task and gives the function from texts to arrays. A column of df with the
    name of a new one is replaced. All rows are kept, in place; nothing is shuffled.
    """
    prepare(df)
    names = [f.name for f in fields]
    kept = df.drop(*[c for c in df.columns if c in names and c != text_col])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = setup()
        for batch in batches:
            for part, texts in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(texts)], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def span_list(column: str | Column) -> Column:
    """kind:start:end of each span of an array, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
