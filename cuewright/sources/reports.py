"""Evaluation results as CSV (a row for each case) and as Markdown (aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import failures, summary

# The columns of the file, in order.
SCORES = ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k", "citation_precision", "citation_hit_rate", "top_confidence")
JUDGED = ("faithfulness", "answer_relevance", "context_relevance", "correctness")
COLUMNS = ("retriever", "case_id", "answerable", "tags", *SCORES, "refused", *JUDGED, "latency_ms")
#: A file of fewer bytes holds no results.
LEAST_BYTES = 200


def csv_rows(results: DataFrame) -> DataFrame:
    """Results as text columns: four digits, tags joined by |, blank for null."""
    # format_number rounds the number itself, half to even; format_string would round its shortest decimal form.
    fixed = lambda c, digits: F.call_function("format_number", F.col(c).cast("double"), F.lit("0." + "0" * digits))
    number = lambda c, digits=4: F.coalesce(fixed(c, digits), F.lit("")).alias(c)
    flag = lambda c: F.col(c).cast("int").cast("string").alias(c)
    return results.select("retriever", "case_id", flag("answerable"), F.concat_ws("|", "tags").alias("tags"), *map(number, SCORES), flag("refused"), *map(number, JUDGED), number("latency_ms", 1))


def write_csv(results: DataFrame, path: str) -> None:
    csv_rows(results).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Results of several files; missing files and those under LEAST_BYTES are left out, blanks are null."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p) and fs.getContentSummary(p).getLength() >= LEAST_BYTES:
            found.append(path)
    numbers = ", ".join(f"{c} double" for c in SCORES)
    judged = ", ".join(f"{c} double" for c in JUDGED)
    schema = f"retriever string, case_id string, answerable int, tags string, {numbers}, refused int, {judged}, latency_ms double"
    raw = spark.read.schema(schema).option("header", True).csv(found) if found else spark.createDataFrame([], schema)
    return raw.withColumns({"answerable": F.col("answerable") == 1, "refused": F.col("refused") == 1, "tags": F.filter(F.split(F.coalesce("tags", F.lit("")), r"\|"), lambda t: t != "")})


def markdown(results: DataFrame, sweep: DataFrame | None = None) -> str:
    """A report of a summary by retriever, the threshold sweep and a digest of failures: aggregates of a few rows, put into text by the driver."""

    def table(df: DataFrame) -> str:
        cell = lambda v: "-" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
        lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in row] for row in df.collect())]
        return "\n".join("| " + " | ".join(line) + " |" for line in lines)

    parts = ["## Retrievers", table(summary(results).orderBy("retriever"))]
    if sweep is not None:
        parts += ["## Thresholds", table(sweep.orderBy("threshold"))]
    return "\n\n".join([*parts, "## Failures", table(failures(results).orderBy("retriever", "case_id"))]) + "\n"
