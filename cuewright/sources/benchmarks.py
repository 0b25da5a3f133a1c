"""Benchmark files (YAML) as rows, and given rows as sources for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cases import validate

CASES = "benchmark string, case_id string, question string, expected string, answerable boolean, tags array<string>, followup_to string, spans array<struct<gold_start:double,gold_end:double>>, n_spans int"


def seconds(value: object) -> float:
    """A number, or text such as 90, 1:30 or 1:01:30. YAML itself reads some of the latter as numbers of seconds."""
    if isinstance(value, (int, float)):
        return float(value)
    total = 0.0
    for part in str(value).strip().split(":"):
        total = total * 60 + float(part)
    return total


def span(value: object) -> tuple[float, float]:
    """A pair, a mapping with start and end, or `a-b`; the end must not come first."""
    if isinstance(value, dict):
        value = (value.get("start", value.get("start_s")), value.get("end", value.get("end_s")))
    elif isinstance(value, str):
        value = value.split("-")
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise ValueError(f"not a time span: {value!r}")
    start, end = map(seconds, value)
    if end < start:
        raise ValueError(f"a time span ends before it begins: {value!r}")
    return start, end


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one file, read by Spark as whole text; fails with all problems if it is invalid. A file is small: the driver parses it."""
    import yaml

    data = yaml.safe_load("".join(r[1] for r in spark.sparkContext.wholeTextFiles(path).collect())) or {}
    rows = []
    for case in data.get("cases") or []:
        spans = [span(s) for s in case.get("relevant_spans") or []]
        rows.append((data.get("name"), case["id"], case["question"], case.get("expected_answer"), case.get("answerable", True), case.get("tags") or [], case.get("followup_to"), spans, len(spans)))
    cases = spark.createDataFrame(rows, CASES)
    problems = [f"{r.case_id}: {r.problem}" for r in validate(cases).collect()]
    if problems:
        raise ValueError("; ".join(sorted(problems)))
    return cases


def static_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Given rows in the place of a network source."""
    return spark.createDataFrame(rows, schema)
