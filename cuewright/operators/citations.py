"""Numbered context for a model, and the citations in what it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_timestamp, quote, timestamp_url

MARKER = r"\[([0-9]{1,2})\]"
#: Characters of context that a model gets.
BUDGET = 8000


def markers(text: Column) -> Column:
    """Marker numbers in order of first appearance, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda n: n.cast("int")))


def strip_invalid(text: Column, n: Column) -> Column:
    """The text without markers outside 1 to n; spaces are only tidied if one went."""
    bad = F.exists(markers(text), lambda m: (m < 1) | (m > n))
    cut = F.aggregate(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))), lambda m: (m.cast("int") < 1) | (m.cast("int") > n)), text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(cut, "[ \\t]{2,}", " "), r"\s+([.,;:!?])", "$1"))
    return F.when(bad, tidy).otherwise(text)


def block(n: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), format_timestamp(start), F.lit(" - "), format_timestamp(end), F.lit(")\n"), text)


def within_budget(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Hits (question_id, rank, start_s, end_s, text, ...) whose blocks fit the budget, with `block`: the first always, then up to the first that overflows."""
    line = Window.partitionBy("question_id").orderBy("rank")
    numbered = hits.withColumn("_n", F.row_number().over(line)).withColumn("block", block(F.col("_n"), F.col("start_s"), F.col("end_s"), F.col("text")))
    held = F.sum(F.char_length("block")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("_held", held).filter((F.col("_n") == 1) | (F.col("_held") <= budget)).drop("_n", "_held")


def context(used: DataFrame) -> DataFrame:
    """(question_id, context, n_used): the blocks of a question, a blank line between two."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return used.groupBy("question_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"), F.count("*").cast("int").alias("n_used"))


def build_citations(answers: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, citations) of answers(question_id, text, ...) by the hits that were in their context.

    answers get `cleaned` (without invalid markers), `invalid` and n_used; citations are (question_id, place,
    marker, passage_id, start_s, end_s, url, timestamp, quote), place in order of first appearance.
    """
    line = Window.partitionBy("question_id").orderBy("rank")
    numbered = used.withColumn("marker", F.row_number().over(line))
    counts = numbered.groupBy("question_id").agg(F.count("*").cast("int").alias("n_used"))
    known = answers.join(counts, "question_id", "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))
    known = known.withColumns({"cleaned": strip_invalid(F.col("text"), F.col("n_used")), "invalid": F.filter(markers(F.col("text")), lambda m: (m < 1) | (m > F.col("n_used")))})
    asked = known.select("question_id", F.posexplode(markers(F.col("cleaned"))).alias("place", "marker"))
    found = asked.join(numbered.select("question_id", "marker", "passage_id", "video_id", "start_s", "end_s", F.col("text").alias("_text")), ["question_id", "marker"])
    return known, found.select(
        "question_id", "place", "marker", "passage_id", "start_s", "end_s",
        timestamp_url(F.col("video_id").cast("string"), F.col("start_s")).alias("url"), format_timestamp(F.col("start_s")).alias("timestamp"), quote(F.col("_text")).alias("quote"),
    )


def sources_text(citations: DataFrame) -> DataFrame:
    """(question_id, sources): a line for each citation."""
    line = F.format_string("[%d] %s  %s", "marker", "timestamp", "url")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return citations.groupBy("question_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("sources"))
