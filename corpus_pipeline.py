"""A corpus pipeline over the documents table: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import bpe, decontaminate, langid, near_copies, pii
from cuewright.llm.common import discard, fresh, materialize, table

#: A document whose language is less sure than this is rejected, and so is one without letters.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, all columns unchanged; null texts and texts without a letter go, repeated rows stay."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.identify(docs, langid.fit(docs), lang=lang, score=score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles in common): the one with the smallest doc_id.

    Null and wordless texts are one group; of rows that agree in doc_id and text one stays; null ids come last.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, repeated rows stay."""
    leaks = fresh(docs, "leaks")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), out=leaks).filter(F.size(leaks) == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars is that of the new text, null for a null text."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text; a null text has none and decodes to nothing."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lossless = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", lossless.alias("lossless"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: Linear SVMs, fingerprint components, alignments and byte pair merges aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each one's table is deleted once the next has been written, the last but one stays for the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
