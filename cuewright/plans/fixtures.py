"""The tables of a data folder seen as this library's inputs. Transcripts are derived from conversations by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters spoken in a second.
PACE = 15.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue for each turn; it lasts as long as its text takes and begins where the one before ends."""
    talk = table(spark, sf_dir, "conversations")
    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.char_length("text")).over(line)
    return talk.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("idx"), ((end - F.char_length("text")) / F.lit(PACE)).alias("start_s"), (end / F.lit(PACE)).alias("end_s"), "text")


def marked_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with speaker marks, tags and annotations, as captions have them."""
    text = F.when(F.col("idx") % 3 == 0, F.concat(F.lit(">> JOHN SMITH: "), "text")).when(F.col("idx") % 3 == 1, F.concat(F.lit("[Music playing] <i>"), "text", F.lit("</i>"))).otherwise(F.concat(F.lit("- "), "text", F.lit(" (APPLAUSE)")))
    return cues(spark, sf_dir).withColumn("text", text)


def rolling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of which every second one begins with the last three words of the one before, and every fifth adds nothing."""
    line = Window.partitionBy("video_id").orderBy("idx")
    own = cues(spark, sf_dir)
    words = F.split(F.trim(F.regexp_replace(F.lag("text").over(line), r"\s+", " ")), " ")
    last = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3), " ")
    text = F.when(F.col("idx") % 5 == 4, last).when(F.col("idx") % 2 == 1, F.concat(last, F.lit(" "), "text")).otherwise(F.col("text"))
    return own.withColumn("text", text)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("passage_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))


def probe_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors(spark, sf_dir).filter(F.col("passage_id") % 100 == 0).withColumnRenamed("passage_id", "query_id")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each question: the one whose id is the question's."""
    return vectors(spark, sf_dir).withColumnRenamed("passage_id", "query_id").join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def judged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of each probe, relevant if they have its label: (case_id, rank, relevant)."""
    from ..operators import dense

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), "label")
    hits = dense.retrieve(vectors(spark, sf_dir), probe_vectors(spark, sf_dir), 10).join(labels, "passage_id")
    own = labels.select(F.col("passage_id").alias("query_id"), F.col("label").alias("_own"))
    return hits.join(own, "query_id").select(F.col("query_id").alias("case_id"), "rank", (F.col("label") == F.col("_own")).alias("relevant"))


def span_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues of a conversation as hits, longest first."""
    line = Window.partitionBy("video_id").orderBy((F.col("end_s") - F.col("start_s")).desc(), "idx")
    return cues(spark, sf_dir).select(F.col("video_id").alias("case_id"), (F.row_number().over(line) - 1).alias("rank"), "start_s", "end_s")


def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of 20 seconds for every third cue, beginning 5 seconds into it."""
    return cues(spark, sf_dir).filter("idx % 3 = 0").select(F.col("video_id").alias("case_id"), (F.col("start_s") + 5).alias("gold_start"), (F.col("start_s") + 25).alias("gold_end"))


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of imagined cases: a labelled document is a case, its source the retriever, its quality says whether it is answerable."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    each = table(spark, sf_dir, "labels").join(docs, "doc_id")
    share = lambda n: (F.col("doc_id") % n) / F.lit(float(n))
    return each.select(
        F.col("source").alias("retriever"), F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("refused"), (F.col("doc_id") % 9 != 0).alias("has_answer"),
        share(5).alias("recall_at_k"), share(7).alias("precision_at_k"), share(4).alias("mrr"), share(8).alias("ndcg_at_k"), share(3).alias("citation_precision"), share(2).alias("citation_hit_rate"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("top_confidence"), share(6).alias("faithfulness"), share(11).alias("answer_relevance"), share(12).alias("context_relevance"),
        F.when(F.col("doc_id") % 4 != 0, share(10)).alias("correctness"), F.col("n_chars").cast("double").alias("latency_ms"), F.array("source", F.lit("t")).alias("tags"),
    )


def chat_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits for questions: a conversation is a question, its turns are its hits in order; confidence falls with the turn."""
    own = cues(spark, sf_dir)
    return own.select(
        F.col("video_id").cast("long").alias("question_id"), F.col("idx").alias("rank"), (F.col("video_id").cast("long") * 100 + F.col("idx")).alias("passage_id"), "video_id", "start_s", "end_s", "text",
        ((F.col("video_id").cast("long") * 37 % 100) / F.lit(100.0) * (1 - F.col("idx") / F.lit(20.0))).alias("confidence"),
    )
