"""Fill-in-the-middle rearrangement of texts and its inverse, in Spark SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: What stands before each part of a rearranged text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a word with the blanks before it; blanks at the end are one unit.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def draws(id_col: Column, seed: int = 42, count: int = 4) -> list[Column]:
    """Unsigned numbers from the first 8-digit groups of the SHA-256 of `seed:id`; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output.

    Of 100 texts about `rate` are rearranged, and of 100 of those about `spm_rate` have the suffix first (spm), the
    others the prefix (psm). A null text counts as empty; empty texts and texts that hold a sentinel stay as they are
    (plain), with null lengths. Repeated ids are cut alike. All rows and the other columns are kept; a column with the
    name of a new one is replaced. Nothing is shuffled.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    held = {name: fresh(docs, name) for name in ("body", "units", "low", "high", "form", "prefix", "middle", "suffix")}
    col = {k: F.col(v) for k, v in held.items()}
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    kept = [F.col(c) for c in docs.columns if c not in names]
    # Each step is a projection that the next reads more than once, so Spark computes its columns once.
    cut = docs.withColumn(held["body"], F.coalesce(text_col, F.lit("")))
    cut = cut.withColumn(held["units"], F.regexp_extract_all(col["body"], F.lit(UNIT), F.lit(0)))
    size = F.size(col["units"])
    sentinel = F.contains(col["body"], F.lit(PREFIX)) | F.contains(col["body"], F.lit(SUFFIX)) | F.contains(col["body"], F.lit(MIDDLE))
    plain = (col["body"] == "") | sentinel | (h3 % 100 >= rate)
    cut = cut.withColumns({held["low"]: F.least(h1 % (size + 1), h2 % (size + 1)).cast("int"), held["high"]: F.greatest(h1 % (size + 1), h2 % (size + 1)).cast("int"), held["form"]: F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")})
    part = lambda start, length: F.array_join(F.slice(col["units"], start, length), "")
    cut = cut.withColumns({held["prefix"]: part(F.lit(1), col["low"]), held["middle"]: part(col["low"] + 1, col["high"] - col["low"]), held["suffix"]: part(col["high"] + 1, size - col["high"])})
    moved = F.when(col["form"] == "plain", col["body"])
    moved = moved.when(col["form"] == "psm", F.concat(F.lit(PREFIX), col["prefix"], F.lit(SUFFIX), col["suffix"], F.lit(MIDDLE), col["middle"]))
    moved = moved.otherwise(F.concat(F.lit(SUFFIX), col["suffix"], F.lit(PREFIX), col["prefix"], F.lit(MIDDLE), col["middle"]))
    count = lambda c: F.when(col["form"] != "plain", F.char_length(c).cast("long"))
    return cut.select(*kept, size.cast("long").alias("n"), col["form"].alias("form"), count(col["prefix"]).alias("prefix_chars"), count(col["middle"]).alias("middle_chars"), moved.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text before it was rearranged, from the output and its form alone.

    Sentinels cannot arise where parts meet, since no sentinel's end begins another, so the first of each kind is the real one.
    """
    front, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substr(F.substring_index(front, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substr(F.substring_index(front, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
