"""Document fingerprints: a Merkle tree of sections, paragraphs and leaves, with DataFrame functions only.

A paragraph is a line with its break. A section ends after a paragraph whose digest begins with 0; a blank line's
does, and in texts without blank lines about every sixteenth other paragraph's, so an edit changes one section and
leaves those around it as they are. A paragraph's digest is SHA-256 of its text, a section's that of its
paragraphs' digests, the root's that of its sections'. Every character belongs to exactly one paragraph, so equal
roots mean equal texts. Paragraphs are cut further into leaves, after punctuation and after LEAF characters at the
latest, so that likeness has a scale within long lines too.

The tree is kept as text: a paragraph is its short digest and those of its leaves, paragraphs are joined by `.`, and
`;` ends a section. It holds nothing of the document's own characters, so no character can break it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rank_among

#: Characters of the longest leaf, and hexadecimal digits of a short digest.
LEAF, DIGITS = 80, 8
PARAGRAPH = "[^\n]*\n|[^\n]+"
CLAUSE = rf"(?s).{{1,{LEAF}}}?(?:[.!?;:,|]+[ \t]+|\n)|.{{{LEAF}}}|.+"
_LAST = r"\b(0[0-9a-f]*)\."


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def _ended(tokens: Column) -> Column:
    """Paragraphs' digits as one text, with the ends of sections marked."""
    return F.regexp_replace(F.concat(F.array_join(tokens, "."), F.lit(".")), _LAST, "$1;")


def _parts(text: Column, mark: str) -> Column:
    return F.filter(F.split(text, mark), lambda x: x != "")


def root(text: Column) -> Column:
    """The root digest of a whole text as 64 hex digits."""
    sections = _parts(_ended(F.transform(paragraphs(text), lambda p: F.sha2(p, 256))), ";")
    return F.sha2(F.array_join(F.transform(sections, lambda s: F.sha2(s, 256)), ""), 256)


def tree(text: Column) -> Column:
    """The tree with short digests as text; empty for an empty text."""
    leaves = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda c: F.substring(F.md5(c), 1, DIGITS)), "")
    tokens = F.transform(paragraphs(text), lambda p: F.concat(F.substring(F.sha2(p, 256), 1, DIGITS), leaves(p)))
    return F.when(text == "", "").otherwise(_ended(tokens))


def fingerprint(text: Column) -> Column:
    """struct(root, tree); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(root(text).alias("root"), tree(text).alias("tree"))


def as_string(print_: Column) -> Column:
    """The fingerprint as one string: the root's digits, a colon, the tree."""
    return F.concat(print_["root"], F.lit(":"), print_["tree"])


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness of two fingerprint columns, from 0 to 1, by descent through both trees.

    1 for equal roots. Else sections in common count with all their leaves and are not looked into; of the others'
    paragraphs those in common count likewise; of the rest's leaves each distinct one counts by itself. Likeness is
    twice the leaves in common over the leaves of both.
    """
    leaves_of = lambda p: F.expr(f"aggregate({p}, 0, (n, x) -> n + cast(length(x) / {DIGITS} as int) - 1)")
    below = lambda nodes, mark: F.array_distinct(F.flatten(F.transform(nodes, lambda x: F.filter(F.split(x, mark), lambda y: y != ""))))
    steps = df.withColumns({"_sa": _parts(F.col(f"{a}.tree"), ";"), "_sb": _parts(F.col(f"{b}.tree"), ";")})
    steps = steps.withColumns({"_pc": below(F.array_intersect("_sa", "_sb"), r"\."), "_pa": below(F.array_except("_sa", "_sb"), r"\."), "_pb": below(F.array_except("_sb", "_sa"), r"\.")})
    steps = steps.withColumns({"_pd": F.array_intersect("_pa", "_pb"), "_la": F.array_except("_pa", "_pb"), "_lb": F.array_except("_pb", "_pa")})
    cut = lambda nodes: F.array_distinct(F.flatten(F.transform(nodes, lambda x: F.regexp_extract_all(F.substring(x, F.lit(DIGITS + 1), F.length(x)), F.lit(f".{{{DIGITS}}}"), F.lit(0)))))
    steps = steps.withColumns({"_la": cut(F.col("_la")), "_lb": cut(F.col("_lb"))})
    steps = steps.withColumns({"_ld": F.size(F.array_intersect("_la", "_lb")), "_both": leaves_of("_pc") + leaves_of("_pd")})
    twice = 2.0 * (F.col("_both") + F.col("_ld"))
    alone = F.size("_la") + F.size("_lb") - 2 * F.col("_ld")
    value = F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0).when(twice + alone == 0, 0.0).otherwise(twice / (twice + alone))
    return steps.withColumn(out, value).drop("_sa", "_sb", "_pa", "_pb", "_pc", "_pd", "_la", "_lb", "_ld", "_both")


def nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph with its place and digests: (id_col, section, paragraph, section_digest, digest).

    section and paragraph count from 0, paragraph within its section. A null or empty text has no paragraphs; ids
    are taken as they are, and two rows of one id as one document's. Other columns are not looked at.
    """
    digests = F.transform(paragraphs(F.coalesce(F.col(text_col), F.lit(""))), lambda p: F.sha2(p, 256))
    cut = df.select(F.col(id_col), F.posexplode(_parts(_ended(digests), ";")).alias("section", "_s"))
    cut = cut.filter("_s <> '.'").select(id_col, "section", F.sha2("_s", 256).alias("section_digest"), F.posexplode(_parts(F.col("_s"), r"\.")).alias("paragraph", "digest"))
    return cut.select(id_col, "section", "paragraph", "section_digest", "digest")


def edits(old: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Where the nodes of two versions differ: (id_col, change, section, paragraph, new_section, new_paragraph).

    Sections in common, told by digest, are not looked into. Paragraphs of the others are aligned by digest (the
    n-th one with a digest with the n-th of the other version); what is left over between the same two aligned ones
    is paired in order as `edited`, and the rest is `added` or `removed`. An inserted paragraph is one row.
    """
    def numbered(side: DataFrame, kept: DataFrame) -> DataFrame:
        return side.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "digest").orderBy("section", "paragraph"))).join(kept, [id_col, "section_digest"], "left")

    same = old.select(id_col, "section_digest").distinct().intersect(new.select(id_col, "section_digest").distinct())
    # A section that occurs more often in one version differs; its digest alone doesn't tell which of them.
    times = lambda side: side.filter("paragraph = 0").groupBy(id_col, "section_digest").agg(F.count("*").alias("_times"))
    even = times(old).join(times(new), [id_col, "section_digest", "_times"]).select(id_col, "section_digest").join(same, [id_col, "section_digest"], "left_semi").withColumn("_same", F.lit(True))
    before, after = numbered(old, even), numbered(new, even)
    found = before.filter("_same IS NULL").select(id_col, "digest", "_n").intersect(after.filter("_same IS NULL").select(id_col, "digest", "_n")).withColumn("_found", F.lit(True))

    def open_rows(side: DataFrame) -> DataFrame:
        marked = side.join(found, [id_col, "digest", "_n"], "left")
        held = F.coalesce("_same", "_found", F.lit(False))
        line = Window.partitionBy(id_col).orderBy("section", "paragraph").rowsBetween(Window.unboundedPreceding, -1)
        marked = marked.withColumns({"_open": ~held, "_anchor": F.last(F.when(held, F.struct("digest", "_n")), ignorenulls=True).over(line)})
        gap = Window.partitionBy(id_col, "_anchor").orderBy("section", "paragraph")
        return marked.filter("_open").withColumn("_k", F.row_number().over(gap)).select(F.col(id_col).alias("_id"), "_anchor", "_k", "section", "paragraph")

    left, right = open_rows(before), open_rows(after).select(F.col("_id").alias("_id2"), F.col("_anchor").alias("_anchor2"), F.col("_k").alias("_k2"), F.col("section").alias("new_section"), F.col("paragraph").alias("new_paragraph"))
    paired = left.join(right, F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_anchor").eqNullSafe(F.col("_anchor2")) & (F.col("_k") == F.col("_k2")), "full")
    change = F.when(F.col("section").isNull(), "added").when(F.col("new_section").isNull(), "removed").otherwise("edited")
    return paired.select(F.coalesce("_id", "_id2").alias(id_col), change.alias("change"), "section", "paragraph", "new_section", "new_paragraph")


def with_next(df: DataFrame, id_col: str, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """df with columns of the next row in descending id_col (null ids last, ties by `order`); the last row's next is the first.

    Ids are dealt to ranges of about equal numbers of rows, whatever their distances, about four for each shuffle
    partition. The head of each range is also sent, as a guest, to the end of the range before it, so that each
    range finds its own answer in one shuffle. Only the ranges' edges and heads reach the driver. columns: source
    to new name.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(df.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []))
    own = F.coalesce(len(edges) - rank_among(edges, F.col(id_col)), F.lit(len(edges) + 1))
    dealt = df.withColumn("_own", own)
    heads = sorted(tuple(r) for r in dealt.groupBy("_own").agg(F.max(id_col)).collect())
    if not heads:
        return df.withColumns({name: F.col(source) for source, name in columns.items()})
    numbers = {k: i for i, (k, _) in enumerate(heads)}
    at = F.element_at(F.array(*(F.lit(numbers.get(k, 0)) for k in range(len(edges) + 2))), F.col("_own") + 1)
    head = F.element_at(F.array(*(F.lit(h).cast("long") for _, h in heads)), F.col("_range") + 1)
    before = F.pmod(F.col("_range") - 1, F.lit(len(heads)))
    stay, guest = F.struct(F.col("_range").alias("at"), F.lit(0).alias("guest")), F.struct(before.alias("at"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("_range", at)
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col(id_col).eqNullSafe(head), F.array(stay, guest)).otherwise(F.array(stay))))
    line = Window.partitionBy("_at").orderBy("_guest", F.col(id_col).desc_nulls_last(), *order)
    dealt = dealt.select(*df.columns, F.col("_to.at").alias("_at"), F.col("_to.guest").alias("_guest"))
    return dealt.withColumns({name: F.lead(source).over(line) for source, name in columns.items()}).filter("_guest = 0").drop("_at", "_guest")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text (null: empty), its edited text and the next document's, by their fingerprints.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in descending id. Returns (id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next), a row for each row. Null ids come last, repeated ids are put in order by their texts' digests;
    a lone document is its own next. Other columns are not looked at.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    docs = with_next(docs.withColumn("_print", fingerprint(F.col("_text"))), "_id", [F.col("_print.root")], {"_text": "_next", "_print": "_next_print"})
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("_text", 1, n - half), F.substring("_next", 1, half))})
    docs = docs.withColumn("_edited_print", fingerprint(F.col("edited")))
    docs = docs.select("_id", "n_chars", "edited", "_print", "_edited_print", "_next_print")
    docs = with_likeness(with_likeness(docs, "_print", "_edited_print", "near_edited"), "_print", "_next_print", "near_next")
    return docs.select(F.col("_id").alias(id_col), "n_chars", "edited", as_string(F.col("_print")).alias("fingerprint"), as_string(F.col("_edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")
