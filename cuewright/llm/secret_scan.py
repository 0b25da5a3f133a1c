"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed. Each pair of a blob and a rule's version is scanned once: pairs
that the ledger lists are left out, copies of a blob count once, and findings are joined back to all paths. A
finding carries its rule's key (kind/version), so findings of a version that a newer one replaced are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match fails if group `group` has fewer than `least` characters; needs: a cheap test first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    needs: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "(AKIA[A-Z0-9]+)", 1, 16, needs="AKIA"),
    Rule("hex", "([0-9a-f]{32,})", 1, 32),
    Rule("private_key", "(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", 1, needs="PRIVATE KEY-----"),
    Rule("github", "(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, needs="gh"),
    Rule("slack", "(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15, needs="xox"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, needs="eyJ"),
)


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): each distinct blob with the keys of the rules that have not scanned it yet.

    One text of each blob is kept before the shuffle already, so a blob that a third of all paths share costs
    one row a task.
    """
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", every)
    done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))
    todo = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, marks: bool = False) -> DataFrame:
    """Findings (blob, rule, kind, start, end) in code points, leftmost and without overlaps within a kind.

    marks: also a row without kind and place for each blob, whose rule names all that it was scanned by.

    A match's place is the length of all gaps and matches before it: a text is cut at the matches of a rule, and
    the lengths of the pieces are summed in order within one blob and rule.
    """
    empty = F.array().cast("array<struct<gap:int,hit:int,held:int>>")

    def pieces(rule: Rule) -> Column:
        lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p))
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        held = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
        gaps = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(hits))
        test = F.array_contains("todo", rule.key) & (F.contains("text", F.lit(rule.needs)) if rule.needs else F.lit(True)) & F.col("text").rlike(rule.pattern)
        rows = F.arrays_zip(lengths(gaps).alias("gap"), lengths(hits).alias("hit"), lengths(held).alias("held"))
        return F.when(test, rows).otherwise(empty)

    kinds = F.array(*(F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), pieces(r).alias("pieces")) for r in rules))
    if marks:
        mark = F.array(F.struct(F.lit(0).alias("gap"), F.lit(0).alias("hit"), F.lit(None).cast("int").alias("held")))
        kinds = F.concat(kinds, F.array(F.struct(F.array_join("todo", " ").alias("rule"), F.lit("").alias("kind"), F.lit(1).alias("least"), mark.alias("pieces"))))
    found = blobs.select("blob", F.explode(F.filter(kinds, lambda k: F.size(k["pieces"]) > 0)).alias("k"))
    found = found.select("blob", "k.rule", "k.kind", "k.least", F.posexplode("k.pieces").alias("place", "p"))
    line = Window.partitionBy("blob", "rule").orderBy("place")
    found = found.withColumn("end", F.sum(F.col("p.gap") + F.col("p.hit")).over(line))
    real = F.col("p.held").isNotNull()
    kept = found.filter(F.col("p.held") >= F.col("least")) if not marks else found.filter(~real | (F.col("p.held") >= F.col("least")))
    if marks:
        return kept.select("blob", "rule", F.when(real, F.col("kind")).alias("kind"), F.when(real, F.col("end") - F.col("p.hit")).alias("start"), F.when(real, F.col("end")).alias("end"))
    return kept.select("blob", "rule", "kind", (F.col("end") - F.col("p.hit")).alias("start"), "end")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger) for versions of paths: a row of `versions` is one version of one path.

    paths: (path_col, blob, spans) for every row, spans an array of (start, place, kind, end) in order of start, then
    of the place of their rule in `rules`; findings: the new ones and those `known` from earlier scans by rules that
    still hold (of a rule whose version changed only the new version's stay); ledger: (blob, rule) pairs scanned so
    far. A null text is an empty blob. Repeated rows stay; a null path stays; an empty table gives empty results.
    """
    findings, scanned = scan_new(versions, ledger, known, rules, text_col)
    return join_back(versions, findings, rules, path_col, text_col), findings, scanned if ledger is None else ledger.unionByName(scanned)


def scan_new(versions: DataFrame, ledger: DataFrame | None, known: DataFrame | None, rules: tuple[Rule, ...], text_col: str) -> tuple[DataFrame, DataFrame]:
    """(findings with those known that still hold, the (blob, rule) pairs scanned now)."""
    blobs = unseen(versions.select(content_address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ledger, rules)
    findings = scan(blobs, rules)
    if known is not None:
        findings = findings.unionByName(known.filter(F.col("rule").isin(*(r.key for r in rules))))
    return findings, blobs.select("blob", F.explode("todo").alias("rule"))


def join_back(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...], path_col: str, text_col: str) -> DataFrame:
    """(path_col, blob, spans) for every version."""
    rows = versions.select(path_col, content_address(F.col(text_col)).alias("blob"))
    place = F.array_position(F.array(*(F.lit(r.key) for r in rules)), F.col("rule")).cast("int")
    span = F.struct(F.col("start").cast("long").alias("start"), place.alias("place"), "kind", F.col("end").cast("long").alias("end"))
    # A table of its own, so that the join can split a blob that very many paths have.
    each = materialize(findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans")), "findings")
    paths = rows.join(each, "blob", "left")
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return paths.select(path_col, "blob", F.coalesce("spans", none).alias("spans"))


def count_kind(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan_generations(generations: list[DataFrame], rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """paths (as scan_versions has them) of the last of several generations of versions.

    Each generation is scanned with the ledger and the findings that those before it left. What a generation found and
    scanned is written in one run, a finding with the pair that has it, so no blob is scanned again; in the end only
    the findings that the result reads are left.
    """
    kept: list[DataFrame] = []
    for versions in generations:
        ledger = None
        if kept:
            ledger = reduce(DataFrame.unionByName, kept).filter("kind IS NULL").select("blob", F.explode(F.split("rule", " ")).alias("rule"))
        blobs = unseen(versions.select(content_address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ledger, rules)
        kept.append(materialize(scan(blobs, rules, marks=True), "scanned"))
    found = reduce(DataFrame.unionByName, kept).filter(F.col("kind").isNotNull() & F.col("rule").isin(*(r.key for r in rules)))
    paths = join_back(generations[-1], found, rules, path_col, text_col)
    for table in kept:
        discard(table)
    return paths
