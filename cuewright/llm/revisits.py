"""WARC revisits: a not-modified capture is resolved to the latest earlier full response of its canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rank_among

#: Headers of a 304 that must not replace those of the stored response (RFC 9111, section 3.2, and hop-by-hop ones).
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, m and default port, path without a final slash, query sorted and without tracking.

    Scheme and fragment are dropped. Null stays null.
    """
    rest = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^(www[0-9]*|m)\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.concat_ws("&", query))).otherwise(""))


def merge_headers(stored: Column, sent: Column) -> Column:
    """The stored response's headers with the permitted ones of the 304 put over them; names in lower case."""
    sent = F.map_filter(sent, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    held = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(sent), k))
    return F.map_concat(held, sent)


def same_validator(sent: Column, stored: Column) -> Column:
    """Whether two ETags are equal by weak comparison (a leading W/ does not count); null if one is missing."""
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    return bare(sent) == bare(stored)


def resolve(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row for each revisit: (capture_id, canonical_url, refers_to, verdict, headers).

    captures: (capture_id, url, time, kind, etag, last_modified, headers); time is a number, kind `response` (full)
    or `revisit`, header names in lower case. refers_to is the response of the same canonical URL with the latest
    time below the revisit's (on ties the largest capture_id). verdict is `missing` without an earlier response; else
    the ETags decide if both have one, by weak comparison, and the dates of modification only if not: `match` or
    `changed`, and `unproven` if they share neither. Headers are merged for `match`; otherwise they are the revisit's
    own. Null urls and null times stay unresolved (`missing`); repeated rows give repeated results; other columns,
    whatever their names, are dropped; an empty table gives an empty result.

    A URL may hold a large part of all captures, so captures of one URL and time become one point before they are
    put in order, and time is cut into `ranges` ranges of about equal numbers: each finds its own answer, and what
    a range leaves open comes from the last response of the ranges before it, one row for each.
    """
    ranges = ranges or 4 * int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(captures.agg(F.percentile_approx("time", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []))
    part = rank_among(edges, F.col("time"))
    no_headers = F.create_map().cast("map<string,string>")
    rows = captures.select("capture_id", canonical_url(F.col("url")).alias("canonical_url"), "time", "kind", "etag", "last_modified", F.coalesce("headers", no_headers).alias("headers"))
    usable = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    full = F.col("kind") == "response"
    held = F.struct("time", "capture_id", "etag", "last_modified", "headers")
    points = rows.filter(usable).groupBy("canonical_url", "time").agg(F.max_by(held, F.when(full, F.col("capture_id"))).alias("held")).withColumn("part", part)
    line = Window.partitionBy("canonical_url", "part").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    near = points.withColumn("near", F.last("held", ignorenulls=True).over(line))
    last = points.groupBy("canonical_url", "part").agg(F.max_by("held", F.when(F.col("held").isNotNull(), F.col("time"))).alias("held"))
    parts = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("canonical_url", "part", F.last("held", ignorenulls=True).over(parts).alias("before"))
    answers = near.join(before, ["canonical_url", "part"]).select("canonical_url", "time", F.coalesce("near", "before").alias("at"))
    # A table of its own, so that the join can split a moment at which one URL has very many revisits.
    answers = materialize(answers, "answers")
    found = rows.filter("kind = 'revisit'").join(answers, ["canonical_url", "time"], "left")
    same = F.coalesce(same_validator(F.col("etag"), F.col("at.etag")), F.col("last_modified") == F.col("at.last_modified"))
    found = found.withColumn("verdict", F.when(F.col("at").isNull(), "missing").when(same, "match").when(~same, "changed").otherwise("unproven"))
    headers = F.when(F.col("verdict") == "match", merge_headers(F.col("at.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select("capture_id", "canonical_url", F.col("at.capture_id").alias("refers_to"), "verdict", headers.alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log of the pages table: a full response of each page, and later a not-modified capture of its URL.

    The table has no revisits, so they are derived by rule: page p responds at time 2p and is revisited at
    2(p + 1 + crc32(p) mod 50) + 1. The revisit repeats the page's validators, but every fifth (by crc32) has
    another ETag and every seventh has none.
    """
    spread = F.crc32(F.col("page_id").cast("string").cast("binary"))
    etag, modified = F.md5(F.coalesce("html", F.lit(""))), F.concat(F.lit("day-"), F.floor(F.col("page_id") / 7).cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    response = F.struct(
        (2 * F.col("page_id")).alias("capture_id"), (2 * F.col("page_id")).alias("time"), F.lit("response").alias("kind"), etag.alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    none = F.lit(None).cast("string")
    revisit = F.struct(
        (2 * F.col("page_id") + 1).alias("capture_id"), (2 * (F.col("page_id") + 1 + spread % 50) + 1).alias("time"), F.lit("revisit").alias("kind"),
        F.when(spread % 7 == 0, none).when(spread % 5 == 0, F.md5(etag)).otherwise(etag).alias("etag"), F.when(spread % 7 == 0, none).otherwise(modified).alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=300"), F.lit("date"), F.concat(F.lit("visit-"), F.col("page_id").cast("string"))).alias("headers"),
    )
    return pages.select("url", F.explode(F.array(response, revisit)).alias("c")).select("url", "c.*")
