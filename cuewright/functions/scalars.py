"""Times, locators, scores and other small values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of a video locator.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")
SHORT_HOSTS = ("youtu.be", "www.youtu.be")
VIDEO_ID = "[A-Za-z0-9_-]{11}"
WATCH_URL = "https://www.youtube.com/watch?v="
#: Characters of a quote and of a slug.
QUOTE, SLUG = 160, 80
#: The score at which lexical confidence reaches 1 - 1/e.
SOFTNESS = 8.0


def format_timestamp(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; fractions are cut, negative counts as zero."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def timestamp_url(video_id: Column, seconds: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id, F.lit("&t="), F.greatest(F.lit(0), seconds.cast("long")).cast("string"), F.lit("s"))


def to_seconds(text: Column) -> Column:
    """Seconds of "90", "1:30" or "1:01:30"; each colon multiplies what stands before it by 60. Null if a part is no number."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda sum_, p: sum_ * 60 + p)


def _with_scheme(locator: Column) -> Column:
    raw = F.trim(locator)
    return F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))


def _query_value(url: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{key}=([^&#]+)", 1), F.lit(""))


def parse_locator(locator: Column) -> Column:
    """The 11-character id of a bare id or of a link in any usual shape; null for everything else."""
    raw, url = F.trim(locator), _with_scheme(locator)
    host = F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    first = F.regexp_extract(path, "^/+([^/]*)", 1)
    value, held = _query_value(url, "v"), F.regexp_extract(path, f"^/(?:embed|shorts|live|v)/({VIDEO_ID})", 1)
    whole = lambda c: c.rlike(f"^{VIDEO_ID}$")
    return F.when(whole(raw), raw).when(host.isin(*SHORT_HOSTS) & whole(first), first).when(host.isin(*HOSTS), F.when(whole(value), value).otherwise(F.nullif(held, F.lit(""))))


def require_locator(locator: Column) -> Column:
    """parse_locator that fails the job for what is no locator."""
    found = parse_locator(locator)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("not a video locator: "), F.coalesce(locator, F.lit("null"))))).otherwise(found)


def parse_start_offset(locator: Column) -> Column:
    """Seconds of t= or start=, as 763, 763s or 1h2m3s; null without one."""
    url = _with_scheme(locator)
    raw = F.coalesce(_query_value(url, "t"), _query_value(url, "start"))
    part = lambda unit: F.coalesce(F.regexp_extract(raw, f"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    spelt = raw.rlike("^(?:[0-9]+h)?(?:[0-9]+m)?(?:[0-9]+s)?$") & raw.rlike("[0-9]")
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("long")).when(spelt, part("h") * 3600 + part("m") * 60 + part("s"))


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, SLUG)


def quote(text: Column, limit: int = QUOTE) -> Column:
    """The text on one line, cut to limit characters with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…")))


def overlap_seconds(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def span_coverage(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Overlap over the shorter span; 0 if that has no length."""
    least = F.least(end - start, other_end - other_start)
    return F.when(least > 0, overlap_seconds(start, end, other_start, other_end) / least).otherwise(0.0)


def span_iou(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Overlap over the span that encloses both; 0 without overlap."""
    shared = overlap_seconds(start, end, other_start, other_end)
    return F.when(shared > 0, shared / (F.greatest(end, other_end) - F.least(start, other_start))).otherwise(0.0)


def cosine_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def lexical_confidence(score: Column, softness: float = SOFTNESS) -> Column:
    return F.when(score > 0, 1 - F.exp(-score / softness)).otherwise(0.0)


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def judge_score(reply: Column) -> Column:
    """The score of a judge's reply, from 0 to 1: of its first JSON object, else its first bare 0 or 1 number, else 0."""
    block = F.regexp_extract(reply, r"(?s)(\{.*?\})", 1)
    valid = F.try_parse_json(block).isNotNull()
    named = F.coalesce(F.get_json_object(block, "$.score").try_cast("double"), F.when(F.get_json_object(block, "$.score").isNull() & valid, 0.0))
    bare = F.regexp_extract(reply, r"([01](?:\.[0-9]+)?)", 1).try_cast("double")
    score = F.coalesce(F.when(block != "", named), bare, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


# Wordings of quota and overload messages.
EXHAUSTED = r"(?i)tokens per day|requests per day|\bTPD\b|\bRPD\b|per day|limit:?\s*0\b"
TRANSIENT = "(?i)429|rate.?limit|quota|resource.?exhausted|503|overloaded|timeout|unavailable"


def call_failure(message: Column) -> Column:
    """What a model service's error message says: `exhausted` (do not retry), `transient` (retry) or `permanent`."""
    return F.when(message.rlike(EXHAUSTED), "exhausted").when(message.rlike(TRANSIENT), "transient").otherwise("permanent")
