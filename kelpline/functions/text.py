"""Text and time expressions as Columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of user messages that only repeat instructions, and of sessions that only restate other data.
BOILERPLATE = ("# AGENTS.md", "<permissions instructions>", "<INSTRUCTIONS>")
RESTATING = ('Summarize the relationship with "',)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the plan, and is worked out, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_space(c: Column) -> Column:
    """Unicode white space off both ends, new lines and no-break spaces included. A pattern for the end alone would be tried at each place of a text."""
    return F.regexp_extract(c, r"(?sU)^\s*+(.*\S)", 1)


def clip_runes(c: Column, n: int) -> Column:
    """At most ``n`` code points, with an ellipsis if something was cut."""
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def clip_chars(c: Column, n: int) -> Column:
    """At most ``n`` code points, without an ellipsis; all of them if ``n`` is not positive."""
    return F.left(c, F.lit(n)) if n > 0 else c


def clip_line(c: Column, n: int) -> Column:
    """One line: white space runs become one space, then ``clip_runes``."""
    return clip_runes(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), n)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), "")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def chunk_id(message_id: Column, i: Column) -> Column:
    return F.concat(message_id, F.lit("#"), i.cast("string"))


def record_id(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def indexable(role: Column, text: Column, prefixes: tuple[str, ...] = BOILERPLATE) -> Column:
    """User and assistant messages of eight bytes or more; a user's must not begin with a boilerplate prefix."""

    return role.isin("user", "assistant") & let(text, lambda t: _fits(role, t, prefixes))


def indexed(role: Column, text: Column, prefixes: tuple[str, ...] = BOILERPLATE) -> Column:
    """``text`` where it is ``indexable``, else null; it is worked out once."""
    return F.when(role.isin("user", "assistant"), let(text, lambda t: F.when(_fits(role, t, prefixes), t)))


def _fits(role: Column, text: Column, prefixes: tuple[str, ...]) -> Column:
    body = F.regexp_replace(text, r"^[ \t\r\n]+", "")
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | body.startswith(p)
    return (F.octet_length(text) >= 8) & ~((role == "user") & starts)


def project_from_cwd(cwd: Column) -> Column:
    """Last path segment of a working directory, else ``unknown``."""
    path = F.coalesce(cwd, F.lit(""))
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(base.isin("", ".") | (trim_space(path) == ""), "unknown").otherwise(base)


def rfc3339(value: Column) -> Column:
    """Unix seconds of an RFC 3339 time, white space around it aside, else 0."""
    t = trim_space(value)
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.unix_seconds(t.try_cast("timestamp"))), F.lit(0))


def raw_timestamp(value: Column) -> Column:
    """Unix seconds of a number (milliseconds above 1e10) or of an RFC 3339 string, else 0."""
    number = value.try_cast("double")
    scaled = F.when(number > 1e10, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), scaled.cast("long")).otherwise(F.coalesce(rfc3339(value), F.lit(0))).cast("long")


def when_format(seconds: Column) -> Column:
    """UTC minute of a Unix time; the session's time zone is expected to be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def month_format(seconds: Column) -> Column:
    """UTC month of a Unix time, by which exports of chats are filed."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def guess_container(path: Column, source: Column) -> Column:
    """A session's id from its file's name: for pi what follows the last underscore, else the last five of five or more parts between hyphens, else all."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")
    parts = F.split(base, "-")
    last = F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, -5, 5), "-")).otherwise(base)
    return F.when((source == "pi") & base.contains("_"), F.substring_index(base, "_", -1)).otherwise(last)


def object_store_url(url: str) -> tuple[str, str]:
    """(bucket, prefix) of an ``s3://bucket/prefix`` address."""
    scheme, _, rest = url.partition("://")
    bucket, _, prefix = rest.split("?")[0].split("#")[0].partition("/")
    if scheme.lower() != "s3" or not bucket:
        raise ValueError(f"invalid s3 url {url!r}")
    return bucket, prefix
