"""Contextual units: what is embedded for a message is its header, the lines it follows or answers, and its text.

Rows come from ``sources.jsonl.parse``: placed by (key, at, sub, line_no). All context stays within one object.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.batches import bounded_batches
from kelpline.functions.text import clip_chars, clip_line, content_hash, trim_space
from kelpline.sources.jsonl import CHATS

LEAD_GAP, LEAD_LINES, LINE_RUNES, QUESTION_RUNES = 600, 2, 200, 300
CHUNK_TOKENS, OVERLAP = 384, 64
#: Characters of a text that is counted whole before it is split.
SHORT = 4096
#: Display names in headers.
HARNESSES = {"claude": "Claude Code", "codex": "Codex", "pi": "Pi", "omp": "OMP", "grok": "Grok", "grokbot": "Grok bot"}
X_KINDS = {"dm": "DM", "group": "group"}
TELEGRAM_KINDS = {"dm": "direct chat", "group": "group", "channel": "channel", "topic": "group topic"}

#: Characters of an error that are kept.
ERROR = 500
#: Rows and bytes that a Python worker is given at once: what it makes of them is several times as large.
ROWS, BYTES = 200, "4m"
_PLACE = ("at", "sub", "line_no")
#: Control characters with a letter of their own, all others by number.
ESCAPES = [(chr(i), "\\" + name) for i, name in zip(range(7, 14), "abtnvfr")] + [(chr(i), f"\\x{i:02x}") for i in (*range(7), *range(14, 32), 127)]


def _named(c: Column, names: dict[str, str], other: Column | str) -> Column:
    picked = reduce(lambda w, kv: w.when(c == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return picked.otherwise(other)


def quoted(c: Column) -> Column:
    """In double quotes, with backslashes, quotes and control characters escaped."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), *ESCAPES):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def header() -> Column:
    """The one line that says where a row is from."""
    source, kind, title = F.col("source"), F.col("container_kind"), trim_space(F.col("container_title"))
    none = title == ""
    x = _named(kind, X_KINDS, "chat")
    with_title = F.when(x == "DM", "DM with").otherwise(x)
    telegram = F.concat(F.lit("Telegram "), _named(kind, TELEGRAM_KINDS, "chat"))
    session = F.concat(
        _named(source, HARNESSES, source), F.lit(" session"), F.when(none, "").otherwise(F.concat(F.lit(" "), quoted(title))),
        F.when(F.col("project").isin("", "unknown"), "").otherwise(F.concat(F.lit(" in "), F.col("project"))),
    )
    return (
        F.when((source == "x") & none, F.concat(F.lit("X "), x))
        .when(source == "x", F.concat(F.lit("X "), with_title, F.lit(" "), quoted(title)))
        .when(source.isin(*CHATS) & none, telegram)
        .when(source.isin(*CHATS), F.concat(telegram, F.lit(" "), quoted(title)))
        .when(source == "crm", F.concat(F.lit("CRM notes on "), quoted(F.when(none, F.col("container_id")).otherwise(title))))
        .otherwise(session)
    )


def plain_title(text: Column) -> Column:
    """A title row's text without its ``TITLE <kind>: `` mark."""
    return trim_space(F.regexp_replace(text, r"(?s)^TITLE .*?: ", ""))


def carried(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, container_id, title, asked): what units of rows that come later take from these, or from what was carried ``before`` them: the last title and the user's last question."""
    place = F.struct(*_PLACE)
    asks = (F.col("kind") == "message") & ~F.col("source").isin(*CHATS) & (F.col("author_id") == "user")
    pick = lambda what, value: F.max_by(F.when(what, value), F.when(what, place))
    last = rows.groupBy("key", "container_id").agg(pick(F.col("kind") == "title", plain_title(F.col("text"))).alias("title"), pick(asks, clip_line(F.col("text"), QUESTION_RUNES)).alias("asked"))
    if before is None:
        return last
    both = last.withColumn("_at", F.lit(1)).unionByName(before.select("key", "container_id", "title", "asked").withColumn("_at", F.lit(0)))
    return both.groupBy("key", "container_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in ("title", "asked")])


def units(rows: DataFrame, before: DataFrame | None = None, sources: list[str] | None = None) -> DataFrame:
    """``rows`` with header, body and the unit's content_hash; container_title is filled from the last title of the container.

    Where ``rows`` continue sessions, ``before`` is what ``carried`` gave for the rows before them. ``sources`` are those that rows are of, where they are known: what only chats have is planned for these alone.
    """
    if before is not None:
        told = before.select("key", "container_id", F.col("title").alias("_title"), F.col("asked").alias("_before"))
        return units(rows.join(told, ["key", "container_id"], "left"), sources=sources).drop("_title", "_before")
    chat, order = F.col("source").isin(*CHATS), list(_PLACE)
    container = W.partitionBy("key", "container_id").orderBy(*order)
    titles = F.last(F.when(F.col("kind") == "title", plain_title(F.col("text"))), ignorenulls=True).over(container.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    told = (F.col("kind") == "message") & ~chat
    asked = F.last(F.when(told & (F.col("author_id") == "user"), clip_line(F.col("text"), QUESTION_RUNES)), ignorenulls=True).over(container.rowsBetween(W.unboundedPreceding, -1))
    author = F.when(F.col("author_name") != "", F.col("author_name")).otherwise(F.col("author_id"))
    line = F.when(chat & (author != ""), F.concat(author, F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    if "_title" in rows.columns:
        titles, asked = F.coalesce(titles, "_title"), F.coalesce(asked, "_before")
    r = rows.withColumns({
        "container_title": F.when(F.col("container_title") != "", F.col("container_title")).otherwise(F.coalesce(titles, F.lit(""))),
        "_line": line, "_asked": F.when(told & (F.col("author_id") == "assistant"), F.nullif(asked, F.lit(""))),
    })
    context = [F.when(F.col("_asked").isNotNull(), F.concat(F.lit("Re: "), F.col("_asked"))), F.col("_line")]
    if sources is None or not set(CHATS).isdisjoint(sources):
        r, talk = _led(r, rows.where(chat).withColumn("_line", line))
        context = [*talk, *context]
    out = r.withColumns({"header": header(), "body": F.concat_ws("\n", *context)})
    return out.withColumn("content_hash", content_hash(F.concat_ws("\n", "header", "body"))).select(*rows.columns, "header", "body")


def _led(r: DataFrame, chats: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``r``, and the lines before a chat's: the one it answers, of ``chats``, and those it follows."""
    talk = W.partitionBy("key", "source", "container_id", F.col("container_kind") == "channel").orderBy(*_PLACE)
    leads = F.col("source").isin(*CHATS) & (F.col("container_kind") != "channel")
    for k in range(1, LEAD_LINES + 1):
        near = leads & (F.col("timestamp") - F.lag("timestamp", k).over(talk) <= LEAD_GAP)
        r = r.withColumns({f"_id{k}": F.when(near, F.lag("id", k).over(talk)), f"_lead{k}": F.when(near, clip_line(F.lag("_line", k).over(talk), LINE_RUNES))})
    answered = chats.where(leads & (F.col("reply_to") != "")).select("key", F.col("reply_to").alias("id")).distinct()
    parents = chats.join(answered, ["key", "id"], "left_semi").select("key", F.col("id").alias("reply_to"), F.struct(*_PLACE).alias("_pplace"), F.col("_line").alias("_pline"))
    r = r.join(parents, ["key", "reply_to"], "left")
    said = F.lit(False)
    for k in range(1, LEAD_LINES + 1):
        said = said | F.coalesce(F.col(f"_id{k}") == F.col("reply_to"), F.lit(False))
    parent = F.when(leads & ~said & (F.col("_pplace") < F.struct(*_PLACE)), F.concat(F.lit("> "), clip_line(F.col("_pline"), LINE_RUNES)))
    return r, [parent, *[F.col(f"_lead{k}") for k in range(LEAD_LINES, 0, -1)]]


def keyed(units: DataFrame, suffix: str = "|unit") -> DataFrame:
    """``units`` with their key in the deduplication state."""
    return units.withColumn("dedup_key", F.concat("id", F.lit(suffix)))


def pending(units: DataFrame, state: DataFrame | None, suffix: str = "|unit") -> DataFrame:
    """Units whose key (id and ``suffix``) and hash are not in the deduplication state (dedup_key, content_hash); an empty id or hash is never in it."""
    mine = units if "dedup_key" in units.columns else keyed(units, suffix)
    if state is None:
        return mine
    known = state.where("dedup_key <> '' AND content_hash <> ''").select(F.col("dedup_key").alias("_key"), F.col("content_hash").alias("_hash"))
    same = F.array_contains(F.array("_hash"), F.col("content_hash"))  # no key of the join, so that units that lie by their key aren't shuffled again
    return mine.join(known, (F.col("dedup_key") == F.col("_key")) & same, "left_anti")


class Tokenizer(Protocol):
    """What clips queries by tokens and counts them."""

    def tokenize(self, text: str) -> list[int]: ...

    def detokenize(self, ids: list[int]) -> str: ...


def counter(tokenizer: Tokenizer) -> Callable[[str], int]:
    return lambda text: len(tokenizer.tokenize(text))


def clip_tokens(text: str, most: int, tokenizer: Tokenizer) -> str:
    """The text of its first ``most`` tokens; a text that has no more is as it was."""
    ids = tokenizer.tokenize(text)
    return text if len(ids) <= most else tokenizer.detokenize(ids[:most])


def words(text: str) -> int:
    return len(text.split())


def split_tokens(text: str, most: int, count: Callable[[str], int] = words, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``most`` tokens that share up to ``overlap`` with the one before and prefer to end after a new line.

    ``count`` may only grow with its text's length. Bounds are found by doubling steps and halving, so a chunk costs tokens in proportion to its own length.
    """

    def longest(fits: Callable[[int], bool], limit: int) -> int:
        """The largest n up to ``limit`` with fits(n), or 0."""
        low, step = 0, 256
        while low < limit and fits(min(limit, low + step)):
            low, step = min(limit, low + step), 2 * step
        high = min(limit, low + step)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if fits(mid) else (low, mid - 1)
        return low

    if len(text) <= SHORT and count(text) <= most:
        return [text]
    out, start, size = [], 0, len(text)
    while True:
        n = longest(lambda k: count(text[start : start + k]) <= most, size - start)
        if start + n >= size:
            return out + [text[start:]]
        end = start + max(1, n)
        line = text.rfind("\n", start + (end - start) * 3 // 4, end)
        end = line + 1 if line >= 0 else end
        out.append(text[start:end])
        back = longest(lambda k: count(text[end - k : end]) <= overlap, end - start)
        start = end - back if back < end - start else end


def chunks(units: DataFrame, count: Callable[[str], int] = words, most: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each chunk of a unit: its header and a window of its body; content_hash is the window's."""
    bounded_batches(units.sparkSession, ROWS, BYTES)

    def cut(heads: pa.Array, bodies: pa.Array) -> pa.Array:
        out = []
        for head, body in zip(heads.to_pylist(), bodies.to_pylist()):
            budget = max(most - count(head) - 1, 2 * OVERLAP) if head else most
            out.append(split_tokens(body or "", budget, count))
        return pa.array(out, pa.list_(pa.string()))

    wide = [c for c in units.columns if c not in ("id", "text", "header", "body", "content_hash", "dedup_key", "chunk_index", "chunk_count")]
    parts = units.select("*", F.arrow_udf(cut, "array<string>")("header", "body").alias("_parts"))
    each = parts.select(F.col("id").alias("message_id"), "header", *wide, F.size("_parts").cast("long").alias("chunk_count"), F.posexplode("_parts").alias("_i", "window"))
    return each.select(
        F.concat_ws("#", "message_id", F.col("_i").cast("string")).alias("id"), "message_id", F.col("_i").cast("long").alias("chunk_index"), "chunk_count",
        F.when(F.col("header") == "", F.col("window")).otherwise(F.concat_ws("\n", "header", "window")).alias("text"),
        content_hash(F.col("window")).alias("content_hash"), *wide,
    )


def hashed_vectors(dims: int = 384) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests and offline use: signed counts of hashed words, of length one."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    return embed


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dims: int = 384, batch: int = 32, prefix: str = "", text: str = "text", clip: int = 0) -> DataFrame:
    """``rows`` with ``vector``, from ``embedder`` in batches of ``batch``; a vector of another length is an error. ``clip``: at most so many characters of a text are embedded."""
    bounded_batches(rows.sparkSession, ROWS, BYTES)

    def run(column: pa.Array) -> pa.Array:
        texts = [prefix + (t or "") for t in column.to_pylist()]
        return pa.array([v for i in range(0, len(texts), batch) for v in _embedded(texts[i : i + batch], embedder, dims)], pa.list_(pa.float32()))

    return rows.withColumn("vector", F.arrow_udf(run, "array<float>")(clip_chars(F.col(text), clip)))


def embed_apart(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dims: int = 384, batch: int = 32, prefix: str = "", text: str = "text", clip: int = 0) -> DataFrame:
    """``embed``, but a text that can't be embedded fails alone: ``vector`` is null then and ``error``, null else, says why. A batch that fails is halved until the texts to blame are found."""
    bounded_batches(rows.sparkSession, ROWS, BYTES)

    def each(texts: list[str]) -> list[dict]:
        try:
            return [{"vector": v, "error": None} for v in _embedded(texts, embedder, dims)]
        except Exception as e:
            if len(texts) == 1:
                return [{"vector": None, "error": str(e)[:ERROR] or type(e).__name__}]
        half = len(texts) // 2
        return each(texts[:half]) + each(texts[half:])

    def run(column: pa.Array) -> pa.Array:
        texts = [prefix + (t or "") for t in column.to_pylist()]
        found = [v for i in range(0, len(texts), batch) for v in each(texts[i : i + batch])]
        return pa.array(found, pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())]))

    made = rows.withColumn("_v", F.arrow_udf(run, "vector array<float>, error string")(clip_chars(F.col(text), clip)))
    return made.withColumns({"vector": F.col("_v.vector"), "error": F.col("_v.error")}).drop("_v")


def _embedded(texts: list[str], embedder: Callable[[list[str]], list[list[float]]], dims: int) -> list[list[float]]:
    found = embedder(texts)
    if len(found) != len(texts) or any(len(v) != dims for v in found):
        raise ValueError(f"the embedder must give one vector of {dims} numbers for each text")
    return found
