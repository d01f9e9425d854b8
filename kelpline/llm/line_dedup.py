"""Line dedup: lines that stand in many documents are dropped from all of them.

Method: explode normalised lines, hash, count distinct documents for each hash, drop lines over the threshold,
reassemble by position. A document is a row of the table: repeated rows count each. Counting needs only a digest for each
distinct line of a document (pre-aggregated before the shuffle); the reassembling shuffle is keyed by row, so
no line however common gathers in one task.

Defined cases: a null or empty text is one empty line; its key is empty and never counted, so it stays and a null text becomes
empty. Lines keep their order and repeats. Other columns keep their values; an ``n_chars`` column follows the new text in ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import ascii_lower, cut, fresh

#: The white space that a line's key loses at both ends.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(digest): keys of at least ``min_chars`` code points that stand in ``min_docs`` or more documents."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    lines = docs.select(F.explode(F.array_distinct(keys)).alias("k")).where(F.char_length("k") >= min_chars)
    return lines.groupBy(_digest(F.col("k")).alias("digest")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("digest")


def _reassembled(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, dict[str, Column]]:
    """The rebuilt documents, and columns to select from them: the old ones but text, and _kept, _n and _dropped."""
    row, pos, line, digest, rest, hot, n = fresh(docs, "row", "pos", "line", "digest", "rest", "hot", "n")
    # the other columns travel once for each document, with its first line; rows are numbered before lines are exploded
    numbered = docs.select(
        F.monotonically_increasing_id().alias(row),
        F.struct(F.lit(0).alias(pos), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(rest),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias(line),
    )
    parts = numbered.select(row, rest, F.posexplode(line).alias(pos, line))
    parts = parts.select(row, F.when(F.col(pos) == 0, F.col(rest)).alias(rest), pos, line, _digest(line_key(F.col(line))).alias(digest))
    # as a written table it leaves a plain join, of which a very common line can be split
    dropped = cut(common_lines(docs, min_docs, min_chars), "common-lines").select(F.col("digest").alias(digest), F.lit(True).alias(hot))
    marked = parts.join(dropped, digest, "left").select(row, rest, F.when(F.col(hot).isNull(), F.struct(pos, line)).alias(line))
    whole = marked.groupBy(row).agg(F.first(rest, ignorenulls=True).alias(rest), F.collect_list(line).alias(line), F.count("*").alias(n))
    kept = F.array_join(F.transform(F.array_sort(line), lambda x: x[line]), "\n")
    old = {c: F.col(rest)[c] for c in docs.columns if c != "text"}
    return whole, old | {"text": kept, "_n": F.col(n).cast("long"), "_dropped": (F.col(n) - F.size(line)).cast("long")}


def split_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with text cut down to what stays, n_lines (before) and n_dropped; these replace columns of the same names."""
    whole, c = _reassembled(docs, min_docs, min_chars)
    n, dropped = c.pop("_n"), c.pop("_dropped")
    return whole.select(*[v.alias(k) for k, v in (c | {"n_lines": n, "n_dropped": dropped}).items()])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the lines found in many documents gone from ``text``; the columns and their order stay."""
    whole, c = _reassembled(docs, min_docs, min_chars)
    out = whole.select(*[c[k].alias(k) for k in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
