"""Filter interaction audit: what each filter of a sequence removes, in every order of the filters.

Method: a batch's text is one Arrow buffer. Byte classes looked up by NumPy, and prefix sums over them, count words, capitals, code points and symbols of
every document at once. Distinct words come from a sort of (document, word hash), where a word's hash is a difference of prefix sums of
a polynomial; words of equal hash are compared byte by byte, and a document in which two differ is counted by a set instead. Each document becomes a mask
of the filters that it fails; masks are counted by part, and all orders are computed from these 2^k counts, so no row of the corpus is read twice.

Defined cases: a null text is empty, a null part an empty string. A row is a document; a repeat is told by a smaller id with the same text, so rows with one id and
one text are no repeats of each other, and a null id neither repeats nor is repeated. Several labels of one id count if any of them says so. An empty table gives no rows.
A text needs some twenty times its size in memory, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_batches, cut, fresh, text_key

FILTERS = "ABCDE"
BLOCK, MOST_DOCS = 2 << 20, 1 << 10
#: The characters that separate words, and those that count as symbols.
BLANKS, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
_SPACE, _UPPER, _SYMBOL, _LEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] |= _SPACE
_CLASS[0x41:0x5B] |= _UPPER
_CLASS[list(SYMBOLS)] |= _SYMBOL
_CLASS[:0x80] |= _LEAD
_CLASS[0xC0:] |= _LEAD
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``size`` bytes that begin at a and b are the same, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = np.ones(len(a), bool)
    left, k = np.arange(len(a)), 0
    while len(left):
        rest = size[left] - k
        keep = np.where(rest >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(rest, 7) * 8).astype(np.uint64)) - np.uint64(1))
        out[left] &= ((eight[a[left] + k] ^ eight[b[left] + k]) & keep) == 0
        k += 8
        left = left[(rest > 8) & out[left]]
    return out


def scan(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for texts that lie one after another in ``data``, at most ``MOST_DOCS`` of them."""
    docs = len(bounds) - 1
    kind = _CLASS[data]

    def total(bit: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((kind & bit) != 0, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    inside = (kind & _SPACE) == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    firsts = np.searchsorted(starts, bounds)
    words = np.diff(firsts)
    doc = np.repeat(np.arange(docs), words)
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    key = doc.astype(np.uint64) << np.uint64(54) | h >> np.uint64(10)
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[again], order[again + 1]
    size = ends - starts
    same = size[a] == size[b]
    same[same] = _equal(data, starts[a[same]], starts[b[same]], size[a[same]])
    distinct = words - np.bincount(doc[a], minlength=docs)
    for i in set(doc[a[~same]].tolist()):  # two words with one hash
        distinct[i] = len({data[s:e].tobytes() for s, e in zip(starts[firsts[i] : firsts[i + 1]].tolist(), ends[firsts[i] : firsts[i + 1]].tolist())})
    return {"n_words": words, "n_distinct": distinct, "n_upper": total(_UPPER), "n_symbols": total(_SYMBOL), "n_points": total(_LEAD)}


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins; a null is empty."""
    column = column.fill_null(b"") if column.null_count else column
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


COUNTS = ("n_words", "n_distinct", "n_upper", "n_symbols", "n_points")


def count_texts(docs: DataFrame) -> DataFrame:
    """``docs`` without text but with n_words, n_distinct, n_upper, n_symbols and n_points (code points), which replace columns of the same names."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text" and c.lower() not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _buffers(batch.column(batch.num_columns - 1))
            lo, n = 0, batch.num_rows
            while lo < n:
                hi = int(np.searchsorted(bounds, bounds[lo] + BLOCK, "right")) - 1
                hi = min(n, lo + MOST_DOCS, max(lo + 1, hi))
                found = scan(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                yield pa.record_batch([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=[*kept, *COUNTS])
                lo = hi

    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("binary").alias("text"))
    kind = read.drop("text").schema
    for name in COUNTS:
        kind = kind.add(name, "long")
    return read.mapInArrow(run, kind)


def fail_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask): bit i of the mask is set if filter i of ``FILTERS`` rejects the document."""
    key, least, n = fresh(docs, "key", "least", "n")
    counted = cut(count_texts(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_key(F.coalesce("text", F.lit(""))).alias(key), "text")), "counted")
    # only texts that stand in several rows are joined; as a written table it leaves a plain join, of which a group of many copies can be split
    copies = cut(counted.groupBy(key).agg(F.min("doc_id").alias(least), F.count("*").alias(n)).where(F.col(n) > 1).drop(n), "copies")
    fails = [
        F.col("n_words") < 50,
        100 * F.col("n_distinct") < 65 * F.col("n_words"),
        100 * F.col("n_upper") > 5 * F.col("n_points"),
        F.col("n_symbols") > 0,
        F.coalesce(F.col("doc_id") > F.col(least), F.lit(False)),
    ]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return counted.join(copies, key, "left").select("doc_id", "part", mask.alias("mask"))


def _sum_where(counts: Column, masks: int, keep) -> Column:
    """Sum of the counts whose mask meets ``keep``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(masks - 1)), F.lit(0).cast("long"), lambda total, m: total + F.when(keep(m), F.get(counts, m)).otherwise(0))


def audit(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part's figures of every step of every order of ``filters``, from ``masks`` (doc_id, part, mask) and ``labels`` (doc_id, quality, toxic)."""
    k = len(filters)
    size = 1 << k
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    at = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for c in ("n", "good", "toxic") for m in range(size)]
    parts = rows.groupBy("part").agg(*[F.array(*at[i * size : (i + 1) * size]).alias(c) for i, c in enumerate(("n", "good", "toxic"))])
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    own, before = F.lit(0), F.lit(0)
    for i, f in enumerate(filters):
        place = F.instr("filter_order", f)
        own = own + F.when(place == F.col("step"), 1 << i).otherwise(0)
        before = before + F.when(place < F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumns({"own": own, "before": before})
    fails, earlier = (lambda m: m.bitwiseAND(F.col("own")) > 0), (lambda m: m.bitwiseAND(F.col("before")) > 0)
    here = lambda m: fails(m) & ~earlier(m)
    n, good, toxic = F.col("n"), F.col("good"), F.col("toxic")
    # of all orders, a document that fails j filters is removed by each of them in a j-th
    orders_of = F.lit(int(np.prod(range(1, k + 1))))
    share = F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda total, m: total + F.when(fails(m), F.get(n, m) * (orders_of / F.bit_count(m)).cast("long")).otherwise(0)
    )
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        _sum_where(n, size, lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _sum_where(n, size, here).alias("removed"),
        _sum_where(n, size, lambda m: fails(m) & earlier(m)).alias("redundant"),
        _sum_where(n, size, lambda m: m == F.col("own")).alias("unique_fails"),
        _sum_where(good, size, here).alias("good_lost"),
        _sum_where(toxic, size, here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text and the column named by ``part``)."""
    return audit(fail_masks(docs, part), labels)
