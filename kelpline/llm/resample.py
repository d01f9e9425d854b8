"""Importance resampling towards a target: documents are drawn whose hashed n-grams resemble a target corpus.

Method: every feature (a run of 1 to ``n`` consecutive words) falls into one of ``buckets``; a bucket's gain is the log ratio of its smoothed
shares in the target and in the documents. A text is read in chunks that end at word boundaries and carry the next n - 1 words; a chunk owns the
features that start in its own words, so each feature counts once. A chunk brings one row of counts and weight, and these are summed by document: nothing as
long as a text is held besides the text itself. Scores get Gumbel noise from a hash of the id, which makes the highest scores a draw
without replacement; ranks come from a sort by ranges, so no task sees all documents.

Defined cases: a null or empty text has no features and weight 0; a null id draws its noise as an empty string; rows that repeat an id are documents of
their own with the same noise, ordered by weight and counts where scores tie. Without documents the result is empty; without a target all shares of it are alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_batches, cut, fresh

BUCKETS, CHUNK = 10_000, 1 << 16
#: Letters lower-cased, all other ASCII but digits made blanks.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def chunks(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them the chunk owns): the words after the owned ones are the first n - 1 of what follows."""
    held: list[bytes] = []
    pos = 0
    while pos < len(text):
        end = min(len(text), pos + size)
        if end < len(text):  # to the end of a word, wherever that is
            while end < len(text) and _PLAIN[text[end]] != 0x20:
                end += 1
        held += text[pos:end].translate(_PLAIN).split()
        pos = end
        own = len(held) - (n - 1) * (pos < len(text))
        if own > 0:
            yield held, own
            held = held[own:]


def features(words: list[bytes], own: int, n: int) -> np.ndarray:
    """Sums of the features that start in the owned words."""
    parts = [np.fromiter(map(zlib.crc32, words[:own]), np.uint32, own)]
    for k in range(2, n + 1):
        last = min(own, len(words) - k + 1)
        parts.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) for i in range(last)), np.uint32, max(0, last)))
    return np.concatenate(parts)


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all of ``texts`` (text); a task counts before the shuffle."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words, own in chunks(text or b"", n):
                    total += np.bincount(features(words, own, n) % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.record_batch({"bucket": seen, "n": total[seen]})

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; as many numbers as ``buckets``, however large the tables."""
    own, wanted = bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, rows in ((s, own), (t, wanted)):
        for r in rows.collect():
            into[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """``docs`` without text but with n_words, n_features and weight, which replace columns of the same names."""
    bounded_batches(docs.sparkSession)
    added = ("n_words", "n_features", "weight")
    row, rest = fresh(docs, "row", "rest")
    kept = [c for c in docs.columns if c != "text" and c.lower() not in added]
    read = docs.select(
        F.monotonically_increasing_id().alias(row), F.struct(F.lit(None).cast("int").alias("first"), *[F.col(f"`{c}`") for c in kept]).alias(rest), F.col("text").cast("binary").alias("text")
    )
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                at.append(i)
                counts.append((0, 0, 0))
                for k, (words, own) in enumerate(chunks(text or b"", n)):
                    f = features(words, own, n)
                    if k:
                        at.append(i)
                        counts.append((0, 0, 0))
                    counts[-1] = (own, len(f), int(table.value[f % len(table.value)].sum()))
            at, counts = np.array(at, np.int64), np.array(counts, np.int64).reshape(-1, 3)
            # the other columns go with a document's first chunk alone
            first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            other = pa.array(np.where(first, at, -1), pa.int64(), mask=~first)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), batch.column(1).take(other), *counts.T.copy()], names=[row, rest, *added])

    kind = read.select(row).schema.add(rest, read.schema[rest].dataType, True)
    for name in added:
        kind = kind.add(name, "long")
    sums = read.mapInArrow(run, kind).groupBy(row).agg(F.first(rest, ignorenulls=True).alias(rest), *[F.sum(c).alias(c) for c in added])
    return sums.select(*[F.col(rest)[c].alias(c) for c in kept], *added)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``weighed`` with score and rank: the ``percent`` highest scores among documents of ``min_words`` or more are ranked from 1, the others have null."""
    may, at, part = fresh(weighed, "may", "at", "part")
    order = [F.desc(may), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    scored = weighed.withColumns({"score": (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"), may: F.col("n_words") >= min_words})
    ranged = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged")
    # a position is the partition's number and the place in it; what stands before a partition is known from the partitions' sizes
    sizes = ranged.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count("*").alias("n"), F.count_if(may).alias("may")).orderBy(part).collect()
    before, total, most = {}, 0, sum(r["may"] for r in sizes) * percent // 100
    for r in sizes:
        before[r[part]] = total
        total += r["n"]
    if not before:
        return ranged.withColumn("rank", F.lit(None).cast("long")).drop(may, at)
    first = F.create_map(*[F.lit(x) for p in before.items() for x in p])
    rank = first[F.shiftright(at, 33)] + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return ranged.withColumn("rank", F.when(F.col(may) & (rank <= most), rank).cast("long")).drop(may, at)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and others) without text, with n_words, n_features, weight, score and rank; drawn are those with a rank."""
    return draw(weigh(docs, gains(docs.select("text"), target.select("text"), n, buckets), n), seed, percent, min_words)
