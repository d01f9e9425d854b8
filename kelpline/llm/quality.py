"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, learned from trusted text.

Method: every n-gram of the trusted texts up to ``ORDER`` is counted (tasks count before the shuffle), lower orders get continuation
counts, discounts come from the counts of counts, and probabilities are built order by order by joining the
count tables on n-gram digests. The model is written as digest-sharded, sorted tables to the shared folder; a scoring
task joins a batch's n-grams of all orders with one group of shards after another, each read once for a batch, and there are as many shards as keep a group within
``KEEP_BYTES``, so a task's memory is bounded. A document is rejected if its perplexity is above a quantile of the perplexities of trusted texts in its language; these are a tenth of the
trusted documents, by hash of their id, that the model has not learned from, since texts it knows would set the bound too low.

Defined cases: a null or empty text has no perplexity and is rejected; a language without trusted text, or null, is held against the quantile
over all languages; if no trusted text is left out, all of them are both learned from and held against; without any trusted text nothing is rejected but empty texts. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_batches, cut, fresh, shared_dir

ORDER, SHARDS, KEEP_BYTES = 5, 16, 128 << 20
#: Bytes of a model's row in memory, at most: a key, a value and a mark in tables that are a quarter full at least.
ROW_BYTES = 4 * 13
START = 1  # code of the padding before a text
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    """Characters of the padded text."""
    return np.frombuffer(("\1" * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)


def digests(text: str) -> list[np.ndarray]:
    """For n = 0..ORDER the digests of the n-grams that begin at each position of the padded text."""
    codes = _codes(text).astype(np.uint64)
    out = [np.zeros(len(codes) + 1, np.uint64)]
    for n in range(1, ORDER + 1):
        out.append(_mix(out[-1][: len(codes) - n + 1] * _P + codes[n - 1 :] + np.uint64(n)))
    return out


def _squeeze(rows: np.ndarray) -> np.ndarray:
    """Rows (first characters, last characters, count) with equal n-grams added up."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    starts = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
    return np.stack([rows[0, starts], rows[1, starts], np.add.reduceat(rows[2], starts)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest n-grams, kept as characters: a has all but the last three, b those three, 21 bits each."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                codes, n = _codes(text).astype(np.int64), len(text)
                a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k in range(ORDER):
                    part = a if k < ORDER - 3 else b
                    part[:] = part << 21 | codes[k : k + n]
                held.append(np.stack([a, b, np.ones(n, np.int64)]))
                size += n
            if size > 1_000_000:
                held, size = [_squeeze(np.concatenate(held, axis=1))], 0
    if held:
        rows = _squeeze(np.concatenate(held, axis=1))
        for lo in range(0, rows.shape[1], 50_000):
            yield pa.record_batch(dict(zip("abk", rows[:, lo : lo + 50_000])))


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted longest n-grams as digests, and the shorter ones, which are their ends and of which lower orders only need that they exist.

    g, c, s: digests of an n-gram, of its first n - 1 characters and of its last n - 1."""
    mask = np.int64((1 << 21) - 1)

    def orders(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = [((a >> 21 * (ORDER - 4 - i) if i < ORDER - 3 else b >> 21 * (ORDER - 1 - i)) & mask).astype(np.uint64) for i in range(ORDER)]

        def digest(first: int, n: int) -> np.ndarray:
            h = np.zeros(len(a), np.uint64)
            for i in range(n):
                h = _mix(h * _P + codes[first + i] + np.uint64(i + 1))
            return h.view(np.int64)

        s = digest(ORDER, 0)
        for n in range(1, ORDER + 1):
            g = digest(ORDER - n, n)
            _, first = np.unique(g, return_index=True)
            c, own = digest(ORDER - n, n - 1), k if n == ORDER else np.zeros_like(k)
            for lo in range(0, len(first), 50_000):
                at = first[lo : lo + 50_000]
                yield pa.record_batch({"n": pa.array(np.full(len(at), n, np.int32)), "g": g[at], "c": c[at], "s": s[at], "k": own[at]})
            s = g

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > 500_000:
            yield from orders(*(pa.Table.from_batches(held).column(x).to_numpy() for x in "abk"))
            held = []
    if held:
        yield from orders(*(pa.Table.from_batches(held).column(x).to_numpy() for x in "abk"))


@contextmanager
def _bloom_filter(spark: SparkSession) -> Iterator[None]:
    """Plans made here sieve the large side of a semi-join by a Bloom filter of 8 MB before the shuffle; the join itself stays exact."""
    size = "spark.sql.optimizer.runtime.bloomFilter."
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", size + "enabled": "true", size + "creationSideThreshold": "1t", size + "applicationSideScanSizeThreshold": "0",
        size + "expectedNumItems": "4000000", size + "numBits": str(1 << 26),
    }
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def train(trusted: DataFrame) -> tuple[str, int, int] | None:
    """Learn from ``trusted`` (text); (folder of the model, number of characters known, number of its shards), or None if there is no text.

    Model rows: shard, kind (n for the log probability of a seen n-gram, ORDER + n for the log back-off weight of a context of n), g, v.
    """
    spark = trusted.sparkSession
    kinds = "n int, g long, c long, s long, k long"
    with _bloom_filter(spark):
        longest = cut(trusted.select("text").mapInArrow(_count, "a long, b long, k long").groupBy("a", "b").agg(F.sum("k").alias("k")), "longest")
    raw = cut(longest.mapInArrow(_orders, kinds).groupBy("n", "g").agg(F.sum("k").alias("k"), F.first("c").alias("c"), F.first("s").alias("s")), "grams")
    more = raw.where(F.col("n") > 1).groupBy((F.col("n") - 1).alias("n"), F.col("s").alias("g")).agg(F.count("*").alias("cont"))
    counts = raw.join(more, ["n", "g"], "left").select("n", "g", "c", "s", F.when(F.col("n") == ORDER, F.col("k")).otherwise(F.coalesce("cont", F.lit(1))).alias("k"))
    counts = cut(counts, "counts")
    of = {r["n"]: r for r in counts.groupBy("n").agg(*[F.sum((F.col("k") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)], F.count("*").alias("all")).collect()}
    if not of:
        return None
    known = of[1]["all"] + 1

    def discounts(n: int) -> list[float]:
        n1, n2, n3, n4 = (max(1, of[n][f"n{i}"]) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        return [min(i - 0.05, max(0.1, d)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]

    out = shared_dir(spark, "quality-model")
    lower, parts = None, []
    for n in range(1, ORDER + 1):
        d = discounts(n)
        own = counts.where(F.col("n") == n)
        cutoff = F.when(F.col("k") == 1, d[0]).when(F.col("k") == 2, d[1]).otherwise(d[2])
        contexts = own.groupBy("c").agg(F.sum("k").alias("z"), F.sum(cutoff).alias("gamma"))
        rows = own.join(contexts, "c").select("g", "s", ((F.col("k") - cutoff) / F.col("z")).alias("p"), (F.col("gamma") / F.col("z")).alias("w"))
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / known))
        else:
            rows = rows.join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s", "left").withColumn("q", F.coalesce("q", F.lit(1e-9)))
        lower = cut(rows.select("g", (F.col("p") + F.col("w") * F.col("q")).alias("p")), "probabilities")
        parts += [lower.select(F.lit(n).alias("kind"), "g", F.log("p").alias("v")), contexts.select(F.lit(ORDER + n - 1).alias("kind"), F.col("c").alias("g"), F.log(F.col("gamma") / F.col("z")).alias("v"))]
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    # a row for each n-gram and for each context, of which there are no more; shards are even, as digests are
    shards = max(SHARDS, 3 * ROW_BYTES * sum(x["all"] for x in of.values()) // KEEP_BYTES)
    shard = F.pmod("g", F.lit(shards)).cast("int")
    model.select(shard.alias("shard"), F.col("kind").cast("byte").alias("kind"), "g", F.col("v").cast("float").alias("v")).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "g").write.partitionBy("shard").parquet(out)
    return out, known, shards


class _Table:
    """Digests to values by open addressing, built and probed on whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.used = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        left, step = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(left):
            at = (slot[left] + step) & self.mask
            _, first = np.unique(at, return_index=True)
            first = first[~self.used[at[first]]]
            put, to = left[first], at[first]
            self.keys[to], self.values[to], self.used[to] = keys[put], values[put], True
            left = np.delete(left, first)
            step += 1
        self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _P) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, out: np.ndarray, where: np.ndarray | None = None) -> None:
        """Put the values of known keys in ``out``."""
        slot = self._slot(keys)
        left = None
        for step in range(self.steps):
            at = slot if left is None else (slot[left] + step) & self.mask
            mine = keys if left is None else keys[left]
            same = (self.keys[at] == mine) & self.used[at]
            hit = np.flatnonzero(same)
            to = hit if left is None else left[hit]
            out[to if where is None else where[to]] = self.values[at[hit]]
            more = np.flatnonzero(~same & self.used[at])
            left = more if left is None else left[more]
            if not len(left):
                return


class Model:
    """Looks n-grams up, one group of shards at a time; a model within ``KEEP_BYTES`` is one group and stays in memory."""

    def __init__(self, folder: str, known: int, shards: int = SHARDS):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.known, self.shards, self.loads = known, shards, 0
        found = self.fs.get_file_info(pa.fs.FileSelector(self.root, recursive=True))
        files = [(int(f.path.rsplit("/shard=", 1)[1].split("/")[0]), f.path) for f in found if f.path.endswith(".parquet")]
        rows = sum(pa.parquet.read_metadata(p, filesystem=self.fs).num_rows for _, p in files)
        self.groups = -(-shards // min(shards, max(1, KEEP_BYTES * shards // max(1, rows * ROW_BYTES))))
        self.files = [[p for i, p in files if i % self.groups == k] for k in range(self.groups)]
        self.resident = self._load(0) if self.groups == 1 else None

    def _load(self, group: int) -> dict[int, _Table]:
        self.loads += 1
        tables = [pa.parquet.read_table(f, filesystem=self.fs, columns=["kind", "g", "v"], partitioning=None) for f in self.files[group]]
        if not tables:
            return {}
        t = pa.concat_tables(tables)
        kind, g, v = (t.column(c).to_numpy() for c in ("kind", "g", "v"))
        return {k: _Table(g[kind == k], v[kind == k]) for k in np.unique(kind).tolist()}

    def find(self, kind: int, g: np.ndarray) -> np.ndarray:
        """Values of digests, NaN where there is none, of a model that is in memory."""
        out = np.full(len(g), np.nan, np.float32)
        if kind in self.resident:
            self.resident[kind].find(g.view(np.int64), out)
        return out

    def find_all(self, wanted: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Values of digests of several kinds, NaN where there is none; each group of shards is read once."""
        out = [np.full(len(g), np.nan, np.float32) for _, g in wanted]
        for i in range(self.groups):
            tables = self._load(i)
            for (kind, g), values in zip(wanted, out):
                signed = g.view(np.int64)
                at = np.flatnonzero(signed % self.shards % self.groups == i)
                if kind in tables:
                    tables[kind].find(signed[at], values, at)
        return out

    def log_probability(self, texts: list[str | None]) -> list[float | None]:
        """Sum of log probabilities of each text's characters."""
        d = [digests(t) if t else None for t in texts]
        sizes = [len(t) if t else 0 for t in texts]

        def level(n: int, shift: int) -> np.ndarray:
            """n-grams that end at each character, or with shift 1 the contexts before it."""
            parts = [x[n][ORDER - n - shift : ORDER - n - shift + k] for x, k in zip(d, sizes) if k]
            return np.concatenate(parts) if parts else np.array([], np.uint64)

        total = sum(sizes)
        if not total:
            return [None] * len(texts)
        every: list[np.ndarray] = []
        if self.resident is None:
            levels = [(kind, level(size, shift)) for n in range(ORDER, 0, -1) for kind, size, shift in ((n, n, 0), (ORDER + n - 1, n - 1, 1))]
            every = self.find_all(levels)
        score, weight = np.zeros(total), np.zeros(total)
        open_ = np.arange(total)  # characters whose probability isn't known yet
        for n in range(ORDER, 0, -1):
            p = every[2 * (ORDER - n)][open_] if every else self.find(n, level(n, 0)[open_])
            got = ~np.isnan(p)
            score[open_[got]] = p[got]
            open_ = open_[~got]
            if not len(open_):
                break
            w = every[2 * (ORDER - n) + 1][open_] if every else self.find(ORDER + n - 1, level(n - 1, 1)[open_])
            weight[open_] += np.where(np.isnan(w), 0.0, w)
        if len(open_):
            score[open_] = -np.log(self.known)
        score += weight
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(score)])
        return [float(sums[e] - sums[e - k]) if k else None for e, k in zip(ends.tolist(), sizes)]


def with_perplexity(docs: DataFrame, model: tuple[str, int], name: str = "perplexity") -> DataFrame:
    """``docs`` with each text's perplexity per character."""
    bounded_batches(docs.sparkSession)
    held: list[Model] = []

    def run(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Model(*model))
        out: list[float | None] = []
        texts: list[str | None] = []
        size = 0
        for t in [*column.to_pylist(), ...]:
            if t is ... or size > 500_000:
                for x, p in zip(texts, held[0].log_probability(texts)):
                    out.append(None if p is None else float(np.exp(min(700.0, -p / len(x)))))
                texts, size = [], 0
            if t is not ...:
                texts.append(t)
                size += len(t or "")
        return pa.array(out, pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col("text")))


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text) of the documents that the labels call good. Labels grow with the corpus, so neither side is broadcast."""
    return docs.select("doc_id", "text").hint("merge").join(labels, "doc_id", "left_semi").select("text")


def _left_out() -> Column:
    """Whether a trusted document serves for the quantiles."""
    return F.pmod(F.xxhash64("doc_id", F.lit("quantiles")), F.lit(10)) == 0


def _good(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, lang) without the columns ``drop`` but with perplexity, max_perplexity and keep, which replace same-named columns.

    ``labels`` (doc_id, quality) name the trusted documents: quality 1. The scored rows are written once, for the quantiles and the result.
    """
    bounded_batches(docs.sparkSession)
    good = _good(labels)
    model = train(trusted_text(docs, good.where(~_left_out())))
    measured = good.where(_left_out())
    if model is None or docs.join(measured, "doc_id", "left_semi").where(F.length("text") > 0).isEmpty():
        model, measured = train(trusted_text(docs, good)), good
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"perplexity": none, "max_perplexity": none, "keep": F.coalesce(F.length("text") > 0, F.lit(False))}).drop(*drop)
    lang, high = fresh(docs, "lang", "high")
    scored = cut(with_perplexity(docs, model).drop(*drop), "scored")
    own = scored.join(measured, "doc_id", "left_semi").where(F.col("perplexity").isNotNull())
    bounds = cut(own.rollup("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("hi"), F.grouping("lang").alias("whole")), "bounds")
    whole = bounds.where("whole = 1").first()["hi"]
    by_lang = bounds.where("whole = 0 and lang is not null").select(F.col("lang").alias(lang), F.col("hi").alias(high))
    most = F.coalesce(F.col(high), F.lit(whole))
    out = scored.join(by_lang, F.col("lang") == F.col(lang), "left")
    return out.withColumns({"max_perplexity": most, "keep": F.coalesce(F.col("perplexity") <= most, F.lit(False))}).drop(lang, high)
