"""Benchmark decontamination: which words of a document stand inside a benchmark passage.

Method: prefix-filtered set join. A benchmark item is cut into windows of ``window`` consecutive words (an item
of fewer words is one window); equal windows of several items are one. The tokens of a window are its shingles of five words. Containment must be total,
so one token, the rarest in the corpus, is a sufficient prefix. Documents are probed with the prefix tokens only; where one stands, the
item-sized stretch of words around it goes on, and there a positional and a length bound must leave room for the window before its words are compared.

Native: DataFrame functions only. A document's words are split once, exploded, hashed and probed inside one
fused stage, so what is shuffled are places with at most ``2 * window`` words each, and the work is linear in a text's length. Places are
keyed by the text's digest: copies share one result, and nothing depends on doc_id being unique.

What is broadcast are distinct token hashes of eight bytes, at most ``BLOCK_KEYS`` at a time; a larger benchmark is probed in up to ``PASSES`` passes over the
documents, one larger than that by a shuffle of the documents' tokens. Windows meet places in a join that the planner broadcasts only if they are small.

Defined cases: a null text has no words; a null item_id or an item without words is left out; equal item_ids
in several rows count once; repeated document rows each get their own result row; an empty benchmark or documents
table gives no hits; other columns are kept out of the way of internal names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import cut, fresh, own_words, raw_words, row_key, text_key

#: Words of a prefix token; a window of fewer words is a token by itself.
SHINGLE = 5
#: Distinct tokens that one pass over the documents broadcasts, and passes before the documents' tokens are shuffled instead.
BLOCK_KEYS, PASSES = 2_000_000, 16


def _key(words: Column, at: Column, size: int) -> Column:
    """Digest of ``size`` words from the 0-based position ``at``; null where they don't all exist."""
    parts = [F.get(words, at + i) for i in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def _members(benchmark: DataFrame, window: int) -> DataFrame:
    """(wid, words, item_id): each item's windows; wid is their words' digest."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), own_words(F.col("text")).alias("all")).where(F.col("item_id").isNotNull() & (F.size("all") > 0))
    length = F.least(F.size("all"), F.lit(window))
    each = items.select("item_id", "all", length.alias("n"), F.explode(F.sequence(F.lit(0), F.size("all") - length)).alias("start"))
    words = each.select("item_id", F.slice("all", F.col("start") + 1, F.col("n")).alias("words"))
    return words.select(text_key(F.array_join("words", " ")).alias("wid"), "words", "item_id").distinct()


def _tokens(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(wid, words, at, key): every token of every window, hashed as the documents' are."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    each = windows.select("wid", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    return each.withColumn("key", F.coalesce(*[F.when(size == k, _key(F.col("words"), F.col("at"), k)) for k in sizes]))


def _probe(docs: DataFrame, sizes: list[int], window: int = 0) -> DataFrame:
    """One row for each word position and token size of a document: its key, and with a ``window`` the text's digest (doc), pos, and from the word ``first`` on the words
    ``near`` that a window around it may have.

    The digest and the words are made before the explode, so once for each text. The outer explode keeps Catalyst
    from computing the words a second time for a size filter."""
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    keep = ["doc", "pos", first.alias("first"), F.slice("all", first + 1, F.lit(2 * window)).alias("near")] if window else []
    rows = docs.select(text_key(F.col("text")).alias("doc"), own_words(F.col("text")).alias("all"))
    rows = rows.select("doc", "all", F.posexplode_outer("all").alias("pos", "word"))
    keys = [_key(F.col("all"), F.col("pos"), k) for k in sizes]
    return rows.select(*keep, keys[0].alias("key") if len(keys) == 1 else F.explode(F.array(*keys)).alias("key"))


def _sieved(rows: DataFrame, keys: DataFrame) -> list[DataFrame]:
    """``rows`` whose key is among ``keys`` (a written table of distinct ones), in parts."""
    k = max(1, -(-keys.count() // BLOCK_KEYS))
    if k > PASSES:
        return [rows.join(keys.hint("merge"), "key", "left_semi")]
    return [rows.join(F.broadcast(keys if k == 1 else keys.where(F.pmod("key", F.lit(k)) == i)), "key", "left_semi") for i in range(k)]


def _anchors(windows: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(wid, words, at, key): for each window its rarest token, leftmost on ties."""
    tokens = _tokens(windows, sizes)
    parts = _sieved(_probe(texts, sizes), cut(tokens.select("key").distinct(), "decon-tokens"))
    counts = reduce(DataFrame.unionByName, [p.groupBy("key").agg(F.count("*").alias("df")) for p in parts])
    ranked = tokens.join(counts, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return ranked.groupBy("wid", "words").agg(F.min(F.struct("df", "at", "key")).alias("b")).select("wid", "words", "b.at", "b.key")


def places(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc, wid, b, e): for each text, by its digest, the [b, e) word spans of windows; and (wid, item_id), the windows' items. Both are written tables."""
    each = cut(_members(benchmark, window), "decon-windows")
    windows = each.select("wid", "words").distinct()
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers
    texts = docs.select("text")
    anchors = cut(_anchors(windows, texts, sizes), "decon-anchors")
    probed = _sieved(_probe(texts, sizes, window), cut(anchors.select("key").distinct(), "decon-keys"))
    hits = reduce(DataFrame.unionByName, probed).distinct()
    start, n = F.col("pos") - F.col("at"), F.size("words")
    fits = (start >= 0) & (start - F.col("first") + n <= F.size("near"))  # position and length
    same = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, n) == F.col("words")
    found = hits.join(anchors, "key").where(fits & same).select("doc", "wid", start.alias("b"), (start + n).alias("e"))
    return cut(found, "decon-found"), each.select("wid", "item_id")


def _covered(spans: Column) -> Column:
    """Number of positions in the union of sorted [b, e) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(acc["to"], s["b"]))).alias("n"), F.greatest(acc["to"], s["e"]).alias("to")
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted item_ids), spans (hit word spans) and contaminated.

    ``docs`` needs a ``text`` column, ``benchmark`` item_id and text. Result columns replace same-named ones.
    """
    (k,) = fresh(docs, "key")
    found, members = places(docs, benchmark, window)
    items = found.select("doc", "wid").distinct().join(members, "wid").select("doc", "item_id").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    spans = found.select("doc", "b", "e").distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("spans"))
    per_text = items.join(spans, "doc").select(F.col("doc").alias(k), F.struct("items", "spans").alias(f"{k}v"))
    # as a written table the texts with hits leave a plain join, of which a digest's many copies can be split
    counted = docs.withColumns({k: row_key(docs), "n_words": F.size(raw_words(F.col("text"))).cast("long")})
    joined = counted.join(cut(per_text, "decon-texts"), k, "left")
    v = F.col(f"{k}v")
    none = F.expr("cast(array() as array<struct<b:int,e:int>>)")
    out = {
        "n_hit": F.coalesce(_covered(v["spans"]), F.lit(0)).cast("long"),
        "items": F.coalesce(v["items"], F.expr("cast(array() as array<string>)")),
        "spans": F.coalesce(v["spans"], none),
        "contaminated": v.isNotNull(),
    }
    return joined.withColumns(out).drop(k, f"{k}v")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    (k,) = fresh(docs, "key")
    found, _ = places(docs, benchmark, window)
    hit = cut(found.select(F.col("doc").alias(k)).distinct(), "decon-texts")
    return docs.withColumn(k, row_key(docs)).join(hit, k, "left_anti").drop(k)
