"""Keyword, vector and hybrid search, and the collapsing of ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.text import tokens

RRF_K, K1, B = 60, 1.2, 0.75


def fetch_size(limit: int) -> int:
    return max(50, 8 * limit)


def query_terms(query: str) -> list[str]:
    """A query's tokens, by the classes of ``functions.text.tokens``: letters and decimal digits."""
    return "".join(c if c.isalpha() or c.isdecimal() else " " for c in query.lower()).split()


def term_frequency(text: Column, term: str) -> Column:
    """Times a token stands in a text; most texts are done with a plain substring search."""
    lowered = F.lower(text)
    edge = r"[\p{L}\p{Nd}]"
    return F.when(lowered.contains(term), F.regexp_count(lowered, F.lit(f"(?<!{edge}){term}(?!{edge})"))).otherwise(0)


def token_count(text: Column) -> Column:
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def keyword_score(text: Column, query: str) -> Column:
    """Sum over the query's tokens found of 1 + ln(1 + tf); a repeated query token counts again."""
    score = F.lit(0.0)
    for w in query_terms(query):
        tf = term_frequency(text, w)
        score = score + F.when(tf > 0, 1 + F.log(1 + tf.cast("double"))).otherwise(0.0)
    return score


def keyword_search(rows: DataFrame, query: str, k: int, id: str = "id", text: str = "text") -> DataFrame:
    """The ``k`` best rows by keyword score; rows without a match are left out."""
    some = F.lit(False)
    for w in query_terms(query):
        some = some | F.lower(text).contains(w)
    top = rows.where(some).withColumn("score", keyword_score(F.col(text), query)).orderBy(F.desc("score"), id).limit(k)
    return top.where(F.col("score") > 0)


def bm25(rows: DataFrame, query: str, id: str = "id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, score) by BM25 over distinct query terms. Nothing is exploded; the corpus statistics are one aggregate row.

    They are those of all ``rows``; ``keep`` then says which may be found.
    """
    terms = sorted(set(query_terms(query)))
    hits = rows.select(F.col(id).alias("id"), (F.lit(True) if keep is None else keep).alias("_keep"), token_count(F.col(text)).alias("len"), *[term_frequency(F.col(text), w).alias(f"tf{i}") for i, w in enumerate(terms)])
    stats = hits.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | (F.col(f"tf{i}") > 0)
    some = some & F.col("_keep")
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return hits.where(some).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def l2(vector: Column, query: list[float]) -> Column:
    """Distance of two vectors: differences of single precision, squared and summed in double; the longer vector's rest is left out."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    gaps = F.zip_with(vector, q, lambda a, b: (a.cast("float") - b).cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))))


def vector_search(rows: DataFrame, query: list[float], k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` nearest rows by L2 distance, with ``score`` 1 / (1 + distance)."""
    near = rows.withColumn("distance", l2(F.col(vector), query)).orderBy("distance", id).limit(k)
    return near.withColumn("score", 1 / (1 + F.col("distance")))


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """1-based ``rank``; for lists that a limit has bounded."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(*lists: DataFrame) -> DataFrame:
    """(id, score): reciprocal-rank fusion of ranked lists (id, rank)."""
    both = lists[0].select("id", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def best_of_message(hits: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def collapse(hits: DataFrame, gap: int = 600, limit: int = 10**9) -> DataFrame:
    """Greedy collapse of at most a few hundred ranked hits (rank, id, message_id, content_hash, chat, container_id, timestamp).

    An empty message_id stands for the row's own id. In rank order a hit goes if a kept one has its message or its non-empty hash, or, for chats, is of the same container and within ``gap`` seconds.
    """
    fields = ["rank", "id", "message_id", "content_hash", "chat", "container_id", "timestamp"]
    own = hits.withColumn("message_id", F.coalesce(F.nullif("message_id", F.lit("")), "id"))
    one = own.select(F.struct(*fields).alias("h")).agg(F.array_sort(F.collect_list("h")).alias("hs"))

    def step(kept: Column, h: Column) -> Column:
        same = F.exists(
            kept,
            lambda k: (k["message_id"] == h["message_id"])
            | ((h["content_hash"] != "") & (k["content_hash"] == h["content_hash"]))
            | (h["chat"] & k["chat"] & (k["container_id"] == h["container_id"]) & (F.abs(k["timestamp"] - h["timestamp"]) <= gap)),
        )
        return F.when(same | (F.size(kept) >= limit), kept).otherwise(F.concat(kept, F.array(h)))

    start = F.slice("hs", 1, 0)
    return one.select(F.inline(F.aggregate("hs", start, step)))
