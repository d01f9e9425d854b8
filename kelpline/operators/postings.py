"""An inverted index for BM25: rows (term, id, tf, len) ranged by (term, id), so that a query reads its terms' row groups alone.

With blocks, texts are dealt to at most ``MOST`` shares of each class of lengths, and a text's block is the same for all its terms. A second table, ``peaks``, tells what each block holds of a term, so
that ``top`` reads the blocks alone that can hold one of the best. Of a term of fewer than ``RARE`` texts it tells the number only, since its few postings tell the rest.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import stems
from kelpline.functions.batches import bounded_batches
from kelpline.functions.text import tokens
from kelpline.operators.search import B, K1, query_terms

#: Texts of a block, about, as long as a class of lengths has fewer than MOST blocks; there are 62 classes at most.
BLOCK, MOST = 64, 2048
#: Blocks that a search reads first, and those whose numbers reach the scan as a filter; more are joined.
FIRST, LISTED = 256, 1000
#: Texts from which on a term has peaks, and postings up to which a query's are read whole: fewer are read faster than bounds are found.
RARE, DIRECT = 1024, 4_000_000
#: Texts that a task counts the words of, about: few enough for its memory, however large the files are.
DEALT = 1000


def words(text: Column, english: bool = False) -> Column:
    """A text's tokens, without stop words for ``english``; a null text has none."""
    found = tokens(F.coalesce(text, F.lit("")))
    return F.filter(found, lambda t: ~t.isin(*stems.STOP)) if english else found


def terms_of(spark: SparkSession, query: str, english: bool = False) -> list[str]:
    """A query's distinct terms, by the rules of the postings'."""
    terms = sorted(set(query_terms(query)))
    if not english:
        return terms
    left = spark.createDataFrame([(t,) for t in terms if t not in stems.STOP], "term string")
    return sorted({r.term for r in left.select(stems.stem(F.col("term")).alias("term")).collect()})  # a query's words


def shares(n: int) -> int:
    """Shares that each class of lengths is dealt to, for ``n`` texts."""
    return min(MOST, 1 + n // (8 * BLOCK))


def build(rows: DataFrame, id: str = "id", text: str = "text", files: int | None = None, english: bool = False, blocks: int | None = None, n: int | None = None) -> DataFrame:
    """(term, id, tf, len), sorted within each partition. Ranges cut a frequent term's postings by id, so no task holds it whole.

    Null texts have no terms; rows that repeat an id count as one text. For ``english``, terms are stems and stop words are left out, of the lengths too.
    With ``blocks``, the number of shares, rows have their text's ``block`` too and are ordered by it before the id; ids have to be distinct then. ``n`` is the number of rows, where it is known.

    Texts, which are smaller than their postings, are dealt by id and their words counted where they lie; only the order of ranges moves postings.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    if english:
        bounded_batches(rows.sparkSession)
        body = stems.stemmed(words(F.col(text), True))
    dealt = rows.select(F.col(id).alias("id"), body.alias("t")).repartition(1 + (rows.count() if n is None else n) // DEALT, "id")
    each = dealt.select("id", (F.array_remove(F.split("t", " "), "") if english else words(F.col("t"))).alias("t"))
    terms = each.select("id", F.size("t").alias("len"), F.explode_outer("t").alias("term")).where("term IS NOT NULL")  # for a plain explode Spark splits each text once more, to look for empty ones
    counted = terms.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    order = ("term", "id")
    if blocks:
        order = ("term", "block", "id")
        share = F.pmod(F.xxhash64("id"), F.lit(blocks))
        counted = counted.withColumn("block", (F.floor(2 * F.log2("len")) * MOST + share).cast("int"))
    ranged = counted.repartitionByRange(files, *order) if files else counted.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def peaks(postings: DataFrame, rare: int | None = None) -> DataFrame:
    """(term, block, tf, len, n): of a block's texts that hold a term ``tf`` times, the shortest's length and their number. The best score of a block is exact whatever the average length.

    Terms of fewer than ``rare`` texts, or RARE, have one row, whose block, tf and len are null. Tables of parts of the texts add up by union, if all but one have none of these rows; texts that went are taken
    off by rows whose ``n`` is negative.
    """
    rare = RARE if rare is None else rare
    found = postings
    if rare > 0:
        counts = postings.groupBy("term").agg(F.count("*").alias("n"))
        often = counts.where(F.col("n") >= rare).select("term")  # of ``rare`` postings one term at most
        found = postings.join(F.broadcast(often), "term", "left_semi")
    all = found.groupBy("term", "block", "tf").agg(F.min("len").alias("len"), F.count("*").alias("n"))
    if rare > 0:
        few = counts.where(F.col("n") < rare).select("term", *[F.lit(None).cast(all.schema[c].dataType).alias(c) for c in ("block", "tf", "len")], "n")
        all = all.unionByName(few)
    return all.repartitionByRange("term", "block").sortWithinPartitions("term", "block")


def stats(rows: DataFrame, text: str = "text", english: bool = False) -> DataFrame:
    """One row (n, total): rows and their number of tokens, a null text having none."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(words(F.col(text), english)).cast("long")), F.lit(0).cast("long")).alias("total"))


def _score(n: int, avg: float) -> Column:
    """What a posting adds, from its tf and len and its term's df."""
    idf, tf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.col("tf").cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(avg)))


def bm25(postings: DataFrame, n: int, avg: float, query: str, english: bool = False) -> DataFrame:
    """(id, score) of the rows that hold a term of the query; scores are those of a scan of all rows. ``english`` as in ``build``."""
    terms = terms_of(postings.sparkSession, query, english)
    mine = postings.where(F.col("term").isin(terms))
    counts = mine.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    return mine.join(F.broadcast(counts), "term").groupBy("id").agg(F.sum(_score(n, avg)).alias("score"))


class Found(NamedTuple):
    """The best (id, score), in order; blocks that hold a term of the query and how many of them were read, both 0 if the postings were read whole."""

    hits: DataFrame
    blocks: int = 0
    read: int = 0


def top(postings: DataFrame, peaks: DataFrame, n: int, avg: float, query: str, k: int, keep: DataFrame | None = None, english: bool = False, direct: int | None = None) -> Found:
    """The ``k`` best by ``bm25``, ties by id, from postings with blocks. ``keep`` (id) says which may be found.

    A block's bound is the sum of the best scores that it has for each term. The blocks of the highest bounds are read first; the score of the k-th best text there is one that every result has to reach, so
    of the others only blocks with such a bound are read. The driver holds the blocks' bounds, 62 * MOST numbers at most, and ``k`` rows. A query of at most ``direct`` postings, or DIRECT, reads them all.
    """
    spark, terms = postings.sparkSession, terms_of(postings.sparkSession, query, english)
    told, mine = peaks.where(F.col("term").isin(terms)), postings.where(F.col("term").isin(terms))
    dfs = told.groupBy("term").agg(F.sum("n").alias("df"), F.bool_or(F.col("block").isNull()).alias("few")).where("df > 0").collect()  # a row for each query term
    counts = F.broadcast(spark.createDataFrame([(r.term, r.df) for r in dfs], "term string, df long"))

    def best(read: DataFrame) -> DataFrame:
        hits = read.join(counts, "term").groupBy("id").agg(F.sum(_score(n, avg)).alias("score"))
        hits = hits if keep is None else hits.join(keep, "id", "left_semi")
        return hits.orderBy(F.desc("score"), "id").limit(k)

    def held(blocks: list[int]) -> DataFrame:
        if len(blocks) <= LISTED:
            return mine.where(F.col("block").isin(blocks))
        return mine.join(F.broadcast(spark.createDataFrame([(b,) for b in blocks], "block int")), "block", "left_semi")  # 62 * MOST numbers at most

    if sum(r.df for r in dfs) <= (DIRECT if direct is None else direct):
        return Found(best(mine))
    few = [r.term for r in dfs if r.few]
    each = told.where(~F.col("term").isin(few)).select("term", "block", "tf", "len")
    each = each.unionByName(postings.where(F.col("term").isin(few)).select("term", "block", "tf", "len")) if few else each
    highest = each.join(counts, "term").groupBy("block", "term").agg(F.max(_score(n, avg)).alias("best"))
    bounds = sorted(((r.bound, r.block) for r in highest.groupBy("block").agg(F.sum("best").alias("bound")).collect()), reverse=True)
    first = [b for _, b in bounds[:FIRST]]
    hits = best(held(first))
    rows = hits.collect()  # ``k`` at most
    least = rows[-1].score if len(rows) == k else 0.0
    read = [b for bound, b in bounds if bound * (1 + 1e-9) >= least]  # sums of another order may differ in their last digits
    if len(read) <= len(first):
        return Found(spark.createDataFrame(rows, hits.schema), len(bounds), len(first))
    return Found(best(mine if len(read) == len(bounds) else held(read)), len(bounds), len(read))
