"""Connected components of a distributed edge list, by alternating star contractions with shared-folder checkpoints.

A star's centre may have any number of edges: minima are counted before the shuffle, and the edges meet them in ``SALTS`` tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import cut


SALTS = 16


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``a`` in ``least`` (of, m), which is repeated for each salt; so often repeated it is never broadcast, however small it looks before."""
    salted = least.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    return edges.withColumn("s", salt).join(salted, (F.col("a") == F.col("of")) & (F.col("s") == F.col("t"))).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return _beside(both.where(F.col("b") > F.col("a")), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from larger to smaller nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    to = least.select(F.col("a").alias("of"), "m")
    moved = _beside(edges, to).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of ``edges`` (a, b): label is its component's smallest node. Self-loops and repeats do no harm."""
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before:
            break
        before = mark
        now = cut(_small_star(_large_star(now)), "edges")
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return leaves.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
