"""Container walks, session listings, status counts and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.text import clip_runes
from kelpline.plans.predicates import before, conj, cursor, eq_all, of_kinds


def walk(messages: DataFrame, container_id: str, after_ts: int = 0, after_id: str = "", kinds: set[str] | None = None, limit: int = 50, **filters: str) -> DataFrame:
    """A page of a container in (timestamp, id) order."""
    keep = [eq_all(container_id=container_id, **filters), cursor(after_ts, after_id)]
    if kinds:
        keep.append(of_kinds(kinds))
    return messages.where(conj(keep)).orderBy("timestamp", "id").limit(limit)


def sessions(messages: DataFrame, since: int, until: int = 0, **filters: str) -> DataFrame:
    """One row for each container active in the window, in order of their first messages: count, first and last time, title and project of the first
    message, and the first prompt (a user's if there is one)."""
    rows = messages.where(conj([F.col("kind") == "message", F.col("timestamp") >= since, before(until), eq_all(**filters)]))
    order = F.struct("timestamp", "id")
    said = F.col("text") != ""
    prompt = F.coalesce(F.min_by(F.when(said, F.col("text")), F.when(said & (F.col("author_id") == "user"), order)), F.min_by(F.when(said, F.col("text")), F.when(said, order)), F.lit(""))
    found = rows.groupBy("host", "source", "container_id").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("messages"), clip_runes(prompt, 300).alias("first_prompt"),
        *[F.min_by(c, order).alias(c) for c in ("container_title", "project")], F.min(order).alias("_first"),
    )
    return found.orderBy("_first").drop("_first")


def status_counts(registry: DataFrame) -> DataFrame:
    """Objects by status for each source, and in all (source null)."""
    return registry.rollup("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "failed", "processing")], F.count("*").alias("total"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def upsert(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with their key; of new rows that repeat a key one is kept."""
    return base.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def interleave(stores: list[DataFrame], order: list[str], limit: int, names: list[str] | None = None) -> DataFrame:
    """Round-robin over stores' lists: first of each, second of each, up to ``limit``; store is a list's name, or its number."""
    parts = [s.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumns({"store": F.lit(names[i] if names else i), "_store": F.lit(i)}) for i, s in enumerate(stores)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.orderBy("rank", "_store").limit(limit).drop("_store")


def scan(rows: DataFrame, limit: int = 10, **filters: str) -> DataFrame:
    """The first rows that fit the filters, without a search; their score is their time."""
    return rows.where(eq_all(**filters)).withColumn("score", F.col("timestamp").cast("double")).orderBy("timestamp", "id").limit(limit if limit > 0 else 10)


def backoff(attempts: Column, first: int = 30, longest: int = 3600) -> Column:
    """Seconds to wait after so many attempts: ``first``, doubled with each after the first, ``longest`` at most."""
    return F.least(F.lit(longest).cast("double"), first * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20))))


def due(objects: DataFrame, registry: DataFrame, now: int, version: int | str = 1, interval: int = 300, first: int = 30, longest: int = 3600) -> DataFrame:
    """Objects to process, with their ``attempts`` so far.

    Due are: new objects, those read by another parser, changed ones (if indexed, only ``interval`` seconds after they were), those left in
    processing, and failed ones past their back-off, ``first`` seconds doubled with each attempt after the first, ``longest`` at most.
    """
    wait = backoff(F.coalesce("attempts", F.lit(0)), first, longest)
    known = objects.join(registry.withColumnsRenamed({"etag": "old_etag", "size": "old_size"}), "key", "left")
    changed = (F.col("etag") != F.col("old_etag")) | (F.col("size") != F.col("old_size"))
    age, indexed = now - F.col("updated_at"), F.col("status") == "indexed"
    ready = (
        F.when(F.col("status").isNull() | (F.col("parser_version") != version), True)
        .when(changed, ~indexed | (age >= interval))
        .when(indexed, False)
        .when(F.col("status") == "failed", age >= wait)
        .otherwise(True)
    )
    return known.where(ready)


def advance(entries: DataFrame, status: str, now: int, version: int | str, error: Column | str = "") -> DataFrame:
    """Registry entries (key, etag, size, attempts, same_version) moved to ``status``; starting counts an attempt, anew for another version of the object or parser."""
    again = F.when(F.col("same_version"), F.coalesce("attempts", F.lit(0))).otherwise(0) + (1 if status == "processing" else 0)
    return entries.withColumns({"status": F.lit(status), "attempts": again.cast("long"), "updated_at": F.lit(now).cast("long"), "parser_version": F.lit(version), "error": error if isinstance(error, Column) else F.lit(error)})
