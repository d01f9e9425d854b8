"""A store of versioned Parquet tables: a base and a few deltas. An upsert writes its own rows only; reading merges.

A version is an entry in the table's log, a file named by its number that lists the folders of base and deltas. Entries are made whole and exclusively
(a hard link on this machine's disks, a rename elsewhere, which HDFS refuses if the entry is there), so of two writers that start from one version the second is told.
Upserts then go on from the newer version; rewrites of a whole table raise ``Conflict``.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Deltas that a table may have; the next upsert merges them into one. ``optimize`` merges them into the base.
MERGED = 8
#: Tries of an upsert that others get ahead of, and versions whose plans are remembered.
TRIES, KNOWN = 20, 64


class Conflict(RuntimeError):
    """Someone else has written the version."""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, under spark.checkpoint.dir; where that is unset and Spark runs in one process, as in local tests, one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "kelpline-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Version:
    """Number, folder of the base, folders of the deltas from old to new, the column that tells rows apart, and how many upserts each delta holds."""

    n: int
    base: str
    deltas: tuple[str, ...] = ()
    key: str = "id"
    counts: tuple[int, ...] = ()

    def __post_init__(self):
        if len(self.counts) != len(self.deltas):  # deltas that aren't merged, or an older log entry
            object.__setattr__(self, "counts", (1,) * len(self.deltas))

    def tail(self) -> int:
        """How many of the last deltas are of one tier: hold a number of upserts between the same powers of ``MERGED``."""
        tier = lambda n: 0 if n < MERGED else 1 + tier(n // MERGED)
        same = 0
        for c in reversed(self.counts):
            if tier(c) != tier(self.counts[-1]):
                break
            same += 1
        return same


class Store:
    """Tables under ``root``, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._frames: dict[tuple, DataFrame] = {}  # versions never change, so their files are listed once

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _log(self, table: str) -> str:
        return f"{self.root}/{table}/_log"

    def _numbers(self, table: str) -> list[int]:
        path = self._path(self._log(table))
        if not self._fs.exists(path):
            return []
        return sorted(int(n) for s in self._fs.listStatus(path) if (n := s.getPath().getName()).isdigit())

    def _entry(self, table: str, n: int) -> Version:
        f = self._fs.open(self._path(f"{self._log(table)}/{n:012d}"))
        try:
            v = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()
        return Version(n, v["base"], tuple(v["deltas"]), v["key"], tuple(v.get("counts", ())))

    def version(self, table: str) -> Version | None:
        """The newest version."""
        found = self._numbers(table)
        return self._entry(table, found[-1]) if found else None

    def _commit(self, table: str, v: Version) -> int:
        body = json.dumps({"base": v.base, "deltas": v.deltas, "key": v.key, "counts": v.counts})
        to, part = self._path(f"{self._log(table)}/{v.n:012d}"), self._path(f"{self._log(table)}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        if self._fs.getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), to.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            self._fs.delete(part, False)
        else:
            done = not self._fs.exists(to) and self._fs.rename(part, to)
        if not done:
            raise Conflict(f"version {v.n} of {table} was written by someone else")
        return v.n

    def _put(self, table: str, rows: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{table}/{name}")
        return name

    def _part(self, table: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/{name}")

    def _latest(self, table: str, v: Version) -> DataFrame:
        """The newest row of each key in the deltas."""
        parts = [self._part(table, d).withColumn("_at", F.lit(i)) for i, d in enumerate(v.deltas)]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return both.withColumn("_n", F.row_number().over(W.partitionBy(v.key).orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The newest version's rows, or those of an older one that hasn't been pruned."""
        found = self._numbers(table)
        if not found or version is not None and version not in found:
            return None
        v = self._entry(table, found[-1] if version is None else version)
        known = (table, v.base, v.deltas)
        if known not in self._frames:
            base = self._part(table, v.base)
            new = self._latest(table, v) if v.deltas else None
            if len(self._frames) >= KNOWN:
                self._frames.clear()
            self._frames[known] = base if new is None else base.join(new.select(v.key), v.key, "left_anti").unionByName(new, allowMissingColumns=True)
        return self._frames[known]

    def since(self, table: str, version: int) -> DataFrame | None:
        """The rows written after ``version``, newest of each key; None if the table has been rewritten since, or the version is gone.

        Where a delta has been merged with older ones, rows of these come too, as they are now."""
        old, now = self._entry(table, version) if version in self._numbers(table) else None, self.version(table)
        if old is None or now.base != old.base:
            return None
        ends = [sum(now.counts[: i + 1]) for i in range(len(now.deltas))]
        added = tuple(d for d, end in zip(now.deltas, ends) if end > sum(old.counts))
        return self._latest(table, Version(now.n, now.base, added, now.key)) if added else self._part(table, now.base).limit(0)

    def write(self, table: str, rows: DataFrame, key: str = "id", after: Version | None = None) -> int:
        """Write the whole table anew; the version's number. ``after``: the version that ``rows`` come from, which must still be the newest."""
        before = after or self.version(table)
        return self._commit(table, Version(before.n + 1 if before else 1, self._put(table, rows), (), key))

    def upsert(self, table: str, rows: DataFrame, key: str = "id", distinct: bool = False) -> int:
        """Put ``rows`` in place of those with their keys; of rows that repeat a key one is kept. Only they are written, and once for each tier of deltas when ``MERGED`` of a tier are merged.

        ``distinct``: no key is repeated, so the rows are written where they lie.
        """
        name = self._put(table, rows if distinct else rows.dropDuplicates([key]))
        for _ in range(TRIES):
            v = self.version(table)
            new = Version(1, name, (), key) if v is None else Version(v.n + 1, v.base, (*v.deltas, name), key, (*v.counts, 1))
            while (k := new.tail()) >= MERGED:
                some = Version(new.n, new.base, new.deltas[-k:], key, new.counts[-k:])
                new = Version(new.n, new.base, (*new.deltas[:-k], self._put(table, self._latest(table, some))), key, (*new.counts[:-k], sum(some.counts)))
            try:
                return self._commit(table, new)
            except Conflict:
                continue
        raise Conflict(f"{table} is being written by too many others")

    def delete_host(self, host: str, *tables: str) -> int:
        """Drop a host's rows; how many there were."""
        gone = 0
        for t in tables:
            v, base = self.version(t), self.read(t)
            if base is not None:
                gone += base.where(F.col("host") == host).count()
                self.write(t, base.where(F.col("host") != host), v.key, v)
        return gone

    def flush(self, messages: DataFrame, chunks: DataFrame, state: DataFrame) -> None:
        """Chunks, then messages, then the deduplication state, none of which may repeat a key: a crash in between only repeats work."""
        self.upsert("chunks", chunks, distinct=True)
        self.upsert("messages", messages, distinct=True)
        self.upsert("dedup", state, "dedup_key", distinct=True)

    def optimize(self, table: str, files: int, *order: str) -> int:
        """Merge a table's deltas into its base, in ``files`` files that are ranges of ``order``, so that a scan for its first column skips most of them."""
        v, rows = self.version(table), self.read(table)
        if rows is None:
            return 0
        return self.write(table, rows.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else rows.repartition(files), v.key, v)

    def prune(self, table: str) -> int:
        """Delete all versions but the newest and the folders that only they use, for times without readers; how many there were."""
        found = self._numbers(table)
        if not found:
            return 0
        v = self._entry(table, found[-1])
        for s in self._fs.listStatus(self._path(f"{self.root}/{table}")):
            if s.getPath().getName() not in ("_log", v.base, *v.deltas):
                self._fs.delete(s.getPath(), True)
        for n in found[:-1]:
            self._fs.delete(self._path(f"{self._log(table)}/{n:012d}"), False)
        return len(found) - 1

    def drop(self, *tables: str) -> None:
        """Delete tables; those that aren't there are passed over."""
        for t in tables:
            self._fs.delete(self._path(f"{self.root}/{t}"), True)
