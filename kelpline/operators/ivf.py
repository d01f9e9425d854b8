"""An inverted-file vector index: every row in the list of its nearest centre, written by list; many queries at a time, each over the lists nearest to it.

A search task reads the lists that its queries probe in bounded batches and keeps each query's best, so that it holds one block of queries and
one batch of rows, and what it returns grows with the queries only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.quantised import _means, _nearest
from kelpline.sources.store import scratch

BLOCK, BATCH, PAIRS = 500, 8192, 100_000


@dataclass(frozen=True)
class Index:
    """``folder`` holds (id, vector) by list, ``centres`` is (lists, dims)."""

    folder: str
    centres: np.ndarray


def _usable(vector: str, dims: int) -> Column:
    return (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def _sample(rows: DataFrame, seed: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes of their id and ``seed``."""
    return rows.withColumn("_h", F.xxhash64("id", F.lit(seed))).orderBy("_h", "id").limit(n).drop("_h")


def build(rows: DataFrame, dims: int, lists: int = 16, sample_rows: int = 20_000, rounds: int = 12, id: str = "id", vector: str = "vector") -> Index:
    """Train the centres by k-means on the ``sample_rows`` rows of the smallest id hashes, a bounded sample, and write every row to its list,
    in the folder that all executors share (spark.checkpoint.dir; where it is missing, as in local tests, a folder of this machine).

    ``id`` is a whole number. Vectors that are null, of another length or have null or NaN elements are left out; without any there is nothing to fit: ValueError.
    """
    rows = rows.where(_usable(vector, dims)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    points = np.array([r[0] for r in _sample(rows, "centres", sample_rows).select("vector").collect()], dtype=np.float64)
    if not len(points):
        raise ValueError("no vectors to train on")
    centres = _means(points, lists, rounds, np.random.default_rng(7))

    def near(column: pa.Array) -> pa.Array:
        return pa.array(_nearest(_matrix(column, dims), centres).astype(np.int32))

    folder = scratch(rows.sparkSession, "ivf")
    rows.withColumn("list", F.arrow_udf(near, "int")(F.col("vector"))).write.partitionBy("list").parquet(folder)
    return Index(folder, centres)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, dims)


class _Best:
    """The best ``k`` rows of each of a block's queries, by distance and then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.of, self.id, self.d, self.list = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int32))

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.queries))

    def add(self, some: np.ndarray, ids: np.ndarray, rows: np.ndarray, list_: int) -> None:
        """Rows of a list, for the queries numbered ``some``. A product picks candidates; what counts is the distance by differences."""
        q = self.queries[some]
        rough = (q**2).sum(1)[:, None] - 2 * q @ rows.T + (rows**2).sum(1)
        limit = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] if rough.shape[1] > self.k else rough.max(1)
        of, at = np.nonzero(rough <= (limit + 1e-9 * (1 + np.abs(rough).max(1)))[:, None])
        for lo in range(0, len(of), PAIRS):
            o, a = of[lo : lo + PAIRS], at[lo : lo + PAIRS]
            d = np.sqrt(((q[o] - rows[a]) ** 2).sum(1))
            self._merge(some[o], ids[a], d, np.full(len(o), list_, np.int32))

    def _merge(self, of: np.ndarray, id: np.ndarray, d: np.ndarray, list_: np.ndarray) -> None:
        columns = [np.concatenate(x) for x in ((self.of, of), (self.id, id), (self.d, d), (self.list, list_))]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        first = np.searchsorted(columns[0][order], np.arange(len(self.queries)))
        kept = order[np.arange(len(order)) - first[columns[0][order]] < self.k]
        self.of, self.id, self.d, self.list = (x[kept] for x in columns)


def search(index: Index, queries: DataFrame, k: int, probes: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, id, distance, list) of the ``k`` nearest rows in each query's ``probes`` nearest lists; all lists are searched for a query whose lists hold fewer than ``k``.

    All lists probed is the exact search.
    """
    folder, centres = index.folder, index.centres
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        files: dict[int, list[str]] = {}
        for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            if f.path.endswith(".parquet"):
                files.setdefault(int(f.path.rsplit("/list=", 1)[1].split("/")[0]), []).append(f.path)

        def answer(ids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
            order = np.argsort((centres**2).sum(1) - 2 * points @ centres.T, axis=1, kind="stable")
            probed = np.zeros((len(points), len(centres)), bool)
            np.put_along_axis(probed, order[:, :probes], True, axis=1)
            best = _Best(points, k)
            for again in (False, True):
                wanted = ~probed & (best.counts() < k)[:, None] if again else probed
                for i, paths in files.items():
                    some = np.flatnonzero(wanted[:, i])
                    if len(some):
                        for b in pa.dataset.dataset(paths, filesystem=fs, format="parquet", partitioning=None).to_batches(columns=["id", "vector"], batch_size=BATCH, batch_readahead=1, fragment_readahead=1):
                            if b.num_rows:
                                best.add(some, b.column("id").to_numpy(), _matrix(b.column("vector"), dims), i)
            return pa.record_batch({"query_id": ids[best.of], "id": best.id, "distance": best.d, "list": best.list})

        held: list[pa.RecordBatch] = []
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                held.append(b.slice(lo, BLOCK))
                if sum(x.num_rows for x in held) > BLOCK:
                    t = pa.Table.from_batches(held)
                    yield answer(t.column("id").to_numpy(), _matrix(t.column("vector"), dims))
                    held = []
        if held and sum(x.num_rows for x in held):
            t = pa.Table.from_batches(held)
            yield answer(t.column("id").to_numpy(), _matrix(t.column("vector"), dims))

    asked = queries.where(_usable(vector, dims)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    spread = asked.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "query_id long, id long, distance double, list int")


def probes_for(spark: SparkSession, index: Index, k: int, recall: float = 0.95, sample_queries: int = 200) -> int:
    """The fewest lists to probe so that queries find ``recall`` of their exact ``k`` nearest.

    Measured on the ``sample_queries`` rows of the smallest hashes, against an exact search of all rows; the rows themselves don't count as found.
    """
    rows = spark.read.parquet(index.folder)
    asked = _sample(rows.select("id", "vector"), "probes", sample_queries).collect()
    found = search(index, spark.createDataFrame(asked, "id long, vector array<double>"), k + 1, len(index.centres)).where("query_id <> id").collect()
    points = {r.id: np.array(r.vector) for r in asked}
    place = {q: np.argsort(np.argsort((index.centres**2).sum(1) - 2 * index.centres @ p, kind="stable")) for q, p in points.items()}
    places = np.sort([place[r.query_id][r.list] for r in found])
    return int(places[max(0, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else len(index.centres)
