"""A product-quantised vector index (IVF-PQ): lists of near rows, codes of one byte for each part of a vector, and re-ranking that is exact, over all lists or those probed.

Two bounds spare a search most rows. A row lies at most ``radius`` from its list's centre, so one whose radius differs from the query's distance to that centre by more than the ``k``-th best distance known can't
be among the nearest (triangle inequality); lists and, in files sorted by list and radius, row groups are skipped by it before their vectors are read. Of the rest the codes tell how near a row can be at best.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators.search import vector_search


@dataclass(frozen=True)
class Codebook:
    """``lists``: (lists, dims) centres; ``parts``: (parts, codes, dims / parts) centres of the residuals' parts; ``measures``, once they are taken: each list's number of rows, largest and mean radius, and mean
    error. Its size depends on its parameters only."""

    lists: np.ndarray
    parts: np.ndarray
    measures: np.ndarray | None = None

    @classmethod
    def of(cls, lists: list, parts: list, measures: list | None = None) -> Codebook:
        return cls(np.array(lists, dtype=np.float64), np.array(parts, dtype=np.float64), None if measures is None else np.array(measures, dtype=np.float64))

    def measured(self, index: DataFrame) -> Codebook:
        """With the measures of the lists of ``index``. Rows that are left out later, by a filter, don't make them wrong."""
        taken = np.tile([0, -np.inf, 0, 0], (len(self.lists), 1))
        for at, *m in index.where("codes IS NOT NULL").groupBy("list").agg(F.count("*"), F.max("radius"), F.avg("radius"), F.avg("error")).collect():  # a row for each list
            taken[at] = m
        return replace(self, measures=taken)


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres; one that loses all its points stays where it was."""
    centres = points[rng.permutation(len(points))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of each point's nearest centre; |p|^2 is the same for all centres and left out."""
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def train(rows: DataFrame, dims: int, lists: int = 1, parts: int = 96, codes: int = 256, sample_rows: int = 20_000, rounds: int = 12, id: str = "id", vector: str = "vector") -> Codebook:
    """Fit on the ``sample_rows`` rows of the smallest id hashes, a bounded sample; the index itself holds every row.

    Null vectors, those of another length and those with null or NaN elements are left out. Without any row there is nothing to fit: ValueError.
    """
    if dims % parts or codes > 256:
        raise ValueError("parts must divide dims, and a code is one byte")
    fit = rows.where((F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))).select(vector, F.xxhash64(id).alias("_h")).orderBy("_h").limit(sample_rows).collect()
    if not fit:
        raise ValueError("no vectors to train on")
    points = np.array([r[0] for r in fit], dtype=np.float64)
    rng = np.random.default_rng(7)
    coarse = _means(points, lists, rounds, rng)
    rest = (points - coarse[_nearest(points, coarse)]).reshape(len(points), parts, dims // parts)
    return Codebook(coarse, np.stack([_means(rest[:, j], codes, rounds, rng) for j in range(parts)]))


def encode(rows: DataFrame, book: Codebook, vector: str = "vector") -> DataFrame:
    """``rows`` with ``list``, ``codes`` (binary, a byte for each part) and ``error``, the vector's distance from what its codes stand for, and ``radius``, that from its list's centre; null where the vector is null, of another length or has null or NaN elements."""
    parts, _, width = book.parts.shape

    def run(column: pa.Array) -> pa.Array:
        values = column.to_pylist()
        good = [i for i, v in enumerate(values) if v is not None and len(v) == parts * width and None not in v and not np.isnan(v).any()]
        out: list[dict | None] = [None] * len(values)
        if good:
            points = np.array([values[i] for i in good], dtype=np.float64)
            at = _nearest(points, book.lists)
            off = points - book.lists[at]
            radius, rest = np.sqrt((off**2).sum(1)), off.reshape(len(good), parts, width)
            found = np.stack([_nearest(rest[:, j], book.parts[j]) for j in range(parts)], axis=1).astype(np.uint8)
            error = np.sqrt(((rest - book.parts[np.arange(parts), found]) ** 2).sum((1, 2)))
            for n, i in enumerate(good):
                out[i] = {"list": int(at[n]), "codes": found[n].tobytes(), "error": float(error[n]), "radius": float(radius[n])}
        return pa.array(out, pa.struct([("list", pa.int32()), ("codes", pa.binary()), ("error", pa.float64()), ("radius", pa.float64())]))

    coded = rows.withColumn("_pq", F.arrow_udf(run, "list int, codes binary, error double, radius double")(F.col(vector)))
    return coded.withColumns({"list": F.col("_pq.list"), "codes": F.col("_pq.codes"), "error": F.col("_pq.error"), "radius": F.col("_pq.radius")}).drop("_pq")


def _within(gaps: np.ndarray, lists: Sequence[int], most: float) -> Column:
    """Rows of ``lists`` that the triangle inequality allows within ``most`` of a query at distance ``gaps`` from the centres."""
    some = F.lit(False)
    for i in lists:
        some = some | ((F.col("list") == i) & F.col("radius").between(float(gaps[i] - most), float(gaps[i] + most)))
    return some


def search(index: DataFrame, book: Codebook, query: list[float], k: int, probes: int = 1, refine: int = 4, id: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` nearest rows of ``index`` (encoded rows) with ``distance`` and ``score``; exact within the ``probes`` nearest lists, or over all if ``probes`` is 0.

    The ``refine * k`` best by their codes, in as many near lists as hold that many, are ranked by their vectors; their ``k``-th distance bounds the result's. Then every row that both
    bounds allow to be as near is ranked, however many there are. Lists with fewer than ``k`` rows, as a filter may leave them, are joined by four times as many; a filter that leaves
    fewer than ``k`` in all lists probed is answered by a scan of all rows that have codes.
    """
    able = candidates(index, book, query, k, probes, refine, id, vector)
    return vector_search(index.where(F.col("codes").isNotNull()) if able is None else able, query, k, id, vector)


def candidates(index: DataFrame, book: Codebook, query: list[float], k: int, probes: int = 1, refine: int = 4, id: str = "id", vector: str = "vector") -> DataFrame | None:
    """The rows that ``search`` ranks by their vectors in the end; None if the lists hold too few."""
    parts, _, width = book.parts.shape
    asked = np.array(query, dtype=np.float32).astype(np.float64)
    gaps = np.sqrt(((book.lists - asked) ** 2).sum(1))
    near = sorted(range(len(book.lists)), key=lambda i: (gaps[i], i))[: probes or None]
    coded = index.where(F.col("codes").isNotNull())

    def estimated(rows: DataFrame, lists: Sequence[int]) -> DataFrame:
        # squared distance of the query's part to each centre, by list, part and code
        tables = {i: ((book.parts - (asked - book.lists[i]).reshape(parts, 1, width)) ** 2).sum(2) for i in lists}

        def estimate(lists: pa.Array, codes: pa.Array) -> pa.Array:
            at = np.asarray(lists)
            byte = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(at), parts)
            out = np.zeros(len(at))
            for i in np.unique(at):
                mine = at == i
                out[mine] = tables[i][np.arange(parts), byte[mine]].sum(1)
            return pa.array(out)

        return rows.withColumn("_e", F.arrow_udf(estimate, "double")("list", "codes"))

    wanted, first = max(1, refine) * k, len(near)
    if book.measures is not None:
        first = min(first, 1 + int(np.searchsorted(np.cumsum(book.measures[near, 0]), wanted)))
    while True:
        some = near[:first]
        best = estimated(coded.where(F.col("list").isin(some)), some).select(id, vector, "_e").orderBy("_e", id).limit(wanted)
        top = [r[0] for r in vector_search(best, query, k, id, vector).select("distance").collect()]  # k at most
        if len(top) >= k or first == len(near):
            break
        first = min(len(near), 4 * first)
    if len(top) < k or not np.isfinite(max(top, default=0.0)):
        return None
    most = max(top, default=0.0)
    most += 1e-6 * (1 + most)  # distances are of single precision
    if book.measures is None:
        held, left = coded.where(_within(gaps, near, most)), near
    else:
        size, reach, radius, error = book.measures.T
        left = [i for i in near if gaps[i] - reach[i] <= most]
        held = coded.where(_within(gaps, left, most))
        told = np.sqrt(gaps**2 + radius**2) - error > most  # lists whose typical row its codes show to be too far
        if 2 * sum(size[i] for i in left if told[i]) < sum(size[i] for i in left):
            return held  # the codes would spare too little
    return estimated(held, left).where(F.sqrt("_e") - F.col("error") <= most).drop("_e")
