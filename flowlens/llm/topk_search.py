"""Exact top-k search by inner product without random access.

A block of vectors holds one list a dimension, sorted by component.  A query
reads the lists sequentially, each from the end that its component favours, a
slice of every list at a time.  What a vector has shown so far plus the least
that its unread components can add is its lower bound, with the most its upper
bound.  Lower bounds grow with the entries that are read; upper bounds are taken
once no unseen vector can reach the k-th lower bound, and then for those vectors
only that can still reach it.  A query stops when few are left; their final
scores are then resolved.  The k-th score found in a partition so far carries
over to its next blocks.

Bounds are integers that doubles hold exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path

#: Queries that are handed to the executors at once; further ones take further passes.
QUERY_BLOCK = 4096
#: Blocks of queries in one plan; the results of more are stored plan by plan.
PLAN_BLOCKS = 8
#: Shares of the lists up to which a query reads before it looks at its bounds.
STRIDES = (0.03125, 0.125, 0.25, 0.5, 0.75, 0.875, 0.9375, 1.0)
#: Vectors a query may leave to the final resolution, in multiples of k.
LEFT = 8


class SortedLists:
    """A block of integer vectors (as doubles) with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.lists = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        # Every list from its upper end, then every list from its lower one.
        self.rows, self.values = np.hstack([order[::-1], order]).astype(np.int32), np.hstack([self.lists[::-1], self.lists])
        self.depths = sorted({max(1, int(np.ceil(n * s))) for s in STRIDES})

    def search(self, query: np.ndarray, k: int, floor: float, own: int) -> tuple[np.ndarray, int, int]:
        """The rows that may be among the k best (scores not under ``floor``), how deep the lists were read, and how many entries."""
        n, dims = self.vectors.shape
        up = query >= 0
        end = np.where(up, 0, dims) + np.arange(dims)
        first, last = np.where(up, self.lists[-1], self.lists[0]) * query, np.where(up, self.lists[0], self.lists[-1]) * query
        lower = np.full(n, last.sum())  # each entry that is read takes the place of its list's least
        hidden = self.ids == own
        alive, before, touched = np.flatnonzero(~hidden), 0, 0
        for depth in self.depths:
            rows = self.rows[before:depth].take(end, axis=1)
            shown = self.values[before:depth].take(end, axis=1)
            lower += np.bincount(rows.ravel(), (shown * query - last).ravel(), n)
            touched += rows.size
            before = depth
            if depth == n:
                bar = first * 0.0
            else:
                bar = np.where(up, self.lists[n - 1 - depth], self.lists[depth]) * query
            known = lower[alive]
            least = max(np.partition(known, len(known) - k)[len(known) - k] if len(known) > k else -np.inf, floor)
            # An unseen vector has at most the sum of the lists' next entries.
            if depth < n and bar.sum() >= least:
                continue
            upper = known
            if depth < n:
                place = self.place[alive]
                upper = known + np.where(up, place < n - depth, place >= depth) @ (bar - last)
            alive = alive[upper >= least]
            if len(alive) <= LEFT * k or depth == n:
                break
        return alive, before, touched

    def best(self, queries: np.ndarray, k: int, floor: np.ndarray, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The rows for each query, and how deep its lists were read."""
        found = [self.search(q, k, f, i) for q, f, i in zip(queries, floor, own, strict=True)]
        return [r for r, _, _ in found], np.array([d for _, d, _ in found])


def _integers(column: pd.Series, dims: int) -> np.ndarray:
    """floor(1024 * x) of every component as a double that holds an integer; short vectors get zeros."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = np.floor(1024.0 * np.asarray(v, dtype=np.float64))
    return out


def _exact_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products in whole numbers, within the range of a long."""
    most = np.abs(vectors).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if most < 2.0**53:
        return (vectors @ query).astype(np.int64).tolist()
    whole = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors]
    return [min(max(x, -(2**63)), 2**63 - 1) for x in whole]


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        floor = np.full(len(query_ids), -np.inf)
        for batch in batches:
            if not len(batch):
                continue
            dims = max(queries.shape[1], max(len(v) for v in batch["vector"]))
            wide = np.zeros((len(queries), dims))
            wide[:, : queries.shape[1]] = queries
            ids, vectors = batch["vec_id"].to_numpy(np.int64), _integers(batch["vector"], dims)
            exact = np.abs(vectors).max(initial=0.0) * np.abs(wide).max(initial=0.0) * max(1, dims) < 2.0**52
            lists = SortedLists(ids, vectors) if exact and dims else None
            for i, (q, own) in enumerate(zip(wide, query_ids, strict=True)):
                r = np.flatnonzero(ids != own) if lists is None else lists.search(q, k, floor[i], own)[0]
                if len(r):
                    scored = zip(_exact_scores(vectors[r], q), ids[r].tolist(), strict=True)
                    found[i] = sorted(found[i] + list(scored), key=lambda x: (-x[0], x[1]))[:k]
                    if len(found[i]) == k:
                        floor[i] = found[i][-1][0]
        for q, hits in zip(query_ids.tolist(), found, strict=True):
            if hits:
                yield pd.DataFrame({"query_id": q, "vec_id": [v for _, v in hits], "score": [s for s, _ in hits]})

    return run


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector has finite components only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best ``vectors`` for every query.

    Both have vec_id and vector.  A query's own vec_id is left out; ties go to
    the smaller vec_id; fewer than k others give fewer rows.  Rows that repeat
    a vec_id are candidates one by one, but queries go by vec_id (the least of
    the repeated rows' vectors).  Shorter vectors count as padded with zeros.  Scores beyond
    the range of a long are clamped.  Without vectors or queries the result is
    empty.
    """
    spark = vectors.sparkSession
    chosen = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = -(-chosen.count() // QUERY_BLOCK)
    empty = spark.createDataFrame([], "query_id long, vec_id long, score long")
    path = scratch_path(spark, "top-k") if blocks > PLAN_BLOCKS else None
    merged = empty
    for b in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        dims = max((len(v) for v in block["vector"]), default=0)
        run = _search(block["vec_id"].to_numpy(np.int64), _integers(block["vector"], dims), k)
        merged = merged.unionByName(vectors.select("vec_id", "vector").mapInPandas(run, "query_id long, vec_id long, score long"))
        if path and (b % PLAN_BLOCKS == PLAN_BLOCKS - 1 or b == blocks - 1):
            _ranked(merged, k).drop("rank").write.mode("append").parquet(path)
            merged = empty
    return _ranked(spark.read.schema(empty.schema).parquet(path) if path else merged, k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
