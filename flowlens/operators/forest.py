"""Random forests over counted cells.

Values are binned once, by quantiles of the training rows; rows with equal bins
make one cell with its counts by label, so work follows the distinct cells.  A
bootstrap gives every row a Poisson number of copies; those of a cell's rows add
up to a Poisson number, too, which is drawn for the cell at once.  All trees grow
a level a job: every task adds up its cells by tree, node, column and bin, one
shuffle adds up the tasks, and a tree's splits are picked where its sums meet.
Only the splits reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bins of a column.
BINS = 32
_BLOCKS = "block long, bins binary, counts binary"
_SUMS = "tree int, slots binary, sums binary"


@dataclass(frozen=True)
class Params:
    """``share``: mean number of copies of a row in a tree's bootstrap; None takes every row once."""

    trees: int = 300
    depth: int = 10
    share: float | None = 0.8
    seed: int = 0


class Tree:
    """Nodes in the order of a full binary tree: column (-1 a leaf), last bin that goes left, share of positives."""

    def __init__(self, depth: int):
        n = (1 << (depth + 1)) - 1
        self.column, self.cut, self.value = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.float32)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after ``levels`` steps, earlier where that is a leaf."""
        at, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
        for _ in range(levels):
            c = self.column[at]
            at = np.where(c < 0, at, 2 * at + 1 + (bins[rows, c] > self.cut[at]))
        return at


def _matrix(bins: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bins), np.uint8).reshape(-1, width)


def _columns(tree: int, first: int, n: int, width: int, seed: int) -> np.ndarray:
    """The columns that each of a level's ``n`` nodes may split on: as many as the root of their number."""
    rng = np.random.default_rng([seed, 1, tree, first])
    return np.sort(rng.random((n, width)).argsort(axis=1)[:, : math.ceil(math.sqrt(width))], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells packed by batch."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        counts = np.column_stack([batch.column(c).to_numpy() for c in ("neg", "pos")]).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([b"".join(batch.column("bins").to_pylist())], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["block", "bins", "counts"])


def _level(trees: list[Tree], level: int, width: int, p: Params):
    """Sums of copies by node, place of the column and bin, a row a tree: what a task's cells add."""
    first, n = (1 << level) - 1, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in batch.to_pylist()]
        if not held:
            return
        bins = _matrix([r["bins"] for r in held], width)
        counts = [np.frombuffer(r["counts"], "<i8").reshape(-1, 2) for r in held]
        for k, tree in enumerate(trees):
            if level and not (tree.column[(first - 1) // 2 : first] >= 0).any():
                continue
            drawn = counts if p.share is None else [np.random.default_rng([p.seed, 0, k, r["block"]]).poisson(p.share * c) for r, c in zip(held, counts, strict=True)]
            copies = np.concatenate(drawn)
            some = np.flatnonzero(copies.any(axis=1))
            own = bins[some]
            at = tree.nodes(own, level)
            here = at >= first
            own, at, copies = own[here], at[here] - first, copies[some[here]].astype(np.float64)
            columns = _columns(k, first, n, width, p.seed)
            places = columns.shape[1]
            total, rows = np.zeros((n * places * BINS, 2), np.int64), np.arange(len(at))
            for j in range(places):
                slot = (at * places + j) * BINS + own[rows, columns[at, j]]
                for c in (0, 1):
                    total[:, c] += np.bincount(slot, copies[:, c], len(total)).astype(np.int64)
            slots = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([slots.astype("<i4").tobytes()], pa.binary()), pa.array([total[slots].astype("<i8").tobytes()], pa.binary())], ["tree", "slots", "sums"])

    return run


def _pick(level: int, width: int, weights: tuple[float, float], p: Params):
    """The splits of a tree's level by Gini impurity, from the sums of all tasks."""
    first, n = (1 << level) - 1, 1 << level

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        columns = _columns(int(key[0]), first, n, width, p.seed)
        total = np.zeros((n * columns.shape[1] * BINS, 2))
        for slots, sums in zip(rows["slots"], rows["sums"], strict=True):
            total[np.frombuffer(slots, "<i4")] += np.frombuffer(sums, "<i8").reshape(-1, 2)
        left = (total * weights).reshape(n, -1, BINS, 2).cumsum(axis=2)
        whole = left[:, :1, -1:]
        left, right = left[:, :, :-1], whole - left[:, :, :-1]
        pure = lambda s: (s**2).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1e-300)  # noqa: E731  (size times the chance that two rows agree)
        gain = pure(left) + pure(right) - pure(whole)
        gain[(left.sum(axis=-1) <= 0) | (right.sum(axis=-1) <= 0)] = 0.0
        flat = gain.reshape(n, -1)
        best = flat.argmax(axis=1)
        split = np.flatnonzero(flat[np.arange(n), best] > 1e-9 * np.maximum(whole[:, 0, 0].sum(axis=-1), 1e-300))
        j, b = best[split] // (BINS - 1), best[split] % (BINS - 1)
        share = lambda s: s[:, 1] / np.maximum(s.sum(axis=1), 1e-300)
        return pd.DataFrame({
            "tree": np.full(len(split), key[0], np.int32), "node": (first + split).astype(np.int32), "column": columns[split, j].astype(np.int32), "cut": b.astype(np.int32),
            "own": share(whole[split, 0, 0]), "left": share(left[split, j, b]), "right": share(right[split, j, b]),
        })

    return run


@dataclass
class Forest:
    """A scorer on numeric columns, imputed by the median, with flags of missing ones; labels weigh the same in sum."""

    features: list[str]
    label: str = "label"
    params: Params = field(default_factory=Params)
    trees: list[Tree] = field(default_factory=list)

    def _binned(self, df: DataFrame, *keep: str) -> DataFrame:
        edges = [np.array(e) for e in self.edges]

        def place(*columns: pd.Series) -> pd.Series:
            half = len(columns) // 2
            out = np.empty((len(columns[0]), len(columns)), np.uint8)
            for f in range(half):
                out[:, f] = np.searchsorted(edges[f], columns[f].to_numpy(np.float64))
                out[:, half + f] = columns[half + f].to_numpy()
            return pd.Series([r.tobytes() for r in out])

        value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        values = [F.coalesce(value(f), F.lit(m)) for f, m in zip(self.features, self.medians, strict=True)]
        return df.select(*keep, F.pandas_udf(place, "binary")(*values, *[F.col(f).isNull().cast("int") for f in self.features]).alias("bins"))

    def cells(self, train: DataFrame) -> DataFrame:
        """bins, neg and pos: the distinct binned rows with their counts."""
        at = [0.5, *(i / BINS for i in range(1, BINS))]
        value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        found = train.agg(*[F.percentile_approx(value(f), at, 10_000).alias(f) for f in self.features]).first()
        self.medians = [found[f][0] if found[f] else 0.0 for f in self.features]
        self.edges = [sorted(set(found[f][1:])) if found[f] else [] for f in self.features]
        y = F.col("y") == 1
        return self._binned(train.select(F.col(self.label).alias("y"), *self.features), "y").groupBy("bins").agg(F.count_if(~y).alias("neg"), F.count_if(y).alias("pos"))

    def fit(self, train: DataFrame) -> Forest:
        p, width = self.params, 2 * len(self.features)
        parts = train.sparkSession.sparkContext.defaultParallelism
        # The blocks and so the draws are the same in every run with as many parts.
        packed = self.cells(train).repartition(parts, "bins").sortWithinPartitions("bins").mapInArrow(_blocks, _BLOCKS)
        blocks = materialize(packed, "forest-cells")
        neg, pos = self._labels(blocks)
        weights = (neg + pos) / (2.0 * max(neg, 1)), (neg + pos) / (2.0 * max(pos, 1))
        self.trees = [Tree(p.depth) for _ in range(p.trees)]
        for tree in self.trees:
            tree.value[0] = 0.5 if neg and pos else float(pos > 0)
        for level in range(p.depth):
            sums = blocks.mapInArrow(_level(self.trees, level, width, p), _SUMS)
            made = sums.groupBy("tree").applyInPandas(_pick(level, width, weights, p), "tree int, node int, column int, cut int, own double, left double, right double").collect()
            for r in made:
                tree, node = self.trees[r["tree"]], r["node"]
                tree.column[node], tree.cut[node] = r["column"], r["cut"]
                tree.value[[node, 2 * node + 1, 2 * node + 2]] = r["own"], r["left"], r["right"]
            if not made:
                break
        return self

    def _labels(self, blocks: DataFrame) -> tuple[int, int]:
        """Training rows by label."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = sum((np.frombuffer(c, "<i8").reshape(-1, 2).sum(axis=0) for c in batch.column("counts").to_pylist()), np.zeros(2, np.int64))
                yield pa.RecordBatch.from_pydict({"neg": both[:1], "pos": both[1:]})

        found = blocks.mapInArrow(add, "neg long, pos long").agg(F.sum("neg"), F.sum("pos")).first()
        return found[0] or 0, found[1] or 0

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score, the mean of the trees' shares of positives."""
        trees, width, depth = self.trees, 2 * len(self.features), self.params.depth

        def mean(bins: pd.Series) -> pd.Series:
            cells, place = np.unique(bins.to_numpy(), return_inverse=True)
            matrix = _matrix(list(cells), width)
            return pd.Series(sum((t.value[t.nodes(matrix, depth)].astype(np.float64) for t in trees), np.zeros(len(matrix)))[place] / max(len(trees), 1))

        return self._binned(df, *[c for c in df.columns if c != "score"]).withColumn("score", F.pandas_udf(mean, "double")("bins")).drop("bins")
