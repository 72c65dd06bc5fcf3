"""Contributions of features to the margin of boosted trees: exact Shapley values of every tree.

A leaf contributes to a coalition of features the product, over the features on
its path, of one or zero for a member (the row passes the path's splits on it or
not) and of the share of training rows that pass for the others.  That game's
Shapley values come from the coefficients of a small polynomial, for all rows of
a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """Its value (times the tree's weight), and for each feature on its path: bounds low < x <= high, share of rows."""

    value: float
    path: tuple[tuple[int, float, float, float], ...]


def leaves(model: object) -> list[Leaf]:
    """The leaves of a fitted Spark tree ensemble (bounded by the model's size)."""
    found: list[Leaf] = []

    def walk(node: object, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            found.append(Leaf(weight * node.prediction(), tuple((f, *b) for f, b in sorted(path.items()))))
            return
        split, whole = node.split(), node.impurityStats().count()
        f, cut = split.featureIndex(), split.threshold()
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, own in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, weight, path | {f: (*own, share * child.impurityStats().count() / max(whole, 1e-300))})

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), weight, {})
    return found


#: Features on a path up to which a leaf's contributions are worked out once for every pattern of passed splits.
PATTERNS = 8


def _shares(leaf: Leaf, passes: np.ndarray) -> np.ndarray:
    """Contributions of the features on a leaf's path (path by columns of ``passes``)."""
    d, n = passes.shape
    share = [p[3] for p in leaf.path]
    order = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.zeros((d, n))
    for i in range(d):
        sums = np.zeros((d, n))  # by size of the coalition, of products over the other features
        sums[0] = 1.0
        for j in range(d):
            if j != i:
                sums[1:] = sums[1:] * share[j] + sums[:-1] * passes[j]
                sums[0] *= share[j]
        out[i] = leaf.value * (passes[i] - share[i]) * (order @ sums)
    return out


def shapley(found: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions (rows by features) and the expected margin."""
    out, base = np.zeros(x.shape), 0.0
    for leaf in found:
        d = len(leaf.path)
        base += leaf.value * float(np.array([p[3] for p in leaf.path]).prod())
        if not d:
            continue
        passes = np.array([(low < x[:, f]) & (x[:, f] <= high) for f, low, high, _ in leaf.path])
        if d <= PATTERNS:
            # What a leaf gives depends on the splits passed alone.
            made = _shares(leaf, (np.arange(1 << d) >> np.arange(d)[:, None] & 1).astype(float))[:, (1 << np.arange(d)) @ passes]
        else:
            made = _shares(leaf, passes.astype(float))
        for (f, *_), c in zip(leaf.path, made, strict=True):
            out[:, f] += c
    return out, base


def tree_contributions(model: object, rows: DataFrame, names: list[str], vector: str, id_col: str = "tx_id") -> DataFrame:
    """id, base, and contributions (feature, value, contribution) of every row; they add up to the margin.

    ``vector`` holds the model's inputs, named by ``names``.  Rows are read once
    and stay where they are; the leaves go to the executors with the function.
    """
    found = leaves(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            values, base = shapley(found, x)
            n = len(x)
            parts = pa.StructArray.from_arrays([pa.array(names * n, pa.string()), pa.array(x.ravel()), pa.array(values.ravel())], ["feature", "value", "contribution"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), parts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.full(n, base)), lists], [id_col, "base", "contributions"])

    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, base double, contributions array<struct<feature:string,value:double,contribution:double>>"
    x = vector_to_array(F.col(vector))
    return rows.select(id_col, *[x[i].alias(f"x{i}") for i in range(len(names))]).mapInArrow(run, schema)
