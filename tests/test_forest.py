"""Forests over counted cells, against a plain tree and by properties."""

import numpy as np
import pytest

from flowlens.operators.boosting import average_precision
from flowlens.operators.forest import Forest, Params
from flowlens.operators.scoring import MlScorer


def frame(spark, n, seed=0, start=0):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 20, n), rng.integers(0, 20, n)
    y = ((a > 11) ^ (b > 14)) | (rng.random(n) < 0.05)
    rows = [(start + i, float(a[i]), None if b[i] == 3 else float(b[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "tx_id long, a double, b double, label int").repartition(3)


def plain_tree(x, y, w, depth):
    """Every cut of one column by Gini impurity, rows in plain loops."""
    pure = lambda m: ((w[m] * y[m]).sum() ** 2 + (w[m] * (1 - y[m])).sum() ** 2) / w[m].sum()
    whole = np.full(len(x), True)
    best = max(((pure(x <= c) + pure(x > c) - pure(whole), -c) for c in np.unique(x)[:-1]), default=(0.0, 0)) if depth else (0.0, 0)
    if best[0] <= 1e-9:
        return np.full(len(x), (w * y).sum() / w.sum())
    out, left = np.empty(len(x)), x <= -best[1]
    for m in (left, ~left):
        out[m] = plain_tree(x[m], y[m], w[m], depth - 1)
    return out


def test_tree_without_draws_is_a_plain_one(spark):
    df = frame(spark, 600).selectExpr("tx_id", "floor(a / 2) AS a", "label")
    rows = df.orderBy("tx_id").collect()
    x, y = (np.array([r[c] for r in rows], float) for c in ("a", "label"))
    want = plain_tree(x, y, np.where(y == 1, 300 / y.sum(), 300 / (1 - y).sum()), 3)
    made = Forest(["a"], params=Params(trees=1, depth=3, share=None)).fit(df).score(df)  # two columns: every node sees both
    assert len(set(want)) > 4 and [r["score"] for r in made.orderBy("tx_id").collect()] == pytest.approx(want.tolist(), abs=1e-5)


def test_work_follows_distinct_cells(spark):
    df = frame(spark, 300)
    many = df.selectExpr("explode(sequence(0, 19)) AS k", "*")
    cells = {bytes(r["bins"]): (r["neg"], r["pos"]) for r in Forest(["a", "b"]).cells(df).collect()}
    assert {bytes(r["bins"]): (r["neg"] / 20, r["pos"] / 20) for r in Forest(["a", "b"]).cells(many).collect()} == cells


def test_forest_learns_and_reruns_agree(spark):
    train, test = frame(spark, 800), frame(spark, 300, 1, 1000)
    first, again = (MlScorer("forest", ["a", "b"], numTrees=30, maxDepth=6).fit(train).score(test).orderBy("tx_id").collect() for _ in range(2))
    assert first == again and len(first) == 300 and all(0 <= r["score"] <= 1 for r in first)
    assert average_precision(np.array([r["label"] for r in first]), np.array([r["score"] for r in first])) > 0.9


def test_odd_tables(spark):
    df = frame(spark, 50)
    assert MlScorer("forest", ["a"], numTrees=2).fit(df.where("false")).score(df).where("score = 0").count() == 50
    assert MlScorer("forest", ["a"], numTrees=2).fit(df.where("label = 1")).score(df).where("score = 1").count() == 50
    assert MlScorer("forest", ["a"], numTrees=2).fit(df.selectExpr("tx_id", "cast(null as double) AS a", "label")).score(df).count() == 50
