import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics, rings, scoring
from flowlens.operators import set_similarity as J


def brute(left, right, theta):
    out = {}
    for p, a in left:
        for t, b in right:
            x, y = set(a or ()) - {None}, set(b or ()) - {None}
            if x & y and len(x & y) / len(x | y) >= theta:
                out[p, t] = len(x & y) / len(x | y)
    return out


def sets(seed, n):
    rng = random.Random(seed)
    base = [[rng.randrange(12) if rng.random() < 0.6 else rng.randrange(200) for _ in range(rng.randrange(1, 9))] for _ in range(n)]
    base += [[*x, rng.randrange(200)] for x in base[: n // 2]] + [list(x) for x in base[: n // 4]]
    return [*enumerate(base), (900, None), (901, []), (902, [None, 5]), (903, [0] * 4)]


@pytest.mark.parametrize("theta", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_pairs_equal_brute_force(spark, monkeypatch, theta):
    monkeypatch.setattr(J, "HOT", 8)
    left, right = sets(1, 40), sets(2, 40) + [(1000 + i, m) for i, m in sets(1, 10)]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, members array<long>").repartition(3)
    got = {(r["pid"], r["tid"]): r["jaccard"] for r in J.similar_pairs(make(left, "pid"), make(right, "tid"), theta).collect()}
    assert got == pytest.approx(brute(left, right, theta))


def test_a_common_member_makes_no_pairs(spark):
    """A member of all sets is in no prefix, so that it brings no candidates."""
    rows = [(i, [0, *range(10 * i + 1, 10 * i + 6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, members array<long>")
    counts = df.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("df"))
    left, _ = J._ordered(df, "pid", counts)
    assert J.candidate_classes(left, left, 0.5).count() == 300


def test_odd_arguments(spark):
    df = spark.createDataFrame([(1, [1])], "pid long, members array<long>")
    with pytest.raises(ValueError):
        J.similar_pairs(df, df.withColumnRenamed("pid", "tid"), 0.0)
    assert J.similar_pairs(df.where("false"), df.withColumnRenamed("pid", "tid"), 0.5).count() == 0


def test_jaccard_of_all_pairs_works_through_no_array_a_member(spark):
    """Sizes come from counted rows: an array function above the generator would make large sets quadratic."""
    left, right = sets(5, 30), sets(6, 30)
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, members array<long>")
    made = metrics.jaccard_pairs(make(left, "pid"), make(right, "tid"))
    assert "array_distinct" not in made._jdf.queryExecution().executedPlan().toString()
    found = {(r["pid"], r["tid"]): r["jaccard"] for r in made.collect()}
    plain = {}
    for p, a in left:
        for t, b in right:
            x, y = set(a or ()), set(b or ())
            if (x & y) - {None}:
                plain[p, t] = len((x & y) - {None}) / (len(x) + len(y) - len((x & y) - {None}))
    assert found == pytest.approx(plain)


def test_many_candidates_are_counted_not_laid_side_by_side(spark, monkeypatch):
    """Counted meetings give the pairs of compared arrays."""
    left, right = sets(7, 40), sets(8, 40)
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, members array<long>")
    monkeypatch.setattr(J, "BESIDE", 0)
    made = J.similar_pairs(make(left, "pid"), make(right, "tid"), 0.1)
    assert "array_intersect" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["pid"], r["tid"]): r["jaccard"] for r in made.collect()} == pytest.approx(brute(left, right, 0.1))


def test_sets_that_share_little_are_no_candidates(spark):
    """One shared member early in both prefixes is not enough: the others would have to be behind them."""
    sets_ = lambda k, name: spark.createDataFrame([(i, [i % 7, *range(k + 100 * i, k + 100 * i + 40)]) for i in range(30)], f"{name} long, members array<long>")
    p, t = sets_(10_000, "pid"), sets_(90_000, "tid")
    counts = p.select(F.explode("members").alias("m")).unionAll(t.select(F.explode("members").alias("m"))).groupBy("m").agg(F.lit(1).cast("long").alias("df"))
    assert J.candidate_classes(J._ordered(p, "pid", counts)[0], J._ordered(t, "tid", counts)[0], 0.3).count() == 0


def test_peeling_of_cycles_sends_no_accounts_through_the_driver(spark, monkeypatch):
    """Rounds join by sorting, so that nothing is broadcast however small a round looks."""
    plans, own = [], rings.materialize
    monkeypatch.setattr(rings, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    rows = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 2), (2, 2, 3), (3, 4, 4)]
    made = rings.has_cycle(spark.createDataFrame(rows, "ring_id long, src long, dst long"))
    assert {r["ring_id"]: r["has_cycle"] for r in made.collect()} == {1: 1, 2: 0, 3: 1}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_scorers_keep_the_columns_of_their_rows(spark):
    """Scores come without a join, and inputs under a logarithm stay as they were; missing ones are imputed."""
    rows = [(i, float(i % 9) if i % 10 else None, int(i % 9 > 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "tx_id long, x double, label int")
    scored = scoring.MlScorer("logistic", ["x"]).fit(df).score(df)
    assert scored.columns == ["tx_id", "x", "label", "score"]
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r["tx_id"]: (r["x"], r["score"]) for r in scored.collect()}
    assert {i: v[0] for i, v in got.items()} == {i: x for i, x, _ in rows}
    assert got[8][1] > 0.5 > got[1][1]
