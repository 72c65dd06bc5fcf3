"""Adaptation, explanation, experiments and checks, against brute force where there is one."""

from itertools import combinations
from math import factorial, log, log1p

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlens import functions as fn
from flowlens.operators import adaptation as A
from flowlens.operators import explain
from flowlens.operators import experiment as X
from flowlens.operators import graph as G
from flowlens.operators import scoring as C
from flowlens.operators import splits as S
from flowlens.sources import raw

HOUR = 3600


class ByColumn:
    """A model without parameters: the score is a column, turned round if later labels say so."""

    def fit(self, train, val=None):
        up, down = train.agg(F.avg(F.when(F.col("label") == 1, F.col("x"))), F.avg(F.when(F.col("label") == 0, F.col("x")))).first()
        self.sign = 1.0 if (up or 0) >= (down or 0) else -1.0
        return self

    def score(self, df):
        return df.withColumn("score", F.col("x") * self.sign)


def stream(spark, drift_at=200):
    """An hour a row; before the drift high x means label 1, after it low x, and x is shifted."""
    base = (F.pmod(F.xxhash64("tx_id"), F.lit(1000)) / 1000.0).cast("double")
    df = spark.range(400).select(F.col("id").alias("tx_id"), (F.col("id") * HOUR).alias("t")).withColumn("u", base)
    late = F.col("tx_id") >= drift_at
    return df.select("tx_id", "t", F.when(late, F.col("u") + 3).otherwise(F.col("u")).alias("x"), F.when(late, F.col("u") < 0.2).otherwise(F.col("u") > 0.8).cast("int").alias("label")).cache()


def test_walk_forward_detects_retrains_and_recovers(spark):
    df = stream(spark)
    walk = A.walk_forward(df, ["x"], ByColumn, 100 * HOUR, 40 * HOUR, A.Level(1.0), A.retrain(min_positives=3), 0.1, embargo=2 * HOUR)
    records = spark.createDataFrame(walk.records, A.RECORD).collect()
    assert [r["window"] for r in records] == list(range(8)) and sum(r["n"] for r in records) == 300
    assert all(r["trained_until"] < r["start"] - 2 * HOUR for r in records)
    alarm = next(r for r in records if r["alarm"])
    assert alarm["end"] > 200 * HOUR and not any(r["alarm"] for r in records if r["end"] <= 200 * HOUR)
    late = [r for r in records if r["version"] and r["end"] > 300 * HOUR]
    assert late and all(r["static_pr_auc"] == pytest.approx(r["adaptive_pr_auc"]) or r["adaptive_pr_auc"] > r["static_pr_auc"] for r in late)
    found = A.accounting(spark.createDataFrame(walk.records, A.RECORD), 200 * HOUR, walk.reference_pr_auc).first()
    assert found["detected_at"] == alarm["end"] and found["false_alarms"] == 0 and found["lost_static"] >= found["lost_adaptive"]


def test_policies(spark):
    df = stream(spark)
    recent = df.where("tx_id between 150 and 190").withColumn("score", F.col("x"))
    moment = A.Moment(191 * HOUR, df.where("tx_id < 191"), recent.drop("label"), 0.5, 0.1, ByColumn)
    assert A.static()(moment).fit is None
    level = A.recalibrate()(moment).threshold
    assert recent.where(F.col("score") >= level).count() == pytest.approx(4.1, abs=1)
    every, last = A.retrain(min_positives=1)(moment), A.retrain(20 * HOUR, 1)(moment)
    assert (every.fit.rows, last.fit.rows) == (191, 21) and every.threshold is not None
    assert A.retrain(min_positives=10**6)(moment).action.startswith("retrain all: skipped")
    with pytest.raises(A.LabelLeak):
        A.fit_chronological(ByColumn, df, 100 * HOUR)
    with pytest.raises(ValueError):
        A.fit_chronological(ByColumn, df.where("false"), 100 * HOUR)
    with pytest.raises(ValueError):
        A.budget_threshold(recent.where("false"), 0.1)


def test_contributions_come_from_patterns_of_passed_splits(monkeypatch):
    """Tables of patterns give the numbers of every row's own polynomial."""
    rng = np.random.default_rng(3)
    found = [explain.Leaf(float(rng.normal()), tuple((f, -0.5 * f, 1.0 + f, float(rng.uniform(0.2, 0.9))) for f in range(d))) for d in (0, 1, 2, 4)]
    x, asked = rng.normal(size=(500, 4)), []
    own = explain._shares
    monkeypatch.setattr(explain, "_shares", lambda leaf, passes: asked.append(passes.shape[1]) or own(leaf, passes))
    fast, base = explain.shapley(found, x)
    assert asked == [2, 4, 16]
    monkeypatch.setattr(explain, "PATTERNS", 0)
    slow, same = explain.shapley(found, x)
    assert (fast == slow).all() and base == same


def test_tree_contributions_match_coalitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5) | (x[:, 2] > 1)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "tx_id long, a double, b double, c double, d double, label int")
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="v").transform(df)
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(rows)
    leaves = explain.leaves(model)

    def value(row, known):
        return sum(leaf.value * np.prod([(low < row[f] <= high) if f in known else share for f, low, high, share in leaf.path]) for leaf in leaves)

    got = {r["tx_id"]: r for r in explain.tree_contributions(model, rows.where("tx_id < 12"), list("abcd"), "v").collect()}
    margin = {r["tx_id"]: r["rawPrediction"][1] for r in model.transform(rows.where("tx_id < 12")).collect()}
    for i in range(12):
        parts = {c["feature"]: c["contribution"] for c in got[i]["contributions"]}
        assert got[i]["base"] + sum(parts.values()) == pytest.approx(margin[i])
        for f, name in enumerate("abcd"):
            others = [g for g in range(4) if g != f]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (value(x[i], {*s, f}) - value(x[i], set(s))) for k in range(4) for s in combinations(others, k))
            assert parts[name] == pytest.approx(want)


def test_graph_features_of_all_periods_match_brute_force(spark):
    rng = np.random.default_rng(7)
    tx = [(i, int(a), int(b), int(t), float(w)) for i, (a, b, t, w) in enumerate(zip(rng.integers(0, 9, 40), rng.integers(0, 9, 40), np.sort(rng.integers(0, 5 * 86400, 40)), rng.integers(1, 90, 40), strict=True))]
    got = {r["tx_id"]: r for r in G.graph_features(spark.createDataFrame(tx, "tx_id long, src long, dst long, t long, amount double")).collect()}
    for i, s, d, t, _ in tx:
        past = [r for r in tx if r[3] < t // 86400 * 86400]
        pairs = {(a, b) for _, a, b, _, _ in past}
        nodes = sorted({n for p in pairs for n in p})
        reach = {n: {n} for n in nodes}
        for _ in nodes:
            for a, b in pairs:
                for n in nodes:
                    if a in reach[n]:
                        reach[n].add(b)
        scc = {n: frozenset(m for m in reach[n] if n in reach[m]) for n in nodes}
        out, inn = {n: [b for a, b in pairs if a == n] for n in nodes}, {n: [a for a, b in pairs if b == n] for n in nodes}
        rank = dict.fromkeys(nodes, 1 / max(1, len(nodes)))
        for _ in range(50):
            loose = sum(rank[n] for n in nodes if not out[n]) / max(1, len(nodes))
            rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a in inn[n]) + loose) for n in nodes}
        for side, n in (("src", s), ("dst", d)):
            weight = lambda k: sum(r[4] for r in past if r[k] == n)  # noqa: B023, E731
            iw, ow = weight(2), weight(1)
            o, k = len(out.get(n, ())), len(inn.get(n, ()))
            want = {
                "in_degree": k, "out_degree": o, "in_tx": sum(r[2] == n for r in past), "out_tx": sum(r[1] == n for r in past), "log_in_weight": log1p(iw), "log_out_weight": log1p(ow),
                "degree_asymmetry": (o - k) / (o + k + 1), "flow_through": min(iw, ow) / max(iw, ow) if max(iw, ow) else 0, "reciprocal_partners": sum(m in inn[n] for m in out.get(n, ())),
                "pagerank": rank.get(n, 0) * len(nodes), "log_scc_size": log(len(scc[n])) if n in scc else 0,
                "nbr_out_degree_mean": np.mean([len(out[m]) for m in out[n]]) if o else 0, "nbr_in_degree_mean": np.mean([len(inn[m]) for m in inn[n]]) if k else 0,
            }
            for c, v in want.items():
                assert got[i][f"{side}_{c}"] == pytest.approx(v), (i, side, c)
        assert got[i]["closes_cycle"] == int(s in scc and d in scc[s] and len(scc[s]) > 1)
        assert got[i]["reverse_edge_exists"] == int((d, s) in pairs) and got[i]["prior_pair_tx"] == sum(r[1:3] == (s, d) for r in past)


def test_canary_and_future_edges(spark):
    df = stream(spark, 10**6)
    honest = S.leakage_canary(lambda train, test: ByColumn().fit(train).score(test), df)
    assert honest["chance"] == pytest.approx(0.2, abs=0.1)
    leaking = S.leakage_canary(lambda train, test: test.withColumn("score", F.col("label").cast("double")), df, shuffles=1)
    assert leaking["ratio"] > 3
    edges = spark.createDataFrame([(1, 2, 50)], "src long, dst long, last_t long")
    assert S.assert_no_future_edges(edges, 51).count() == 1
    with pytest.raises(AssertionError):
        S.assert_no_future_edges(edges, 50)
    with pytest.raises(ValueError):
        S.assert_no_future_edges(edges.drop("last_t"), 50)


def test_ring_scorer_stacker_and_edge_inputs(spark):
    rings = spark.createDataFrame([(i, i / 20.0, float(i % 3), int(i > 9)) for i in range(20)], "ring_id long, mean_score double, size double, y int")
    scored = C.RingScorer(["mean_score", "size"]).fit(rings).score(rings)
    assert scored.where("y = 1").agg(F.min("score")).first()[0] > scored.where("y = 0").agg(F.max("score")).first()[0]
    for few in (rings.limit(4), rings.where("y = 1")):
        plain = C.RingScorer(["mean_score"]).fit(few)
        assert plain.model is None and plain.score(few).where("score <> mean_score").count() == 0
    rows = [(i, "val" if i % 2 else "test", int(i % 7 == 0), 0.9 if i % 7 == 0 else 0.2, (i * 37 % 100) / 100, (i * 11 % 100) / 100) for i in range(200)]
    out, weights = C.stack(spark.createDataFrame(rows, "tx_id long, fold string, label int, a double, b double, c double"), ["a", "b", "c"])
    assert weights["a"] > max(abs(weights["b"]), abs(weights["c"])) and out.where("score < 0 or score > 1").count() == 0
    train = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, float("nan"))], "x double, z double")
    made = C.EdgeInputs(["x", "z"]).fit(train)
    got = made.transform(spark.createDataFrame([(1e300, None), (None, 5.0)], "x double, z double")).collect()
    assert made.flagged == ["z"] and got[0]["e_x"] == 10.0 and got[0]["e_z"] == 0.0 and got[0]["missing_z"] == 1.0 and got[1]["e_x"] == 0.0


def test_settings_runs_and_artefacts(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown setting colour; .*no room.*; the embargo.*; split_on"):
        X.Settings.of({"colour": 1, "train_frac": 0.9, "embargo_hours": 1, "split_on": "id"})
    path = tmp_path / "settings.json"
    path.write_text('{"seeds": [1, 2], "budget": 5}')
    settings = X.load_settings(spark, str(path))
    assert settings.seeds == (1, 2) and settings.budget == 5
    split = X.prepare(stream(spark, 10**6), lambda tx: tx.withColumn("y", F.col("label")), settings)
    with pytest.raises(ValueError, match="dropped"):
        X.prepare(stream(spark), lambda tx: tx.drop("label"))
    runs = X.run_experiment("m", lambda rows, seed: rows.where("fold <> 'train'").withColumn("score", F.col("x")), split, settings)
    assert runs.count() == 4 and {r["seed"] for r in runs.collect()} == {1, 2}
    table = X.format_table(runs).collect()
    assert {r["fold"] for r in table} == {"val", "test"} and all(r["pr_auc"] == "1.0000 ± 0.0000" for r in table)
    X.save_run(runs, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "per_seed")).count() == 4
    newest = X.latest(spark.createDataFrame([("m", 1, 0.1), ("m", 2, 0.2), ("n", 1, 0.3)], "model string, run_at int, v double"))
    assert sorted((r["model"], r["run_at"]) for r in newest.collect()) == [("m", 2), ("n", 1)]
    assert X.monitored_columns(["amount", "src_n_hist", "hour", "prior_pair_tx"]) == ["amount", "hour"]
    assert X.bulk_load(stream(spark), spark.createDataFrame([(1, 0.5)], "tx_id long, score double"), "v1", "loaded_scores") == 400
    assert X.bulk_load(stream(spark), spark.createDataFrame([(1, 0.75)], "tx_id long, score double"), "v2", "loaded_scores") == 400
    with pytest.raises(Exception, match="cannot be resolved|nothing"):
        X.bulk_load(stream(spark), spark.range(1).withColumnRenamed("id", "nothing"), "v3", "loaded_scores")  # the old table stays
    assert spark.table("loaded_scores").where("score = 0.75 and model_version = 'v2'").count() == 1
    spark.sql("DROP TABLE loaded_scores")


def test_source_order_and_names(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([5, 6, 6, 4, 7, 6])], "i long, timestamp long")
    assert sorted(r["i"] for r in raw.out_of_order(rows, "i").collect()) == [3, 5]
    names = ["log_amount", "is_cross_bank", "src_out_cnt_24h", "dst_pagerank", "other_name"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fn.feature_label(F.col("n"))).collect()]
    assert got == ["Amount (log USD)", "Sender and receiver at different banks", "Sender's payments: count, last 24h", "Receiver: PageRank (earlier graph)", "other name"]


def test_search_and_subsample(spark):
    df = stream(spark, 10**6)
    train, val = df.where("tx_id < 250"), df.where("tx_id >= 250")
    best, log = C.random_search(train, val, lambda p: C.MlScorer("logistic", ["x"], **p), {"regParam": [0.01, 0.1, 10.0]}, trials=3, seed=1)
    assert len(log) == 3 and best in [p for p, _ in log] and max(v for _, v in log) == dict((str(p), v) for p, v in log)[str(best)]
    few = C.subsample_negatives(df, 0.3, 5)
    assert few.where("label = 1").count() == df.where("label = 1").count() and 0.2 < few.where("label = 0").count() / df.where("label = 0").count() < 0.4
    assert few.exceptAll(C.subsample_negatives(df.repartition(3), 0.3, 5)).count() == 0
