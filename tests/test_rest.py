import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import functions as fn
from flowlens.operators import drift as D
from flowlens.operators import evidence as E
from flowlens.operators import graph as G
from flowlens.operators import metrics as M
from flowlens.operators import rings as R
from flowlens.operators import scoring as C
from flowlens.operators import splits as S
from flowlens.plans import serving as V


def frame(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("tx_id"), (F.col("id") * 900).alias("t"), (F.col("id") % 50 == 0).cast("int").alias("label"))


def test_split_is_ordered_and_ties_stay_together(spark):
    df = frame(spark)
    for how in ("time", "rows"):
        out = S.temporal_split(df, split_on=how)
        assert S.integrity(out).first()["ordered"]
        assert S.shared_ids(out.where("fold = 'train'"), out.where("fold = 'test'")).count() == 0
    tied = frame(spark, 100).withColumn("t", F.when(F.col("tx_id").between(50, 69), 45000).otherwise(F.col("t")))
    assert S.with_fold(tied, S.boundaries(tied, embargo=0, split_on="rows")).where("t = 45000").select("fold").distinct().count() == 1
    with pytest.raises(ValueError):
        S.temporal_split(df, embargo=10**9)
    with pytest.raises(ValueError):
        S.embargo_covers(86400, [604800])


def test_permuted_labels_keep_the_counts(spark):
    out = S.permuted_labels(frame(spark), 1)
    assert out.count() == 4000 and out.agg(F.sum("label")).first()[0] == 80
    assert out.where("label = 1 and tx_id % 50 = 0").count() < 20


def test_metric_suite(spark):
    scores = np.linspace(0, 1, 1000)
    df = spark.createDataFrame([(float(s), int(i >= 990)) for i, s in enumerate(scores)], "score double, y int")
    r = M.evaluate(df, budget=50).first()
    assert r["n_flagged"] == 51 and r["pr_auc"] > 0.99 and r["roc_auc"] > 0.99
    assert M.evaluate(df.withColumn("y", F.lit(0))).count() == 0


def test_metrics_with_ties_match_brute_force(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 20, 400) / 20.0
    r = M.evaluate(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, y int"), budget=30).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for tau in sorted(set(s), reverse=True):
        hit = s >= tau
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap += (recall - last) * precision
        last = recall
    assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)
    assert r["budget_threshold"] == pytest.approx(np.sort(s)[::-1][30])


def test_ring_metrics_and_early_warning(spark):
    sets = lambda name, rows: spark.createDataFrame(list(enumerate(rows)), f"{name} long, members array<int>")
    p = sets("pid", [[1, 2, 3, 9], [5, 6, 7, 8], [20, 21, 22]])
    t = sets("tid", [[1, 2, 3, 4], [5, 6, 7, 8]])
    r = M.ring_metrics(p, t, (0.5,)).first()
    assert r["ring_recall"] == 1.0 and r["ring_precision"] == pytest.approx(2 / 3)
    ewt = spark.createDataFrame([("a", 30.0), ("b", 10.0), ("c", None), ("d", None)], "ring_id string, ewt_minutes double")
    s = M.summarise_early_warning(ewt).first()
    assert (s["detection_rate"], s["median_ewt_minutes"], s["n_censored"]) == (0.5, 20.0, 2.0)
    rings = spark.createDataFrame([("r", ["A"], 100, 700)], "ring_id string, members array<string>, t_start long, t_end long")
    events = spark.createDataFrame([("A", 10, 0.9), ("A", 400, 0.9), ("A", 900, 0.9)], "account string, t long, score double")
    assert M.early_warning(events, rings, 0.5).first()["ewt_minutes"] == 11.5
    assert M.early_warning(events, rings, 0.5, from_start=True).first()["ewt_minutes"] == 5.0


@pytest.mark.parametrize("bins", [3, 40, 1 << 15])
@pytest.mark.parametrize("seed", [1, 2])
def test_fusion_works_out_only_weights_that_may_be_best(spark, monkeypatch, seed, bins):
    """The best weight is that of a plain count, with ties; bounds hold; few weights are worked out where bins are fine."""
    rng = np.random.default_rng(seed)
    a, b, y = rng.integers(1, 30, 400) / 30, rng.integers(1, 30, 400) / 30, rng.integers(0, 3, 400) == 0
    a = np.clip(a + 0.2 * y, 0.01, 0.99)
    df = spark.createDataFrame([(i, "val", int(v), float(x), float(z)) for i, (x, z, v) in enumerate(zip(a, b, y, strict=True))], "tx_id long, fold string, label int, a double, b double")
    za, zb = ((x - x.mean()) / x.std() for x in (np.log(v / (1 - v)) for v in (a, b)))

    def precision(w):
        score = w * za + (1 - w) * zb
        return sum((y & (score >= s)).sum() / (score >= s).sum() for s in score[y]) / y.sum()

    want = {i / 20: precision(i / 20) for i in range(21)}
    seen, asked = [], []
    real, bounded = C.cumulative, C._weight_bounds
    monkeypatch.setattr(C, "cumulative", lambda df, by: seen.append(df.select("w").distinct().count()) or real(df, by))
    monkeypatch.setattr(C, "_weight_bounds", lambda grid, n: asked.append(bounded(grid, n)) or asked[-1])
    best = C.fuse(df, "a", "b", bins=bins)[1]
    assert want[best] == pytest.approx(max(want.values()), abs=1e-12)
    for r in asked[0].collect():
        assert r["low"] - 1e-9 <= want[r["w"]] <= r["high"] + 1e-9
    if bins > 1000:
        assert sum(seen) < 12


def test_fusion_without_positives(spark):
    df = spark.createDataFrame([(1, "val", 0, 0.2, 0.3), (2, "val", 0, 0.4, 0.1), (3, "test", 1, 0.4, 0.1)], "tx_id long, fold string, label int, a double, b double")
    assert C.fuse(df, "a", "b")[0].count() == 3


def test_psi(spark):
    ref = spark.range(5000).select(F.randn(1).alias("x"))
    assert D.psi(ref, ref, ["x"]).first()["psi"] == pytest.approx(0)
    assert D.psi(ref, spark.range(5000).select(F.randn(2).alias("x")), ["x"]).first()["psi"] < 0.01
    assert D.psi(ref, ref.withColumn("x", F.col("x") + 1), ["x"]).first()["psi"] > 0.5
    flag = lambda p: spark.range(1000).select((F.col("id") % 10 < p).cast("double").alias("x"))
    assert D.psi(flag(1), flag(5), ["x"]).first()["psi"] > 0.25
    gone = ref.withColumn("x", F.when(F.rand(3) < 0.3, None).otherwise(F.col("x")))
    assert D.psi(ref, gone, ["x"]).first()["psi"] > 0.1


def test_detectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000)
    x[500:] += 2
    d = D.PageHinkley(delta=0.5, threshold=10)
    assert 500 <= next(i for i, v in enumerate(x) if d.update(v)) <= 520
    y = rng.normal(size=600)
    y[300:] += 1.5
    a = D.Adwin()
    assert 300 <= next(i for i, v in enumerate(y) if a.update(v)) <= 340


def test_threshold_alarms_with_patience(spark):
    values = spark.createDataFrame([("s", i, x) for i, x in enumerate((0.05, 0.15, 0.3, 0.05, 0.3, 0.4, 0.5))], "stream string, i long, x double")
    assert [r["i"] for r in D.threshold_alarms(values, 0.25, 2).collect()] == [5]
    with pytest.raises(ValueError):
        D.calibrate_threshold(values, 0.01)


def graph_rows(spark, rows):
    return spark.createDataFrame([(i, s, d, t, float(a)) for i, (s, d, t, a) in enumerate(rows)], "tx_id long, src string, dst string, t long, amount double")


def test_graph_cut_off_and_flow(spark):
    tx = graph_rows(spark, [("b", "a", 100, 100), ("a", "c", 200, 90), ("a", "c", 300, 50)])
    assert G.account_graph(tx, 200).count() == 1
    f = {r["node"]: r for r in G.node_features(G.account_graph(tx, 300)).collect()}
    assert f["a"]["flow_through"] == pytest.approx(0.9) and (f["a"]["in_degree"], f["a"]["out_degree"]) == (1, 1)


def test_cycles_and_pairs(spark):
    day = 86400
    tx = graph_rows(spark, [("A", "B", day, 1), ("B", "C", day, 1), ("C", "A", 2 * day, 1), ("C", "A", 3 * day, 1)])
    assert {r["tx_id"]: r["closes_cycle"] for r in G.closes_cycle(tx).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}
    p = {r["tx_id"]: r for r in G.pair_history(tx).collect()}
    assert [p[i]["prior_pair_tx"] for i in range(4)] == [0, 0, 0, 1] and [p[i]["reverse_edge_exists"] for i in range(4)] == [0] * 4


def test_strong_components_match_reachability(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (45, 2))}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: sum(n in reach[m] for m in reach[n]) for n in nodes}
    assert {r["node"]: r["scc_size"] for r in G.strongly_connected(edges).collect()} == want


def test_homophily_and_degrees(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)], "node long, y int")
    assert G.edge_homophily(edges, labels).first()[0] == pytest.approx(2 / 3)
    assert G.degree_summary(edges, labels.select("node")).first()["isolated_fraction"] == pytest.approx(0.2)


def test_ring_candidates_split_large_components(spark):
    rows = [(i, f"a{i}", f"a{(i + 1) % 4}") for i in range(4)] + [(10 + i, f"b{i}", f"b{(i + 1) % 4}") for i in range(4)] + [(20, "a0", "b0")]
    tx = spark.createDataFrame(rows, "tx_id long, src string, dst string").selectExpr("*", "100.0D as amount", "tx_id * 60 as t", "0.9D as score", "'x' as fmt")
    r = R.candidates(tx, quantile=0.0, max_size=5).collect()
    assert sorted(len(x["members"]) for x in r) == [4, 4] and all(x["has_cycle"] == 1 for x in r)


def test_packets_notes_and_serving(spark):
    tx = spark.createDataFrame([(f"HI:000{i}", "A", f"B{i}", 100.0 * i, 1000 * i, "Wire", s) for i, s in ((1, 0.9), (2, 0.2), (3, 0.95), (4, 0.5))], "tx_id string, src string, dst string, amount double, t long, fmt string, score double")
    alert = tx.where("tx_id = 'HI:0003'").withColumn("rule_hits", F.array(F.lit("large_amount"))).withColumn("src_secs_since_in", F.lit(4000))
    packet = E.build_packets(alert, tx, "v1", 0.9)
    p = packet.first()
    assert p["source_record_ids"] == ["HI:0003", "HI:0001", "HI:0002"]
    note = E.verify_notes(E.template_note(packet)).first()
    assert all(c["verified"] for c in note["claims"]) and any("1.1 hours" in c["text"] for c in note["claims"])
    across = E.template_note(E.build_packets(alert.withColumns({"is_cross_bank": F.lit(1), "is_cross_currency": F.lit(True)}), tx, "v1", 0.9)).first()
    assert any("between two banks, with a change of currency." in c["text"] for c in across["claims"]) and not any("banks" in c["text"] for c in note["claims"])
    forged = E.template_note(packet).withColumn("claims", F.array(F.struct(F.lit("proves HI:99999").alias("text"), F.array().cast("array<string>").alias("source_record_ids"))))
    assert len(E.verify_notes(forged).first()["claims"][0]["problems"]) == 3
    assert V.account_transactions(tx, "A", 3000).count() == 2
    with pytest.raises(ValueError):
        V.set_disposition(alert, 1, "freeze")


def test_evidence_of_a_hub_by_blocks_of_days(spark):
    import random

    rng = random.Random(1)
    rows = [(i, 0 if i % 2 else rng.randrange(1, 6), rng.randrange(1, 6) if i % 2 else 0, float(i), rng.randrange(21 * 86400) + 5 * 86400, "x", rng.randrange(50) / 50) for i in range(400)]
    tx = spark.createDataFrame(rows, "tx_id long, src long, dst long, amount double, t long, fmt string, score double")
    late = (999, 0, 3, 1.0, 400 * 86400, "x", 0.5)  # long after the last transfer
    alerts = tx.where("tx_id % 13 = 0").unionByName(spark.createDataFrame([late], tx.schema))
    got = {r["tx_id"]: [e["tx_id"] for e in r["edges"]] for r in E.graph_evidence(alerts, tx, 5).collect()}
    for a in [r for r in rows if r[0] % 13 == 0] + [late]:
        near = [r for r in rows if r[4] < a[4] and {r[1], r[2]} & {a[1], a[2]}]
        assert got[a[0]] == [r[0] for r in sorted(near, key=lambda r: (-r[6], -r[4], r[0]))[:5]], a


def test_feature_labels(spark):
    names = ["amt_z_src", "src_out_cnt_24h", "dst_in_sum_1h", "src_pagerank", "some_thing"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fn.feature_label(F.col("n"))).collect()]
    assert got[1:] == ["Sender's payments: count, last 24h", "Receiver's receipts: total USD, last 1h", "Sender: PageRank (earlier graph)", "some thing"]


def test_stream_replay_and_stateful_detector(spark, tmp_path):
    from flowlens.streaming import replay as P

    src = str(tmp_path / "in")
    for k in range(2):
        spark.range(k * 50, k * 50 + 50).selectExpr("id as tx_id", "id * 3600 as t", "id / 100.0D as score").coalesce(1).write.mode("append").parquet(src)
    stream = P.read_stream(spark, src, "tx_id long, t long, score double")
    history = spark.read.parquet(src)
    P.replay(stream, history, str(tmp_path / "out"), str(tmp_path / "cp"), 0.9).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    values = stream.selectExpr("'s' as stream", "tx_id as i", "case when tx_id < 60 then 0.0D else 5.0D end as x")
    q = P.detect_stream(values, delta=0.1, threshold=5.0).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    alarms = [r["i"] for r in spark.table("alarms").collect()]
    assert alarms and min(alarms) in range(60, 64)


def test_whole_graph_queries_take_every_transfer(spark, sf):
    from flowlens.plans import QUERIES
    from flowlens.sources.transfers import event_transfers

    tx = [(r["tx_id"], r["src"], r["dst"]) for r in event_transfers(spark, sf).collect()]

    def reached(pairs):
        links = {}
        for a, b in pairs:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set())
        out = {}
        for start in links:
            hops, front = {start: 0}, [start]
            while front:
                front = [y for y in {y for x in front for y in links[x]} if y not in hops and not hops.update({y: hops[front[0]] + 1})]
            out[start] = hops
        return out

    one, both = reached([(a, b) for _, a, b in tx]), reached([p for _, a, b in tx for p in ((a, b), (b, a))])
    found = lambda name: dict(tuple(r) for r in QUERIES[name](spark, sf).collect())
    assert found("n6_strongly_connected") == {n: sum(n in one[m] for m in one[n]) for n in one}
    assert found("n10_components") == {n: min(both[n]) for n in both}
    assert found("n16_hop_distances") == {n: h for n, h in both[0].items() if h <= 4}
    rings = {}
    for i, a, b in tx:
        rings.setdefault(i % 50, []).append((a, b))
    want = {}
    for ring, pairs in rings.items():
        hops = reached(pairs)
        want[ring] = int(any(a in hops[b] for a, b in pairs))
    assert found("n12_has_cycle") == want


def test_communities_by_modularity(spark):
    """Planted groups, sparsely linked, come out; no single move of a node would better the modularity."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(5):
        rows += [(g * 8 + int(a), g * 8 + int(b)) for a, b in rng.integers(0, 8, (40, 2))]
    rows += [(g * 8, (g + 1) % 5 * 8 + 1) for g in range(5)]
    edges = spark.createDataFrame([(0, a, b) for a, b in rows], "component long, src long, dst long")
    part = {r["node"]: r["part"] for r in R.communities(edges).collect()}
    assert all(len({part[n] for n in range(g * 8, g * 8 + 8) if n in part}) == 1 for g in range(5)) and len(set(part.values())) == 5
    assert all(part[n] == min(m for m in part if part[m] == part[n]) for n in part)
    weight = {}
    for a, b in rows:
        if a != b:
            weight[a, b] = weight.get((a, b), 0) + 1
            weight[b, a] = weight.get((b, a), 0) + 1
    degree = {n: sum(w for (a, _), w in weight.items() if a == n) for n in part}
    total = sum(degree.values())
    quality = lambda p: sum(w for (a, b), w in weight.items() if p[a] == p[b]) / total - sum(sum(degree[n] for n in p if p[n] == g) ** 2 for g in set(p.values())) / total**2
    best = quality(part)
    assert all(quality(part | {n: g}) <= best + 1e-9 for n in part for g in set(part.values()))
