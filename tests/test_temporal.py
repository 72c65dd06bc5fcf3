"""Components and ranks of every period from one temporal edge list."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.operators import components, temporal
from flowlens.operators import graph as G


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in out[n]:
                    out[n] |= out[b]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_strong_members(edges):
    src, dst = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    member = components.strong_members(8, src, dst)
    to = reach(edges, range(8))
    for a in range(8):
        assert member[member[a]] == member[a]
        for b in range(8):
            assert (member[a] == member[b]) == (b in to[a] and a in to[b])


def test_a_long_path_and_cycle_need_no_recursion():
    n = 50_000
    src = np.arange(n)
    assert len(set(components.strong_members(n, src[:-1], src[1:]))) == n
    assert len(set(components.strong_members(n, src, (src + 1) % n))) == 1


def table(spark, seed, nodes, pairs, periods):
    rng = np.random.default_rng(seed)
    rows = {(int(a), int(b)): int(f) for a, b, f in zip(rng.integers(0, nodes, pairs), rng.integers(0, nodes, pairs), rng.integers(0, periods, pairs), strict=True)}
    return rows, spark.createDataFrame([(a, b, f) for (a, b), f in rows.items()], "src long, dst long, first int")


@pytest.mark.parametrize("seed,nodes,pairs,periods,one_task", [(1, 12, 30, 7, 10**6), (2, 12, 30, 5, 4), (3, 6, 14, 1, 10**6), (4, 20, 26, 12, 10**6)])
def test_components_of_every_snapshot(spark, monkeypatch, seed, nodes, pairs, periods, one_task):
    """Also where large stretches go by rounds (one_task 4)."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rows, edges = table(spark, seed, nodes, pairs, periods)
    asked = spark.range(nodes + 1).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(periods))).alias("i"))
    got = {(r["node"], r["i"]): (r["scc"], r["scc_size"]) for r in temporal.merged_components(edges, asked, periods).collect()}
    assert len(got) == (nodes + 1) * (periods + 1)
    for i in range(periods + 1):
        to = reach([e for e, f in rows.items() if f < i], range(nodes + 1))
        for a in range(nodes + 1):
            own = {b for b in range(nodes + 1) if b in to[a] and a in to[b]}
            name, size = got[a, i]
            assert size == len(own) and name in own
            assert all(got[b, i][0] == name for b in own)


@pytest.mark.parametrize("bound", [10**6, 12])
def test_ranks_of_all_snapshots_by_blocks(spark, monkeypatch, bound):
    """However many blocks, all rounds or as many as move the ranks: those of the plain recurrence."""
    monkeypatch.setattr(temporal, "RANK_LINKS", bound)
    periods = 2 * temporal.WIDTH + 1
    rows, edges = table(spark, 8, 14, 50, periods)
    got = {}
    for r in temporal.temporal_pagerank(edges, periods, 23).collect():
        got |= {(r["node"], r["block"] * temporal.WIDTH + k): r[f"r{k}"] for k in range(temporal.WIDTH)}
    for i in range(periods + 1):
        pairs = [e for e, f in rows.items() if f < i]
        names = sorted({v for e in pairs for v in e})
        r = {v: 1 / len(names) for v in names}
        for _ in range(23):
            pays = {v: [b for a, b in pairs if a == v] for v in names}
            loose = sum(r[v] for v in names if not pays[v])
            new = {v: (0.15 + 0.85 * loose) / len(names) for v in names}
            for v in names:
                for b in pays[v]:
                    new[b] += 0.85 * r[v] / len(pays[v])
            r = new
        for v in range(14):
            assert got.get((v, i), 0) == pytest.approx(r.get(v, 0) * len(names), abs=1e-12)


def test_rounds_shuffle_sums_of_blocks_not_of_pairs(spark, monkeypatch):
    """Nothing is stored for a round while the pairs fit in a block."""
    stored = []
    real = temporal.materialize
    monkeypatch.setattr(temporal, "materialize", lambda df, name: stored.append(name) or real(df, name))
    _, edges = table(spark, 9, 30, 200, 5)
    temporal.temporal_pagerank(edges, 5, 50).count()
    assert len(stored) < 5


def test_ranks_of_more_snapshots_than_a_row_holds(spark):
    periods = temporal.WIDTH + 3
    rows, edges = table(spark, 5, 10, 40, periods)
    wide = temporal.temporal_pagerank(edges, periods, 4)
    asked = spark.range(10).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(periods))).alias("i"))
    got = {(r["node"], r["i"]): r["pagerank"] for r in temporal.looked_up(asked, wide, "r", "pagerank").collect()}
    for i in (1, 2, temporal.WIDTH - 1, temporal.WIDTH, periods):
        pairs = [e for e, f in rows.items() if f < i]
        want = {} if not pairs else {r["node"]: r["pagerank"] for r in G.pagerank(spark.createDataFrame(pairs, "src long, dst long"), 4).collect()}
        for n in range(10):
            assert got[n, i] == pytest.approx(want.get(n, 0))


def test_no_transfers(spark):
    tx = spark.createDataFrame([], "tx_id long, src long, dst long, t long, amount double")
    assert G.closes_cycle(tx).count() == 0


def test_rows_stored_are_of_the_order_of_the_pairs(spark, monkeypatch):
    """A pair that lasts for many periods is one row on every level of the division, not one a period."""
    stored = []
    real = temporal.materialize
    monkeypatch.setattr(temporal, "materialize", lambda df, name: stored.append((name, (out := real(df, name)).count())) or out)
    periods = 60
    _, edges = table(spark, 6, 40, 150, periods)
    asked = spark.range(40).select(F.col("id").alias("node"), F.lit(periods).alias("i"))
    temporal.merged_components(edges, asked, periods).count()
    assert max(n for name, n in stored if name == "temporal-edges") <= 150


def test_pagerank_by_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(a), int(b)) for g, a, b in zip(rng.integers(0, 2, 90), rng.integers(0, 25, 90), rng.integers(0, 30, 90))] + [(0, k, 3) for k in range(20)] + [(2, 7, 7), (3, 1, 2)]
    edges = spark.createDataFrame(rows, "period long, src long, dst long")

    def want(pairs):
        pairs, names = set(pairs), sorted({v for p in pairs for v in p})
        r = {v: 1 / len(names) for v in names}
        for _ in range(12):
            pays = {v: [b for a, b in pairs if a == v] for v in names}
            loose = sum(r[v] for v in names if not pays[v])
            new = {v: 0.15 / len(names) + 0.85 * loose / len(names) for v in names}
            for v in names:
                for b in pays[v]:
                    new[b] += 0.85 * r[v] / len(pays[v])
            r = new
        return {v: x * len(names) for v, x in r.items()}

    for bound in (10**6, 12):
        monkeypatch.setattr(G, "RANK_LINKS", bound)
        got = {(r["period"], r["node"]): r["pagerank"] for r in G.pagerank(edges, 12, by="period").collect()}
        assert got == pytest.approx({(g, v): x for g in range(4) for v, x in want([r[1:] for r in rows if r[0] == g]).items()})
