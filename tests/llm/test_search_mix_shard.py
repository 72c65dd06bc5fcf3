import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.llm import mixing, sharding, topk_search


def brute_topk(rows, queries, k):
    out = []
    for q, qv in queries:
        hits = sorted((-sum(int(a) * int(b) for a, b in zip(qv, v)), i) for i, v in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,dims,batch", [(300, 8, 10_000), (500, 3, 64), (5, 4, 2)])
def test_topk_equals_brute_force(spark, n, dims, batch):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, dims)), 1)  # many ties
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = topk_search.valid_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
        got = sorted(tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 20 = 0"), 7).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in enumerate(x)]
    assert got == brute_topk(whole, [w for w in whole if w[0] % 20 == 0], 7)


def test_topk_reads_part_of_the_lists_when_scores_are_skewed():
    rng = np.random.default_rng(0)
    x = np.floor(rng.random((2000, 4)) ** 8 * 1000)
    lists = topk_search.SortedLists(np.arange(2000), x)
    rows, depths = lists.best(x[:1], 5, np.array([-np.inf]), np.array([0]))
    assert len(rows[0]) < 200 and depths[0] <= 1000


def test_topk_stops_before_the_end_of_dense_lists():
    """64 dimensions of noise are the hardest case: 7/8 of the lists suffice, 3/4 if the score to beat is known."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1)[:, None])
    lists, q = topk_search.SortedLists(np.arange(2000), x), x[::100]
    rows, depths = lists.best(q, 10, np.full(20, -np.inf), np.arange(0, 2000, 100))
    assert depths.max() <= 1875 and np.median(depths) <= 1750
    scores = np.where(np.arange(2000)[:, None] == np.arange(0, 2000, 100)[None, :], -np.inf, x @ q.T)
    tenth = np.sort(scores, axis=0)[-10]
    for i in range(20):
        assert set(np.flatnonzero(scores[:, i] >= tenth[i])) <= set(rows[i])
    assert np.median(lists.best(q, 10, tenth, np.arange(0, 2000, 100))[1]) <= 1500


def test_topk_work_is_in_proportion_to_the_depth():
    rng = np.random.default_rng(1)
    x = np.floor(rng.random((4000, 6)) ** 12 * 1000)
    lists = topk_search.SortedLists(np.arange(4000), x)
    for i in range(0, 4000, 400):
        rows, depth, touched = lists.search(x[i], 5, -np.inf, i)
        assert touched == depth * 6
        scores = np.where(np.arange(4000) == i, -np.inf, x @ x[i])
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(rows)
    assert lists.search(x[0], 5, -np.inf, 0)[1] <= 2000


def test_topk_of_many_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5)).round(1)
    df = topk_search.valid_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    want = sorted(map(tuple, topk_search.top_k(df, df, 3).collect()))
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 25)
    monkeypatch.setattr(topk_search, "PLAN_BLOCKS", 2)
    assert sorted(map(tuple, topk_search.top_k(df, df, 3).collect())) == want and len(want) == 360


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1e30, 1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (100, [1.0, -1.0])]
    df = topk_search.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own")))
    got = [tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, _, v, _ in got] == [(0, 6), (0, 7), (0, 5), (0, 100), (100, 6), (100, 5), (100, 7), (100, 0)]
    assert topk_search.top_k(df.where("false"), df.where("false"), 3).count() == 0


def test_mix_meets_targets(docs, local):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "copies"]
    assert got.sort_values("doc_id")[key].to_numpy().tolist() == again.sort_values("doc_id")[key].to_numpy().tolist()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in local.itertuples()}
    assert all(size[r.doc_id] == r.size for r in got.itertuples())
    by = pd.Series(size).groupby(local.set_index("doc_id").source).sum().sort_index()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(by.index)}
    want = {s: 0.0 for s in by.index}
    free, left = set(by.index), 1.5 * by.sum()
    while left > 1e-9 and free:  # reshare the excess until none is above
        total = sum(weight[s] for s in free)
        excess = 0.0
        for s in sorted(free):
            want[s] += left * weight[s] / total
        for s in sorted(free):
            if want[s] > 2 * by[s]:
                excess += want[s] - 2 * by[s]
                want[s] = 2.0 * by[s]
                free.discard(s)
        left = excess
    for s, rows in got.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(want[s])
        assert (rows["size"] * rows.copies).sum() == pytest.approx(want[s], rel=0.05)
    assert got.copies.between(0, 2).all()


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(0 <= r["copies"] <= 2 for r in rows)
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0)
    assert sum(r["source"] is None for r in rows) == 2
    assert mixing.mix(none).count() == 0 and mixing.repeat_by_mix(none).count() == 0
    out = mixing.repeat_by_mix(odd)
    assert out.columns == odd.columns and out.where("size <> 'own'").count() == 0


def test_newton_rate_solves_the_dual(spark):
    df = spark.createDataFrame([(100.0, 1.0), (100.0, 150.0), (100.0, 200.0), (1e12, 3.0), (0.0, 0.0)], "s double, t double")
    r = [x[0] for x in df.select(mixing.newton_rate(F.col("s"), F.col("t"))).collect()]
    assert r[:4] == pytest.approx([0.01, 1.5, 2.0, 3e-12], rel=1e-9) and r[4] == 0


def test_shards(docs, local):
    got = sharding.shard_documents(docs).toPandas()
    text = local.set_index("doc_id").text
    assert sorted(got.doc_id) == sorted(local.doc_id)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())
    counts = got.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    order = got.sort_values(["shard", "slot"]).doc_id.to_numpy()
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3
    again = sharding.shard_documents(docs).toPandas()
    assert again.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist() == got.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist()


def test_shards_odd_rows(odd, none, tmp_path, spark):
    got = sharding.shard_documents(odd)
    assert got.count() == 10 and got.where("size = 1").count() == 2
    assert sharding.shard_documents(none).count() == 0
    sharding.write_shards(odd, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and back.where("text is null").count() == 1


def test_whole_documents_are_shuffled(docs, local, monkeypatch):
    seen, whole = [], sharding.external_shuffle

    def spy(df, n_shards, seed=17, row_bytes=None, bucket_bytes=sharding.BUCKET_BYTES):
        seen.append((df.columns, df.agg(F.sum(F.lit(64) if row_bytes is None else row_bytes)).first()[0]))
        return whole(df, n_shards, seed, row_bytes, 50_000)  # many buckets

    monkeypatch.setattr(sharding, "external_shuffle", spy)
    got = sharding.shard_documents(docs).toPandas()
    text = local.set_index("doc_id").text
    assert "text" in seen[0][0] and seen[0][1] >= sum(len(t.encode()) for t in text)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def brute_targets(sizes):
    """Targets by resharing the excess until none is above, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), list(names)
    while free and left > 1e-9:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if got[s] + each * weight[s] >= 2 * sizes[s]]
        for s in full or free:
            more = 2 * sizes[s] - got[s] if full else each * weight[s]
            got[s], left = got[s] + more, left - more
        free = [s for s in free if s not in full] if full else []
    return got


@pytest.mark.parametrize("parts", [1, 5])
def test_mix_with_many_repeated_rows_by_brute_force(spark, parts):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, "a", text(100))] * 11 + [(2, "a", text(7))] + [(3, "b", text(150))] * 3 + [(4, "b", text(1))] * 40
    rows += [(5, None, text(30))] * 2000 + [(i, "c", text(int(rng.integers(0, 300)))) for i in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    got = mixing.mix(df).toPandas()
    sizes = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in ("a", "b", "c", None)}
    want = brute_targets(sizes)
    assert len(got) == len(rows) and got.copies.between(0, 2).all()
    got["source"] = got["source"].map(lambda s: s if isinstance(s, str) else None)
    for s, t in want.items():
        own = got[got.source.isna() if s is None else got.source == s]
        assert own.target.tolist() == pytest.approx([t] * len(own))
        smallest = min(n for n in own["size"] if n)
        assert abs((own["size"] * own.copies).sum() - t) <= max(smallest, 0.001 * t)
    repeated = mixing.repeat_by_mix(df).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert repeated == {d: c for d, c in got.groupby("doc_id").copies.sum().items() if c}


def test_mix_repairs_rows_without_id(spark):
    words = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    docs = spark.createDataFrame([(None, words(100, i), "a") for i in range(7)] + [(None, words(2, 9 + i), "a") for i in range(7)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken, target = sum(r["size"] * r["copies"] for r in rows), rows[0]["target"]
    assert len(rows) == 14 and abs(taken - target) <= 50 and all(0 <= r["copies"] <= 2 for r in rows)


def test_clashing_names_of_mixed_and_cut_rows(spark, odd):
    from flowlens.llm import line_dedup

    inner = ("__c", "__m", "__k1", "__k2", "__i", "__g", "__key", "__key0", "__id", "__cuts", "__done", "__row", "__u", "__h", "__part", "a.b")
    clash = odd.withColumns({c: F.lit("own") for c in inner})
    mixed = mixing.repeat_by_mix(clash)
    assert mixed.columns == clash.columns
    plain = sorted(map(str, mixing.repeat_by_mix(odd).select("doc_id", "text").distinct().collect()))
    assert sorted(map(str, mixed.select("doc_id", "text").distinct().collect())) == plain
    cut = line_dedup.dedup_lines(clash)
    assert set(cut.columns) == set(clash.columns) and cut.count() == odd.count()
    assert sorted(map(str, cut.select("doc_id", "text").collect())) == sorted(map(str, line_dedup.dedup_lines(odd).select("doc_id", "text").collect()))
    assert {r[0] for r in cut.select("`a.b`").collect()} == {"own"}
