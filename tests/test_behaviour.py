from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import behaviour as B

DAY = datetime(2022, 9, 1)


def at(hm):
    h, m, *s = map(int, hm.split(":"))
    return int((DAY + timedelta(hours=h, minutes=m, seconds=s[0] if s else 0) - datetime(1970, 1, 1)).total_seconds())


def transfers(spark, rows):
    return spark.createDataFrame([(i, s, d, at(t), float(a)) for i, (s, d, t, a) in enumerate(rows)], "tx_id long, src string, dst string, t long, amount double")


def by_id(df):
    return {r["tx_id"]: r.asDict() for r in df.collect()}


def test_pass_through(spark):
    f = by_id(B.behavioural_features(transfers(spark, [("B", "A", "10:00", 1000), ("A", "C", "10:20", 950)])))[1]
    assert (f["src_in_cnt_1h"], f["src_in_sum_1h"], f["src_secs_since_in"], f["src_secs_since_out"]) == (1, 1000.0, 1200, None)
    assert f["amt_over_src_in_24h"] == pytest.approx(950 / 1001)


def test_fan_in_and_novelty(spark):
    f = by_id(B.behavioural_features(transfers(spark, [("S1", "M", "9:00", 1), ("S2", "M", "9:10", 1), ("S1", "M", "9:20", 1), ("S3", "M", "9:30", 1)])))
    assert [f[i]["dst_in_cnt_1h"] for i in range(4)] == [0, 1, 2, 3]
    assert [f[i]["dst_n_counterparties"] for i in range(4)] == [0, 1, 2, 2]
    assert [f[i]["counterparty_is_new"] for i in range(4)] == [1, 1, 0, 1]


def test_window_is_closed_on_the_left(spark):
    f = by_id(B.window_features(transfers(spark, [("A", "X", "9:59:59", 1), ("A", "X", "10:00", 2), ("A", "X", "11:00", 4)])))[2]
    assert (f["src_out_cnt_1h"], f["src_out_sum_1h"]) == (1, 2.0)


def test_simultaneous_rows_do_not_see_each_other(spark):
    rows = [("A", f"P{i}", "10:00", 100) for i in range(3)] + [("A", "Q", "10:05", 50_000), ("A", "R", "10:05", 100)]
    tx = transfers(spark, rows)
    w, h = by_id(B.window_features(tx)), by_id(B.history_features(tx))
    assert [w[i]["src_out_cnt_1h"] for i in range(5)] == [0, 0, 0, 3, 3]
    assert h[3]["amt_z_src"] > 100
    assert h[4]["amt_vs_src_max"] == pytest.approx(1.0)


def test_current_row_is_not_in_its_own_baseline(spark):
    tx = transfers(spark, [("A", "X", f"{8 + i}:00", 100) for i in range(5)] + [("A", "X", "13:00", 10_000)])
    w, h = by_id(B.window_features(tx)), by_id(B.history_features(tx))
    assert [w[i]["src_out_cnt_24h"] for i in range(6)] == list(range(6))
    assert w[5]["src_out_sum_24h"] == 500 and h[5]["amt_z_src"] > 10


def test_velocity_and_row_order_novelty(spark):
    tx = transfers(spark, [("A", "B", "10:00", 100), ("A", "B", "10:30", 200), ("A", "C", "10:45", 300)])
    v, p = by_id(B.rolling_velocity(tx)), by_id(B.personal_baseline(tx))
    assert [v[i]["cnt_1h"] for i in range(3)] == [0, 1, 2] and v[2]["sum_1h"] == 300
    assert [p[i]["counterparty_is_new"] for i in range(3)] == [1, 0, 1]


def test_dropping_the_future_and_order_change_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ABCDE"), rng.choice("ABCDE"), f"{rng.randint(0, 23)}:{rng.randint(0, 59)}", rng.randint(1, 500)) for _ in range(150)]
    tx = transfers(spark, rows)
    cut = at("12:00")
    whole = by_id(B.behavioural_features(tx).join(tx.where(F.col("t") < cut).select("tx_id"), "tx_id"))
    part = by_id(B.behavioural_features(tx.where(F.col("t") < cut).orderBy(F.rand(3))))
    assert whole.keys() == part.keys()
    for k in whole:
        assert whole[k] == pytest.approx(part[k], nan_ok=True)


def test_empty_table(spark):
    tx = transfers(spark, [("A", "B", "10:00", 1)]).where("tx_id < 0")
    assert B.behavioural_features(tx).count() == 0 and B.interarrival(tx).count() == 0


def test_interarrival_of_constant_and_simultaneous_transfers(spark):
    tx = transfers(spark, [("A", "X", "10:00", 1)] * 3 + [("B", "X", "10:00", 1), ("B", "X", "10:10", 1), ("B", "X", "10:20", 1), ("C", "X", "9:00", 1)])
    r = {x["src"]: x for x in B.interarrival(tx).collect()}
    assert (r["A"]["automation_score"], r["A"]["iat_cv"]) == (1.0, 0.0)
    assert r["B"]["iat_cv"] == 0 and r["B"]["iat_median"] == 600
    assert r["C"]["iat_cv"] is None and r["C"]["automation_score"] == 0


def test_a_hub_is_a_moment_a_second(spark):
    """Half of all rows touch one account, most of them at the same few times: windows see moments, and the sums stay right."""
    import random

    from flowlens.operators import behaviour as B

    rng = random.Random(5)
    rows = [(i, 0 if i % 2 else rng.randrange(1, 40), 0 if not i % 2 and i % 4 else rng.randrange(1, 40), 1000 + rng.randrange(40), float(rng.randrange(1, 99))) for i in range(3000)]
    tx = spark.createDataFrame(rows, "tx_id long, src long, dst long, t long, amount double").repartition(6)
    assert B._moments(tx, 86400).where("acct = 0").count() <= 40
    got = {r["tx_id"]: r for r in B.behavioural_features(tx, {"5s": 5, "24h": 86400}).collect()}
    assert len(got) == 3000
    for i, s, d, t, a in rng.sample(rows, 60):
        past = [r for r in rows if t - 5 <= r[3] < t]
        r = got[i]
        assert r["src_out_cnt_5s"] == sum(x[1] == s for x in past) and r["dst_in_cnt_5s"] == sum(x[2] == d for x in past)
        assert abs(r["src_in_sum_5s"] - sum(x[4] for x in past if x[2] == s)) < 1e-6
        before = [x for x in rows if x[3] < t]
        assert r["src_out_n_hist"] == sum(x[1] == s for x in before) if any(s in x[1:3] for x in rows) else True
        assert r["src_n_counterparties"] == len({x[2] for x in before if x[1] == s}) and r["dst_n_counterparties"] == len({x[1] for x in before if x[2] == d})
        assert r["counterparty_is_new"] == int(not any(x[1:3] == (s, d) for x in before))
        assert abs(r["amt_over_src_in_24h"] - a / (sum(x[4] for x in before if x[2] == s) + 1)) < 1e-9


def test_features_join_no_ids_and_keep_columns(spark):
    """Transfers that share an id stay one row each: nothing is joined by id."""
    tx = spark.createDataFrame([(1, 1, 2, 10, 5.0, "a"), (1, 2, 1, 20, 4.0, "b"), (2, 1, 2, 30, 2.0, "c")], "tx_id long, src long, dst long, t long, amount double, fmt string")
    rows = B.behavioural_features(tx, {"1h": 3600}, keep=("t", "fmt")).orderBy("t").collect()
    assert [(r["tx_id"], r["t"], r["fmt"], r["counterparty_is_new"], r["src_out_n_hist"], r["src_in_n_hist"]) for r in rows] == [(1, 10, "a", 1, 0, 0), (1, 20, "b", 1, 0, 1), (2, 30, "c", 0, 1, 1)]
