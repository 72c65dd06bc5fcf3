"""State of streams: look-backs of alerts and detectors, over batches and restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import drift as D
from flowlens.streaming import look_back as L
from flowlens.streaming import replay as P

TX = "tx_id long, src long, dst long, t long, amount double, score double"
HOUR = 3600


def answers(rows, passed, look_back, seen=None):
    """By plain loops: what each alert before ``passed`` meets; ``seen`` are the rows that count."""
    out = {}
    for tx_id, src, dst, t, _, score in rows:
        if score < 0.9 or t >= passed:
            continue
        for account in {src, dst}:
            own = [r for r in (seen or rows) if account in (r[1], r[2]) and t - look_back <= r[3] < t]
            out[tx_id, account] = (len(own), sum(r[4] for r in own), sum(r[5] >= 0.9 for r in own), max((r[5] for r in own), default=None))
    return out


def run(spark, folder, look_back, late):
    """One run over what is new in the folder, as after a restart."""
    stream = P.read_stream(spark, f"{folder}/in", TX)
    out = L.alert_look_back(stream, 0.9, look_back, late)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").collect()
    assert len({(r["tx_id"], r["account"]) for r in got}) == len(got)
    return {(r["tx_id"], r["account"]): (r["n"], r["amount"], r["hot"], r["most"]) for r in got}


def add(spark, folder, rows):
    spark.createDataFrame(rows, TX).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def close(got, want):
    assert got.keys() == want.keys()
    for k, (n, amount, hot, most) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(amount) and got[k][2:] == (hot, most)


def test_look_back_over_batches_restarts_and_late_rows(spark, tmp_path):
    """Account 1 is a hub; a third of the rows come up to an hour late; state goes on after a restart."""
    rng = random.Random(4)
    made = lambda i, t: (i, 1 if rng.random() < 0.4 else rng.randrange(2, 8), rng.randrange(1, 8), t, float(rng.randrange(1, 50)), rng.choice([0.1, 0.5, 0.95]))
    rows = [made(i, 500 * HOUR + i * 400) for i in range(240)]  # 26 hours
    arrival = sorted(rows, key=lambda r: r[3] + (rng.randrange(HOUR - 400) if r[0] % 3 == 0 else 0))
    for k in range(3):
        add(spark, tmp_path, arrival[k * 80 : k * 80 + 80])
        got = run(spark, tmp_path, 5 * HOUR, "1 hour")
        passed = max(r[3] for r in arrival[: k * 80 + 80]) - HOUR
        close(got, answers(arrival[: k * 80 + 80], passed, 5 * HOUR))
    late = (900, 1, 2, rows[0][3], 1e6, 0.99)  # later than the watermark allows: no answer, and no part in others
    last = [(1000 + i, 1, 3, rows[-1][3] + 3 * HOUR + i, 1.0, 0.95) for i in range(3)]
    end = (2000, 6, 7, rows[-1][3] + 9 * HOUR, 1.0, 0.1)
    add(spark, tmp_path, [late, *last])
    run(spark, tmp_path, 5 * HOUR, "1 hour")
    add(spark, tmp_path, [end])
    close(run(spark, tmp_path, 5 * HOUR, "1 hour"), answers([*rows, *last, end], end[3] - HOUR, 5 * HOUR))


def test_what_no_alert_can_meet_is_evicted(monkeypatch):
    """The processor by itself: timers remove moments beyond the look-back, and state ends with them."""
    import pandas as pd

    class Held(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

        appendList, clear = list.extend, list.clear  # noqa: N815

    timers = set()
    own = L.LookBackProcessor(0.9, 100)
    own.moments, own.open = Held(), Held()
    own.handle = type("Handle", (), {"registerTimer": staticmethod(timers.add)})
    at = lambda ms: type("Timer", (), {"getCurrentWatermarkInMs": staticmethod(lambda: ms), "getExpiryTimeInMs": staticmethod(lambda: ms)})
    batch = pd.DataFrame({"tx_id": range(300), "t": range(1000, 1300), "amount": 1.0, "score": [0.95 if i == 299 else 0.1 for i in range(300)]})
    assert list(own.handleInputRows((7,), iter([batch]), None)) == [] and len(own.moments) == 300
    assert timers == {1300_000, (1299 + 102) * 1000}
    (answer,) = own.handleExpiredTimer((7,), at(1300_000), at(1300_000))
    assert answer[["tx_id", "account", "n", "amount", "hot"]].values.tolist() == [[299, 7, 100, 100.0, 0]]
    assert not own.open and len(own.moments) == 101
    assert list(own.handleExpiredTimer((7,), at(1401_000), at(1401_000))) == [] and not own.moments


def test_many_accounts_share_a_call_and_one_timer(spark, tmp_path):
    """A state key serves many accounts; its alerts have a timer, not one each; answers are those of plain loops."""
    rng = random.Random(7)
    rows = [(i, rng.randrange(300), rng.randrange(300), 500 * HOUR + rng.randrange(20 * HOUR), float(i % 9), rng.choice([0.1, 0.95])) for i in range(600)]
    add(spark, tmp_path, rows)
    out = L.alert_look_back(P.read_stream(spark, f"{tmp_path}/in", TX), 0.9, 5 * HOUR, "1 hour", parts=3)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["tx_id"], r["account"]): (r["n"], r["amount"], r["hot"], r["most"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    close(got, answers(rows, max(r[3] for r in rows) - HOUR, 5 * HOUR))
    timers = [p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in map(lambda p: json.loads(p.json), query.recentProgress)]
    assert 0 < max(timers) <= 6


@pytest.mark.parametrize("kind", ["adwin", "patience", "both ways"])
def test_detectors_in_a_stream_equal_those_over_a_table(spark, tmp_path, kind):
    make = {"adwin": lambda: D.Adwin(), "patience": lambda: D.Patience(4.0, 3), "both ways": lambda: D.PageHinkley(0.05, 8.0, direction="both")}[kind]
    rng = random.Random(6)
    rows = [(s, i, rng.gauss(0, 1) + (6 if s == "b" and 40 <= i < 90 else 0)) for s in "abc" for i in range(120)]
    schema = "stream string, i long, x double"
    for k in range(4):  # a run for each: windows and streaks go over batches and restarts
        spark.createDataFrame([r for r in rows if r[1] // 30 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = P.detect_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), make)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()))
    table = spark.createDataFrame(rows, schema)
    assert got == sorted(map(tuple, D.detect(table, make).collect())) and any(s == "b" for s, _, _ in got)
    if kind == "patience":
        assert got == sorted(map(tuple, D.threshold_alarms(table, 4.0, 3).select("stream", F.col("i"), "x").collect()))
