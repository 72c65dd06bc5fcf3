"""Strict-past behavioural features of both sides of every transfer.

Transfers that touch an account at one time have the same past, so they are
added up first, before any shuffle: an account and second is one moment with its
sums in both directions ("out" what it sent, "in" what it received).  Frames
over an account's moments in time order end one second before the moment, and
every transfer looks up the moments of its sender and its receiver.

An account's moments are cut into buckets as long as the longest window, and
every moment also serves as an event in the next bucket.  A bucket holds a
moment a second at most, however many transfers a hub has.  Unbounded histories
add the totals of all earlier buckets, which come from one small row an account
and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop
from math import log1p, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WINDOWS = {"5min": 300, "1h": 3600, "24h": 86400}
MIN_HISTORY = 3
_ROLES = (("src", "out"), ("src", "in"), ("dst", "in"), ("dst", "out"))


def _moments(tx: DataFrame, bucket: int, history: bool = True) -> DataFrame:
    """acct, t, b and the sums of the account's transfers at that time, by direction; for a history, of logarithms and of pairs that first meet then, too."""
    amount, la = F.col("amount").cast("double"), F.log1p("amount")
    nothing, none, one = F.lit(None).cast("double"), F.lit(0).cast("long"), F.lit(1).cast("long")
    kinds = {"n_out": F.sum, "n_in": F.sum, "a_out": F.sum, "a_in": F.sum} | ({"s1": F.sum, "s2": F.sum, "mx": F.max, "f_out": F.sum, "f_in": F.sum} if history else {})

    def row(end: str, **values: Column) -> Column:
        blank = lambda c: none if c.startswith(("n_", "f_")) else nothing
        return F.struct(F.col(end).alias("acct"), *[values.get(c, blank(c)).alias(c) for c in kinds])

    rows = tx.select("t", F.inline(F.array(row("src", n_out=one, a_out=amount, s1=la, s2=la * la, mx=amount), row("dst", n_in=one, a_in=amount))))
    if history:
        first = tx.groupBy("src", "dst").agg(F.min("t").alias("t"))
        rows = rows.unionByName(first.select("t", F.inline(F.array(row("src", f_out=one), row("dst", f_in=one)))))
    return rows.groupBy("acct", "t").agg(*[f(c).alias(c) for c, f in kinds.items()]).withColumn("b", F.floor(F.col("t") / F.lit(bucket)))


def _of_both(tx: DataFrame, moments: DataFrame, values: dict[str, tuple[str, Column]], *keep: str, also: tuple[str, ...] = ()) -> DataFrame:
    """tx_id, ``keep`` and each output column, taken from the moment of its side; ``values`` may use the transfer's amount and ``also``.

    The moments are stored, so that both sides read what one computation made.
    """
    moments = materialize(moments, "moments")
    out = tx.select("tx_id", "src", "dst", "t", "amount", *[c for c in (*keep, *also) if c not in ("tx_id", "src", "dst", "t", "amount")])
    for end in ("src", "dst"):
        out = out.join(moments.select(F.col("acct").alias(end), "t", F.struct(*[c for c in moments.columns if c not in ("acct", "t", "b")]).alias(f"__{end}")), [end, "t"], "left")
    return out.select("tx_id", *keep, *[c.alias(name) for name, c in values.items()])


def _window_columns(windows: dict[str, int]) -> dict[str, Column]:
    """Counts and sums over each window, by direction."""
    over = Window.partitionBy("acct", "b").orderBy("t")
    columns: dict[str, Column] = {}
    for name, w in windows.items():
        past = over.rangeBetween(-w, -1)
        for way in ("out", "in"):
            columns[f"{way}_cnt_{name}"] = F.coalesce(F.sum(f"n_{way}").over(past), F.lit(0))
            columns[f"{way}_sum_{name}"] = F.coalesce(F.sum(f"a_{way}").over(past), F.lit(0.0))
    return columns


def _with_windows(moments: DataFrame, windows: dict[str, int]) -> DataFrame:
    twice = moments.withColumn("query", F.lit(True)).unionByName(moments.withColumns({"b": F.col("b") + 1, "query": F.lit(False)}))
    return twice.withColumns(_window_columns(windows)).where("query").drop("query")


def _window_values(windows: dict[str, int]) -> dict[str, Column]:
    zero = {"cnt": F.lit(0).cast("long"), "sum": F.lit(0.0)}
    return {f"{side}_{way}_{what}_{name}": F.coalesce(F.col(f"__{side}.{way}_{what}_{name}"), zero[what]) for name in windows for side, way in _ROLES for what in ("cnt", "sum")}


def window_features(tx: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """tx_id and {stream}_{cnt,sum}_{window} over [t - window, t)."""
    return _of_both(tx, _with_windows(_moments(tx, max(windows.values()), False), windows).drop("n_out", "n_in", "a_out", "a_in"), _window_values(windows))


#: What is carried over an account's buckets, and how.
_CARRIED = {"n_out": F.sum, "n_in": F.sum, "s1": F.sum, "s2": F.sum, "mx": F.max, "t_out": F.max, "t_in": F.max, "f_out": F.sum, "f_in": F.sum}


def _with_history(moments: DataFrame) -> DataFrame:
    """The moments with h_ columns: totals of the account's whole strict past."""
    marked = moments.withColumns({"t_out": F.when(F.col("n_out") > 0, F.col("t")), "t_in": F.when(F.col("n_in") > 0, F.col("t"))})
    carry = marked.groupBy("acct", "b").agg(*[f(c).alias("c_" + c) for c, f in _CARRIED.items()])
    earlier = Window.partitionBy("acct").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carry = carry.select("acct", "b", *[f("c_" + c).over(earlier).alias("c_" + c) for c, f in _CARRIED.items()])
    within = Window.partitionBy("acct", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumns({"h_" + c: f(c).over(within) for c, f in _CARRIED.items()}).join(carry, ["acct", "b"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = {"h_" + c: F.greatest("h_" + c, "c_" + c) if f is F.max else zero("h_" + c) + zero("c_" + c) for c, f in _CARRIED.items()}
    return seen.withColumns(both).drop("t_out", "t_in", *["c_" + c for c in _CARRIED])


def _history_values(min_history: int) -> dict[str, Column]:
    past = lambda side, c: F.col(f"__{side}.h_{c}")
    n, la = past("src", "n_out"), F.log1p("amount")
    mean = past("src", "s1") / n
    std = F.sqrt(F.greatest(past("src", "s2") / n - mean * mean, F.lit(0.0)))
    some = lambda least, c: F.when(n >= least, c)
    return {
        "src_out_n_hist": n, "src_has_history": (n >= min_history).cast("int"), "amt_z_src": some(min_history, (la - mean) / (std + 1e-3)),
        "amt_log_ratio_src_mean": some(1, la - mean), "amt_vs_src_max": some(1, F.col("amount") / (past("src", "mx") + 1e-6)),
        "src_secs_since_out": F.col("t") - past("src", "t_out"), "src_secs_since_in": F.col("t") - past("src", "t_in"),
        "src_in_n_hist": past("src", "n_in"), "dst_in_n_hist": past("dst", "n_in"), "dst_out_n_hist": past("dst", "n_out"),
        "src_n_counterparties": past("src", "f_out"), "dst_n_counterparties": past("dst", "f_in"),
    }


def history_features(tx: DataFrame, bucket: int = 86400, min_history: int = MIN_HISTORY) -> DataFrame:
    """tx_id and the features of the whole strict past.

    Missing history is null; counts are 0.  Standard deviations are those of
    the population.
    """
    return _of_both(tx, _with_history(_moments(tx, bucket)), _history_values(min_history))


def counterparty_is_new(tx: DataFrame) -> DataFrame:
    """tx_id and 1 if the pair has no earlier transfer (all simultaneous first ones count)."""
    first = tx.groupBy("src", "dst").agg(F.min("t").alias("first_t"))
    return tx.join(first, ["src", "dst"]).select("tx_id", (F.col("first_t") == F.col("t")).cast("int").alias("counterparty_is_new"))


def behavioural_features(tx: DataFrame, windows: dict[str, int] = WINDOWS, min_history: int = MIN_HISTORY, keep: tuple[str, ...] = ()) -> DataFrame:
    """All of the above and the pass-through ratio, one row a transfer, beside its columns ``keep``."""
    longest = max(windows, key=windows.get)
    moments = materialize(_moments(tx, max(windows.values())), "moments")  # read for the windows and for what is carried
    moments = _with_history(_with_windows(moments, windows))
    ratio = F.col("amount") / (F.coalesce(F.col(f"__src.in_sum_{longest}"), F.lit(0.0)) + 1)
    values = _window_values(windows) | _history_values(min_history) | {f"amt_over_src_in_{longest}": ratio, "counterparty_is_new": (F.col("first_t") == F.col("t")).cast("int")}
    first = tx.groupBy("src", "dst").agg(F.min("t").alias("first_t"))
    return _of_both(tx.join(first, ["src", "dst"]), moments, values, *keep, also=("first_t",))


def rolling_velocity(tx: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """cnt, sum and max of each sender's transfers in [t - window, t), and the one-hour burst."""
    windows = windows or {"5min": 300, "1h": 3600, "24h": 86400, "7D": 604800}
    bucket = max(windows.values())
    sent = tx.groupBy("src", "t").agg(F.count("amount").alias("n"), F.sum("amount").alias("a"), F.max("amount").alias("mx"))  # a row a second
    rows = sent.withColumns({"b": F.floor(F.col("t") / F.lit(bucket)), "query": F.lit(True)})
    rows = rows.unionByName(rows.withColumns({"b": F.col("b") + 1, "query": F.lit(False)}))
    over = Window.partitionBy("src", "b").orderBy("t")
    columns: dict[str, Column] = {}
    for name, w in windows.items():
        past = over.rangeBetween(-w, -1)
        columns[f"cnt_{name}"] = F.coalesce(F.sum("n").over(past), F.lit(0))
        columns[f"sum_{name}"] = F.coalesce(F.sum("a").over(past), F.lit(0.0))
        columns[f"max_{name}"] = F.coalesce(F.max("mx").over(past), F.lit(0.0))
    seen = rows.withColumns(columns).where("query").select("src", "t", *columns)
    out = tx.select("tx_id", "src", "t").join(seen, ["src", "t"]).select("tx_id", *columns)
    if {"1h", "7D"} <= windows.keys():
        out = out.withColumn("burst_1h", F.col("cnt_1h") / (F.col("cnt_7D") / 168 + 1e-6))
    return out


class _Past:
    """Count, mean, squared deviations, maximum and median of what was added: each step costs the logarithm of the count."""

    def __init__(self):
        self.n, self.mean, self.squares, self.most = 0, 0.0, 0.0, float("-inf")
        self.low: list[float] = []  # the lower half, negated
        self.high: list[float] = []

    def add(self, x: float) -> None:
        self.n += 1
        apart = x - self.mean
        self.mean += apart / self.n
        self.squares += apart * (x - self.mean)
        self.most = max(self.most, x)
        heappush(self.high, -heappushpop(self.low, -x))
        if len(self.high) > len(self.low):
            heappush(self.low, -heappop(self.high))

    def median(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def _baselines(min_history: int):
    """Rows come sorted by sender and time; only the amounts of the sender at hand are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sender, past = None, _Past()
        for batch in batches:
            rows = []
            for src, amount in zip(batch["src"], batch["amount"], strict=True):
                if src != sender:
                    sender, past = src, _Past()
                enough = past.n >= min_history
                if enough:
                    std = sqrt(past.squares / (past.n - 1)) if past.n > 1 else 0.0
                    rows.append(((amount - past.mean) / (std + 1e-6), amount / (past.most + 1e-6), log1p(amount) - log1p(past.median()), 1))
                else:
                    rows.append((None, None, None, 0))
                past.add(amount)
            out = pd.DataFrame(rows, columns=["amt_z_personal", "amt_vs_personal_max", "amt_log_ratio_median", "has_history"]).astype({"has_history": "int32"})
            yield pd.concat([batch[["tx_id"]], out, batch[["counterparty_is_new"]]], axis=1)

    return run


def personal_baseline(tx: DataFrame, min_history: int = 5) -> DataFrame:
    """Row-order baselines of the sender: earlier rows by (t, tx_id), simultaneous ones included.

    One pass over the sorted rows of each sender: a window with an exact median
    would sort its whole past again for every row.  ``min_history`` is 1 or more.
    """
    pair = Window.partitionBy("src", "dst").orderBy("t", "tx_id")
    rows = tx.select("tx_id", "src", "t", F.col("amount").cast("double").alias("amount"), (F.row_number().over(pair) == 1).cast("int").alias("counterparty_is_new"))
    kind = dict(tx.dtypes)["tx_id"]
    schema = f"tx_id {kind}, amt_z_personal double, amt_vs_personal_max double, amt_log_ratio_median double, has_history int, counterparty_is_new int"
    return rows.repartition("src").sortWithinPartitions("src", "t", "tx_id").mapInPandas(_baselines(min_history), schema)


def interarrival(tx: DataFrame) -> DataFrame:
    """Per sender: statistics of the gaps between transfers, entropy of the hour of day, automation score.

    Zero gaps are left out.  Under three transfers the statistics are null and
    the score 0; with zero gaps only, the statistics are 0 and the score 1.
    """
    order = Window.partitionBy("src").orderBy("t", "tx_id")
    gap = F.col("t") - F.lag("t").over(order)
    gaps = tx.select("src", F.when(gap > 0, gap).alias("gap"))
    own = gaps.groupBy("src").agg(
        F.count("*").alias("n"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean"),
        F.stddev_pop("gap").alias("std"), F.percentile("gap", F.lit(0.5)).alias("median"), F.min("gap").alias("least"),
    )
    hours = tx.groupBy("src", F.floor(F.col("t") / 3600 % 24).alias("h")).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("src"))
    entropy = hours.withColumn("e", -p * F.log(p)).groupBy("src").agg(F.sum("e").alias("entropy"))
    cv = F.col("std") / F.greatest("mean", F.lit(1e-9))
    shown = lambda c: F.when(F.col("n") < 3, None).when(F.col("gaps") == 0, 0.0).otherwise(c)
    return own.join(entropy, "src").select(
        "src",
        shown(cv).alias("iat_cv"),
        shown(F.col("median")).alias("iat_median"),
        shown(F.col("least").cast("double")).alias("iat_min"),
        shown(F.col("entropy")).alias("hour_entropy"),
        F.when(F.col("n") < 3, 0.0).when(F.col("gaps") == 0, 1.0).otherwise(F.exp(-cv) * F.exp(-F.col("entropy") / 3)).alias("automation_score"),
    )


def concentration(tx: DataFrame) -> DataFrame:
    """Herfindahl index of each sender's amounts by receiver; 0 for a total of 0 or less."""
    pairs = tx.groupBy("src", "dst").agg(F.sum("amount").alias("a"))
    sums = pairs.groupBy("src").agg(F.sum("a").alias("total"), F.sum(F.col("a") * F.col("a")).alias("squares"))
    return sums.select("src", F.when(F.col("total") > 0, F.col("squares") / (F.col("total") * F.col("total"))).otherwise(0.0).alias("hhi"))
