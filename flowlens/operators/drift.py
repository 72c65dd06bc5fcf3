"""Label-free drift: frozen-bin PSI, two-sample KS, window status, ordered detectors."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import column_quantiles, exact_quantiles

#: Customary PSI levels.
WARN, DRIFT = 0.1, 0.25


def bin_edges(reference: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, edges: inner quantiles of the reference, repeated ones once."""
    found = exact_quantiles(unpivot(reference, features).withColumnRenamed("feature", "g"), [i / bins for i in range(1, bins)])
    return reference.sparkSession.createDataFrame([(f, sorted(set(found.get(f, [])))) for f in features], "feature string, edges array<double>")


def unpivot(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """feature, x (NaN as null) for each row and feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.nullif(F.col(f).cast("double"), F.lit(float("nan"))).alias("x")) for f in features])
    return df.select(*keep, F.inline(pairs))


def bin_of(x: Column, edges: Column) -> Column:
    """Right-closed bin: the number of edges below x; missing values have the last bin."""
    return F.when(x.isNull(), F.size(edges) + 1).otherwise(F.size(F.filter(edges, lambda e: e < x)))


def proportions(df: DataFrame, features: list[str], edges: DataFrame, *by: str, alpha: float = 1.0) -> DataFrame:
    """by..., feature, bin, p: smoothed shares of all bins, empty ones included."""
    counted = (
        unpivot(df, features, *by).join(F.broadcast(edges), "feature")
        .groupBy(*by, "feature", bin_of(F.col("x"), F.col("edges")).alias("bin")).count()
    )
    groups = counted.groupBy(*by, "feature").agg(F.sum("count").alias("n")).join(F.broadcast(edges), "feature")
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.size("edges") + 1)))
    full = grid.join(counted, [*by, "feature", "bin"], "left")
    share = (F.coalesce("count", F.lit(0)) + alpha) / (F.col("n") + alpha * (F.size("edges") + 2))
    return full.select(*by, "feature", "bin", share.alias("p"))


def psi(reference: DataFrame, current: DataFrame, features: list[str], *by: str, bins: int = 10, alpha: float = 1.0) -> DataFrame:
    """by..., feature, psi of the current rows against the reference's frozen bins."""
    edges = bin_edges(reference, features, bins)
    ref = proportions(reference, features, edges, alpha=alpha).withColumnRenamed("p", "q")
    cur = proportions(current, features, edges, *by, alpha=alpha)
    term = (F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))
    return cur.join(F.broadcast(ref), ["feature", "bin"]).groupBy(*by, "feature").agg(F.sum(term).alias("psi"))


def status(value: Column, warn: float = WARN, drift: float = DRIFT) -> Column:
    return F.when(value >= drift, "drift").when(value >= warn, "warn").otherwise("ok")


def ks_statistic(reference: DataFrame, current: DataFrame, feature: str, buckets: int = 256) -> DataFrame:
    """One row: the two-sample KS statistic and its asymptotic p-value.

    Counts by distinct value are cumulated within value ranges plus a prefix.
    """
    both = reference.select(F.col(feature).cast("double").alias("x"), F.lit(1).alias("a")).unionByName(
        current.select(F.col(feature).cast("double").alias("x"), F.lit(0).alias("a"))
    ).where("x is not null and not isnan(x)")
    points = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
    # Ranges of about as many distinct values each, however they are spread.
    bounds = F.array_distinct(F.percentile_approx("x", [i / buckets for i in range(1, buckets)])).alias("bounds")
    span = points.agg(bounds, F.sum("a").alias("na"), F.sum("b").alias("nb"))
    slot = F.size(F.filter("bounds", lambda v: v < F.col("x")))
    points = points.crossJoin(F.broadcast(span)).withColumn("slot", slot).drop("bounds")
    totals = points.groupBy("slot").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    prefix = totals.select("slot", zero(F.sum("ta").over(before)).alias("pa"), zero(F.sum("tb").over(before)).alias("pb"))
    inside = Window.partitionBy("slot").orderBy("x")
    gap = F.abs((F.col("pa") + F.sum("a").over(inside)) / F.col("na") - (F.col("pb") + F.sum("b").over(inside)) / F.col("nb"))
    d = points.join(F.broadcast(prefix), "slot").select("na", "nb", gap.alias("gap")).agg(
        F.max("gap").alias("ks"), F.max("na").alias("na"), F.max("nb").alias("nb")
    )
    z = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks")
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * z * z))
    return d.select("ks", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def psi_null(df: DataFrame, feature: str, sample_size: int, draws: int = 200, bins: int = 10, seed: int = 0) -> DataFrame:
    """draw, psi between random samples of one stationary population: the statistic's noise.

    Each draw takes rows by a seeded hash with the probability that gives
    ``sample_size`` rows, so nothing is sorted, and a row is copied only into the
    draws that take it.
    """
    n = df.count()
    share = min(1.0, sample_size / max(n, 1))
    takes = lambda d: F.pmod(F.xxhash64(F.lit(seed), d, "tx_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sampled = df.select(feature, F.explode(F.filter(F.sequence(F.lit(1), F.lit(draws)), takes)).alias("draw"))
    return psi(df, sampled, [feature], "draw", bins=bins).select("draw", "psi")


def window_reports(reference: DataFrame, current: DataFrame, features: list[str], hours: int = 6, min_rows: int = 1000, top: int = 5, threshold: float | None = None) -> DataFrame:
    """One row a tumbling window of ``hours``: rows, largest PSI, status, top features, score PSI, alert rate.

    Windows with fewer than ``min_rows`` rows are skipped.
    """
    size = hours * 3600
    placed = current.withColumn("window_start", F.floor(F.col("t") / size) * size)
    big = placed.groupBy("window_start").agg(
        F.count("*").alias("n_rows"), F.avg((F.col("score") >= threshold).cast("double")).alias("alert_rate") if threshold is not None else F.lit(None).cast("double").alias("alert_rate")
    ).where(F.col("n_rows") >= min_rows)
    values = psi(reference, placed.join(F.broadcast(big.select("window_start")), "window_start", "left_semi"), [*features, "score"], "window_start")
    by_size = F.slice(F.array_sort(F.collect_list(F.when(F.col("feature") != "score", F.struct((-F.col("psi")).alias("neg"), "feature", "psi")))), 1, top)
    found = values.groupBy("window_start").agg(
        F.max(F.when(F.col("feature") != "score", F.col("psi"))).alias("psi_max"),
        F.max(F.when(F.col("feature") == "score", F.col("psi"))).alias("psi_score"),
        F.map_from_entries(F.transform(by_size, lambda s: F.struct(s["feature"], s["psi"]))).alias("psi_top"),
    )
    return found.join(big, "window_start").withColumn("status", status(F.greatest("psi_max", "psi_score")))


def status_events(reports: DataFrame) -> DataFrame:
    """Windows whose status changed and is not ok (a row a window: small)."""
    before = F.lag("status").over(Window.orderBy("window_start"))
    return reports.withColumn("previous", F.coalesce(before, F.lit("ok"))).where("status <> previous and status <> 'ok'")


def threshold_alarms(values: DataFrame, level: float = DRIFT, patience: int = 1, key: str = "stream") -> DataFrame:
    """Rows where ``x`` has reached ``level`` in each of the last ``patience`` rows; an alarm starts the count anew."""
    order = Window.partitionBy(key).orderBy("i")
    low = (F.coalesce(F.col("x"), F.lit(float("-inf"))) < level).cast("int")
    islands = values.withColumn("island", F.sum(low).over(order)).withColumn("high", low == 0)
    streak = F.sum(F.col("high").cast("int")).over(Window.partitionBy(key, "island").orderBy("i"))
    return islands.withColumn("streak", streak).where(F.col("high") & (F.col("streak") % patience == 0)).select(key, "i", "x")


def calibrate_threshold(values: DataFrame, rate: float) -> float:
    """The level that stationary values exceed at ``rate``; refuses too few values."""
    if not 0 < rate < 1:
        raise ValueError("the rate is between 0 and 1")
    clean = values.where("x is not null and not isnan(x)")
    n, level = clean.count(), column_quantiles(clean, "x", [1 - rate])
    if n < math.ceil(1 / rate):
        raise ValueError(f"{n} stationary values cannot resolve a rate of {rate:g}")
    return level[0]


# --- sequential detectors -------------------------------------------------


@dataclass
class PageHinkley:
    """Sustained shift of a mean; starts anew after an alarm."""

    delta: float = 0.005
    threshold: float = 50.0
    min_instances: int = 1
    direction: str = "up"
    state: list[float] = field(default_factory=lambda: [0.0] * 6)

    def update(self, x: float) -> bool:
        n, mean, up, up_low, down, down_high = self.state
        n += 1
        mean += (x - mean) / n
        up, down = up + x - mean - self.delta, down + x - mean + self.delta
        up_low, down_high = min(up_low, up), max(down_high, down)
        rise = {"up": up - up_low, "down": down_high - down, "both": max(up - up_low, down_high - down)}[self.direction]
        alarm = n >= self.min_instances and rise > self.threshold
        self.state = [0.0] * 6 if alarm else [n, mean, up, up_low, down, down_high]
        return alarm


@dataclass
class Adwin:
    """Adaptive window: older values go as long as some split has means further apart than chance allows."""

    delta: float = 0.002
    least: int = 5
    most: int = 10_000
    state: list[float] = field(default_factory=list)

    def _cut(self) -> int:
        x = np.asarray(self.state)
        n = len(x)
        if n < 2 * self.least:
            return 0
        k = np.arange(self.least, n - self.least + 1)
        head = np.cumsum(x)[k - 1]
        inverse = 1.0 / k + 1.0 / (n - k)
        log_term = math.log(2.0 * n / self.delta)
        bound = np.sqrt(2.0 * x.var() * log_term * inverse) + 2.0 / 3.0 * log_term * inverse
        apart = np.abs(head / k - (x.sum() - head) / (n - k)) > bound
        return int(k[apart.argmax()]) if apart.any() else 0

    def update(self, x: float) -> bool:
        self.state = [*self.state, x][-self.most :]
        changed = False
        while cut := self._cut():
            self.state = self.state[cut:]
            changed = True
        return changed


@dataclass
class Patience:
    """A level reached by ``patience`` values one after another; an alarm starts the count anew."""

    level: float = DRIFT
    patience: int = 1
    state: list[float] = field(default_factory=lambda: [0.0])

    def update(self, x: float) -> bool:
        streak = self.state[0] + 1 if x >= self.level else 0.0
        alarm = streak >= self.patience
        self.state = [0.0 if alarm else streak]
        return alarm


def detect(values: DataFrame, make: Callable[[], PageHinkley | Adwin | Patience], key: str = "stream") -> DataFrame:
    """Alarms (key, i, x) of an ordered detector over each stream's rows (i, x).

    A stream is one monitored statistic, a row a window: streams are many and
    short, and one stream is a sequential fold by nature.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        detector = make()
        rows = group.sort_values("i")
        return rows[[detector.update(float(x)) for x in rows["x"]]][[key, "i", "x"]]

    kind = dict(values.dtypes)[key]
    return values.select(key, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).groupBy(key).applyInPandas(fold, f"{key} {kind}, i long, x double")


def detection_latency(alarms: DataFrame, onset: int, key: str = "stream") -> DataFrame:
    """First alarm at or after the onset, its delay, and the false alarms before it, by stream."""
    return alarms.groupBy(key).agg(
        F.min(F.when(F.col("i") >= onset, F.col("i"))).alias("detected_at"),
        (F.min(F.when(F.col("i") >= onset, F.col("i"))) - onset).alias("latency"),
        F.count(F.when(F.col("i") < onset, 1)).alias("false_alarms"),
    )
