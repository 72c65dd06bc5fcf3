"""Chronological splits with an embargo, and checks against leaks.

Boundaries are read off a table of counts per distinct time and collected as a
few numbers; folds are then plain filters that reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import column_quantiles


@dataclass(frozen=True)
class Boundaries:
    """Ends of the training and validation folds, and the gap after each, in seconds."""

    train_end: float
    val_end: float
    embargo: float


def _time_at(df: DataFrame, index: int) -> int:
    """Time of the row at ``index`` in time order: counts by day locate the day, counts by second the row."""
    day = F.floor(F.col("t") / 86400)
    days = df.groupBy(day.alias("d")).count()
    upto = days.withColumn("upto", F.sum("count").over(Window.orderBy("d")))
    hit = upto.where(F.col("upto") > index).orderBy("d").first()
    before = hit["upto"] - hit["count"]
    times = df.where(day == hit["d"]).groupBy("t").count().withColumn("upto", F.sum("count").over(Window.orderBy("t")))
    return times.where(F.col("upto") > index - before).orderBy("t").first()["t"]


def boundaries(df: DataFrame, train_frac: float = 0.6, val_frac: float = 0.2, embargo: int = 86400, split_on: str = "time") -> Boundaries:
    """Where to cut, by fractions of the time span or of the rows (ties go to the earlier fold)."""
    if not (0 < train_frac < 1 and 0 < val_frac < 1 and train_frac + val_frac < 1):
        raise ValueError("fractions must be in (0, 1) and leave room for a test fold")
    if split_on not in ("time", "rows"):
        raise ValueError("split_on is 'time' or 'rows'")
    lo, hi, n = df.agg(F.min("t"), F.max("t"), F.count("*")).first()
    both = train_frac + val_frac
    if split_on == "time":
        return Boundaries(lo + (hi - lo) * train_frac, lo + (hi - lo) * both, embargo)
    return Boundaries(_time_at(df, max(int(n * train_frac) - 1, 0)), _time_at(df, max(int(n * both) - 1, 0)), embargo)


def with_fold(df: DataFrame, b: Boundaries) -> DataFrame:
    """``df`` with fold train, val or test; null inside an embargo."""
    t = F.col("t")
    fold = (
        F.when(t <= b.train_end, "train")
        .when((t > b.train_end + b.embargo) & (t <= b.val_end), "val")
        .when(t > b.val_end + b.embargo, "test")
    )
    return df.withColumn("fold", fold)


def temporal_split(df: DataFrame, **options: object) -> DataFrame:
    """Rows outside the embargoes with their fold; fails if validation or test is empty."""
    out = with_fold(df, boundaries(df, **options)).where("fold is not null")
    folds = {r["fold"] for r in out.select("fold").distinct().collect()}
    if not {"val", "test"} <= folds:
        raise ValueError("the embargo left an empty fold; reduce it or widen the span")
    return out


def rolling_origin(df: DataFrame, n_folds: int = 5, horizon: int = 604800, min_history_frac: float = 0.4, embargo: int = 86400) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(k, train, test) with train before the cut less the embargo, test in the horizon after it."""
    lo, hi = df.agg(F.min("t"), F.max("t")).first()
    start = lo + (hi - lo) * min_history_frac
    for k in range(n_folds):
        cut = start + k * horizon
        train, test = df.where(F.col("t") < cut - embargo), df.where((F.col("t") >= cut) & (F.col("t") < cut + horizon))
        if train.isEmpty() or test.isEmpty():
            continue
        yield k, train, test


def integrity(split: DataFrame) -> DataFrame:
    """One row: whether folds are in strict order of time."""
    ends = split.groupBy("fold").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    of = lambda fold, c: F.max(F.when(F.col("fold") == fold, F.col(c)))
    return ends.agg(((of("train", "hi") < of("val", "lo")) & (of("val", "hi") < of("test", "lo"))).alias("ordered"))


def shared_ids(a: DataFrame, b: DataFrame, id_col: str = "tx_id") -> DataFrame:
    """Ids that both folds hold; empty for a proper split."""
    return a.select(id_col).intersect(b.select(id_col))


def step_folds(df: DataFrame, step: str = "step", train_until: int = 29, val_until: int = 34) -> DataFrame:
    """Fold by discrete time step."""
    s = F.col(step)
    return df.withColumn("fold", F.when(s <= train_until, "train").when(s <= val_until, "val").otherwise("test"))


def chronological_fit_rows(df: DataFrame, not_after: int, val_frac: float = 0.2) -> DataFrame:
    """Rows before ``not_after``, the newest ``val_frac`` of them (by count) as validation."""
    past = df.where(F.col("t") < not_after)
    n = past.count()
    n_val = round(n * val_frac)
    cut = _time_at(past, max(n - n_val - 1, 0))
    return past.withColumn("fold", F.when(F.col("t") <= cut, "train").otherwise("val"))


def embargo_covers(embargo: int, windows: list[int]) -> None:
    """Refuse windows that reach back over the embargo."""
    long = [w for w in windows if w > embargo]
    if long:
        raise ValueError(f"windows {long} are longer than the embargo of {embargo} s")


def assert_no_future_edges(edges: DataFrame, cutoff: int, time: str = "last_t") -> DataFrame:
    """``edges``, after a check that none is at or after ``cutoff``; edges without times can't be checked and fail."""
    if time not in edges.columns:
        raise ValueError(f"edges have no {time}: nothing was checked")
    latest = edges.agg(F.max(time)).first()[0]
    if latest is not None and latest >= cutoff:
        raise AssertionError(f"an edge at {latest} is not before the cut-off {cutoff}")
    return edges


def leakage_canary(fit_score: Callable[[DataFrame, DataFrame], DataFrame], df: DataFrame, train_frac: float = 0.6, shuffles: int = 3, seed: int = 0) -> dict[str, float]:
    """Mean PR-AUC on later rows of models whose training labels were dealt anew, against chance.

    ``fit_score`` takes training rows and later rows and returns the latter with
    score.  A ratio near 1 is healthy; above about 3 information reaches the model
    by another way than the labels.
    """
    from .metrics import evaluate

    cut = (column_quantiles(df, "t", [train_frac]) or [None])[0]
    train, test = df.where(F.col("t") <= cut), df.where(F.col("t") > cut)
    chance = test.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    found = []
    for s in range(shuffles):
        scored = fit_score(permuted_labels(train, seed + s), test)
        row = evaluate(scored.select(F.col("label").alias("y"), "score")).select("pr_auc").first()
        found.append(row["pr_auc"] if row else 0.0)
    observed = sum(found) / max(len(found), 1)
    return {"observed": observed, "chance": chance, "ratio": observed / max(chance, 1e-12)}


def permuted_labels(df: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """``df`` with its labels dealt to other rows, as a canary: skill on them is a leak.

    Rows and labels are ordered by independent hashes within hash blocks of
    equal size, so no global sort is needed.
    """
    block = F.pmod(F.xxhash64(F.lit(seed), "tx_id"), F.lit(64))
    rank = lambda k: F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(seed + k), "tx_id"), "tx_id"))
    keyed = df.withColumn("__b", block)
    rows = keyed.withColumn("__r", rank(1)).drop(label)
    labels = keyed.select("__b", rank(2).alias("__r"), label)
    return rows.join(labels, ["__b", "__r"]).drop("__b", "__r")
