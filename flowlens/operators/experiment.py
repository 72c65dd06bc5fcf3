"""Runs over several seeds, their artefacts and tables, ablations, and settings."""

from __future__ import annotations

import json
import subprocess
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import evaluate
from .splits import integrity, temporal_split

#: Metrics that a run reports.
METRICS = ("pr_auc", "roc_auc", "precision_at_budget", "recall_at_budget", "recall_at_fpr", "max_f1")
#: Parts of names of columns that only grow with time, so that monitors leave them out.
CUMULATIVE = ("n_hist", "n_counterparties", "prior_pair_tx", "in_tx", "out_tx", "degree", "weight")


@dataclass(frozen=True)
class Settings:
    """What a run is made with; combinations that make no sense are refused."""

    train_frac: float = 0.6
    val_frac: float = 0.2
    embargo_hours: int = 24
    longest_window_hours: int = 24
    split_on: str = "time"
    budget: int = 500
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4)

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a mapping; reports every fault at once."""
        names = {f.name for f in fields(cls)}
        made = cls(**{k: tuple(v) if k == "seeds" else v for k, v in values.items() if k in names})
        faults = [f"unknown setting {k}" for k in sorted(set(values) - names)]
        if not (0 < made.train_frac and 0 < made.val_frac and made.train_frac + made.val_frac < 1):
            faults.append("train_frac and val_frac leave no room for a test fold")
        if made.embargo_hours < made.longest_window_hours:
            faults.append("the embargo is shorter than the longest window")
        if made.split_on not in ("time", "rows"):
            faults.append("split_on is 'time' or 'rows'")
        if made.budget < 1 or not made.seeds:
            faults.append("budget and seeds must not be empty")
        if faults:
            raise ValueError("; ".join(faults))
        return made


def load_settings(spark: SparkSession, path: str) -> Settings:
    """Settings from a JSON file that Spark can read."""
    return Settings.of(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def prepare(tx: DataFrame, features: Callable[[DataFrame], DataFrame], settings: Settings | None = None) -> DataFrame:
    """Transfers with their features and folds; fails if folds overlap in time or a feature column is missing."""
    s = settings or Settings()
    made = features(tx)
    lost = [c for c in tx.columns if c not in made.columns]
    if lost:
        raise ValueError(f"features dropped the columns {lost}")
    split = temporal_split(made, train_frac=s.train_frac, val_frac=s.val_frac, embargo=s.embargo_hours * 3600, split_on=s.split_on)
    if not integrity(split).first()["ordered"]:
        raise ValueError("folds overlap in time")
    return split


def code_state() -> str:
    """The commit of the working tree, or "unknown"."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def run_experiment(name: str, fit_score: Callable[[DataFrame, int], DataFrame], split: DataFrame, settings: Settings | None = None) -> DataFrame:
    """model, seed, fold, state and metrics: one row for each seed and scored fold.

    ``fit_score`` takes the split and a seed and returns tx_id, fold, y and score
    of the validation and test rows.
    """
    s = settings or Settings()
    runs, state = None, code_state()
    for seed in s.seeds:
        got = evaluate(fit_score(split, seed), s.budget, by=["fold"]).withColumns({"model": F.lit(name), "seed": F.lit(seed), "state": F.lit(state)})
        runs = got if runs is None else runs.unionByName(got)
    return runs.select("model", "seed", "fold", "state", "n_rows", "n_positive", *METRICS)


def save_run(runs: DataFrame, path: str) -> None:
    """Rows of each seed and their summary as JSON."""
    runs.write.mode("overwrite").json(f"{path}/per_seed")
    summary(runs).write.mode("overwrite").json(f"{path}/summary")


def summary(runs: DataFrame) -> DataFrame:
    """Mean and standard deviation of the metrics over the seeds."""
    stats = [f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return runs.groupBy("model", "fold").agg(F.count("*").alias("n_seeds"), *stats)


def format_table(runs: DataFrame, digits: int = 4) -> DataFrame:
    """model, fold, seeds, and each metric as "mean ± deviation"."""
    text = lambda m: F.format_string(f"%.{digits}f ± %.{digits}f", f"{m}_mean", f"{m}_std").alias(m)
    return summary(runs).select("model", "fold", "n_seeds", *[text(m) for m in METRICS])


def latest(runs: DataFrame, key: str = "model", at: str = "run_at") -> DataFrame:
    """The newest run of each model."""
    newest = runs.groupBy(key).agg(F.max(at).alias(at))
    return runs.join(newest, [key, at], "left_semi")


def best_on_validation(logs: DataFrame, by: str = "model", metric: str = "val_pr_auc") -> DataFrame:
    """The trial of each model with the best validation metric (ties: the first trial)."""
    rest = [c for c in logs.columns if c != by]
    best = logs.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(F.col(metric), -F.col("trial"))).alias("b"))
    return best.select(by, *[F.col(f"b.{c}") for c in rest])


def ablate(groups: dict[str, list[str]], fit_score: Callable[[list[str]], DataFrame], budget: int = 500) -> DataFrame:
    """without, n_features and metrics: the model on all features, then without each group."""
    every = [c for cols in groups.values() for c in cols]
    out = None
    for name, cols in {"nothing": [], **groups}.items():
        left = [c for c in every if c not in cols]
        if not left:
            continue
        got = evaluate(fit_score(left), budget).withColumns({"without": F.lit(name), "n_features": F.lit(len(left))})
        out = got if out is None else out.unionByName(got)
    return out.select("without", "n_features", *METRICS)


def monitored_columns(columns: list[str], cumulative: tuple[str, ...] = CUMULATIVE) -> list[str]:
    """Columns whose names hold none of the parts."""
    return [c for c in columns if not any(part in c for part in cumulative)]


def bulk_load(tx: DataFrame, scores: DataFrame, version: str, table: str) -> int:
    """Replace a table with the transfers, their scores (null if unscored) and the model's version; its rows.

    The rows are written to a table of another name, in parallel, and the old
    table stays as it is until they are complete.  Then it is dropped and the
    new one takes its name: readers between the two steps don't find the name,
    those still at the old rows have to start again.
    """
    spark = tx.sparkSession
    joined = tx.join(scores.select("tx_id", "score"), "tx_id", "left").withColumn("model_version", F.lit(version))
    loaded = f"{table}_{uuid.uuid4().hex}"
    joined.write.saveAsTable(loaded)
    rows = spark.table(loaded).count()
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {loaded} RENAME TO {table}")
    return rows
