"""Responses to drift, and a walk forward that sets them against doing nothing.

A window is scored before its labels may be used; every fit checks that its rows
end before the window that the model will score.  Windows are filters of one
stored stream, so a step costs a few scans of a window and, after an alarm, one fit.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .drift import DRIFT, WARN, psi
from .metrics import evaluate
from .quantiles import column_quantiles
from .splits import chronological_fit_rows


class LabelLeak(RuntimeError):
    """A model was to score rows that it may have been fitted on."""


class Model(Protocol):
    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Model: ...

    def score(self, df: DataFrame) -> DataFrame: ...


def budget_threshold(scored: DataFrame, rate: float) -> float:
    """The score above which a share ``rate`` of the rows lies; labels play no part."""
    if not 0 < rate < 1:
        raise ValueError("the alert rate is between 0 and 1")
    level = column_quantiles(scored, "score", [1 - rate])
    if level is None:
        raise ValueError("no scores to set a threshold on")
    return level[0]


@dataclass
class Fit:
    """A model, the extent of the labels it saw, and the newest of them, which only stopped it."""

    model: Model
    start: int
    end: int
    rows: int
    positives: int
    newest: DataFrame


def fit_chronological(make: Callable[[], Model], labelled: DataFrame, not_after: int, val_frac: float = 0.2, label: str = "label") -> Fit:
    """Fit on the oldest rows and validate on the newest; all of them end before ``not_after``."""
    n, positives, lo, hi = labelled.agg(F.count("*"), F.sum(label), F.min("t"), F.max("t")).first()
    if not n:
        raise ValueError("no labelled rows to fit on")
    if hi >= not_after:
        raise LabelLeak(f"training rows reach {hi}, the next scored window starts at {not_after}")
    folds = chronological_fit_rows(labelled, not_after, val_frac)
    train, val = (folds.where(F.col("fold") == f).drop("fold") for f in ("train", "val"))
    return Fit(make().fit(train, val), lo, hi, n, positives or 0, val)


@dataclass
class Moment:
    """What a policy may use when a window has been scored: usable labels, the window's scores without labels."""

    now: int
    labelled: DataFrame
    recent: DataFrame
    threshold: float
    rate: float
    make: Callable[[], Model]
    val_frac: float = 0.2


@dataclass
class Decision:
    """A new model or threshold, or neither."""

    action: str
    fit: Fit | None = None
    threshold: float | None = None


Policy = Callable[[Moment], Decision]


def static() -> Policy:
    return lambda m: Decision("none")


def recalibrate() -> Policy:
    """Move the threshold so that the recent scores meet the alert rate again; the ranking stays."""
    return lambda m: Decision("recalibrate", threshold=budget_threshold(m.recent, m.rate))


def retrain(window: int | None = None, min_positives: int = 5) -> Policy:
    """Fit anew on all usable labels, or those of the last ``window`` seconds; skipped with too few positives.

    The threshold is set on the newest usable rows, which the model did not fit.
    """

    def act(m: Moment) -> Decision:
        rows, name = m.labelled, "retrain all" if window is None else f"retrain last {window} s"
        if window is not None:
            newest = rows.agg(F.max("t")).first()[0]
            rows = rows.where(F.col("t") >= (newest or 0) - window)
        positives = rows.agg(F.coalesce(F.sum("label"), F.lit(0))).first()[0]
        if positives < min_positives:
            return Decision(f"{name}: skipped, {positives} positives")
        fit = fit_chronological(m.make, rows, m.now, m.val_frac)
        return Decision(name, fit, budget_threshold(fit.model.score(fit.newest.drop("label")), m.rate))

    return act


@dataclass
class Level:
    """A detector: the value has reached a level in each of the last ``patience`` windows."""

    level: float = DRIFT
    patience: int = 1
    streak: int = 0

    def update(self, x: float) -> bool:
        self.streak = self.streak + 1 if x >= self.level else 0
        alarm = self.streak >= self.patience
        if alarm:
            self.streak = 0
        return alarm


#: Columns of a window's record.
RECORD = (
    "window int, start long, end long, n long, positives long, static_pr_auc double, adaptive_pr_auc double, static_alert_rate double, "
    "adaptive_alert_rate double, static_recall double, adaptive_recall double, threshold double, version int, psi_max double, psi_score double, "
    "status string, alarm boolean, action string, trained_until long"
)


@dataclass
class Walk:
    """Records of the windows, one tuple each in the order of ``RECORD``."""

    reference_pr_auc: float | None
    records: list[tuple] = field(default_factory=list)


def _arm(scored: DataFrame, threshold: float, rate: float, n: int) -> tuple[float | None, float, float | None]:
    """PR-AUC (None without positives), alert rate, and recall at the threshold of a scored window."""
    alerts = scored.agg(F.avg((F.col("score") >= threshold).cast("double")), F.avg(F.when(F.col("label") == 1, (F.col("score") >= threshold).cast("double")))).first()
    found = evaluate(scored.select(F.col("label").alias("y"), "score"), max(1, round(rate * n))).select("pr_auc").first()
    return (found["pr_auc"] if found else None), alerts[0], alerts[1]


def walk_forward(
    stream: DataFrame, features: list[str], make: Callable[[], Model], reference_end: int, window: int, detector: object, policy: Policy, rate: float,
    embargo: int = 0, label_delay: int = 0, val_frac: float = 0.2, monitored: str = "psi_score", rereference: bool = True,
) -> Walk:
    """Score window after window by a static and an adaptive model.

    ``stream``: tx_id, t, label and features, stored.  The first model ends a gap
    (the larger of embargo and label delay) before the reference window, which
    ends where scoring begins.  After a change the next window becomes the
    monitor's reference and the detector starts anew, else a new model's scores
    would raise alarms against the old one's.
    """
    gap, reference_start = max(embargo, label_delay), reference_end - window
    span = lambda lo, hi: stream.where((F.col("t") >= lo) & (F.col("t") < hi))
    first = fit_chronological(make, stream.where(F.col("t") < reference_start - gap), reference_start, val_frac)
    reference = materialize(first.model.score(span(reference_start, reference_end)), "walk-reference")
    n = reference.count()
    if not n:
        raise ValueError("the reference window holds no rows")
    level = budget_threshold(reference, rate)
    model, threshold, version, until, fresh = first.model, level, 0, first.end, False
    watching = copy.deepcopy(detector)
    out = Walk(_arm(reference, level, rate, n)[0])
    last = stream.agg(F.max("t")).first()[0]
    for k in range(max(0, (last - reference_end) // window + 1)):
        start, end = reference_end + k * window, reference_end + (k + 1) * window
        rows = span(start, end)
        n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not n:
            continue
        if max(until, first.end) >= start - gap:
            raise LabelLeak(f"a model fitted up to {max(until, first.end)} would score the window from {start}")
        before = materialize(first.model.score(rows), "walk-static")
        scored = before if model is first.model else materialize(model.score(rows), "walk-adaptive")
        trained_until, used, used_version = until, threshold, version
        arms = _arm(before, level, rate, n), _arm(scored, threshold, rate, n)
        values = dict(psi(reference, scored, [*features, "score"]).select("feature", "psi").collect())
        seen = {"psi_score": values.pop("score"), "psi_max": max(values.values())}
        worst = max(seen.values())
        alarm, action = False, None
        if fresh:
            reference, fresh, watching = scored, False, copy.deepcopy(detector)
        else:
            alarm = bool(watching.update(seen[monitored]))
        if alarm:
            decision = policy(Moment(end, stream.where(F.col("t") < end - gap), scored.drop("label"), threshold, rate, make, val_frac))
            action = decision.action
            if decision.fit is not None:
                model, version, until = decision.fit.model, version + 1, decision.fit.end
            threshold = threshold if decision.threshold is None else decision.threshold
            fresh = rereference and (decision.fit is not None or decision.threshold is not None)
        status = "drift" if worst >= DRIFT else "warn" if worst >= WARN else "ok"
        out.records.append((
            k, start, end, n, positives, arms[0][0], arms[1][0], arms[0][1], arms[1][1], arms[0][2], arms[1][2], used, used_version,
            seen["psi_max"], seen["psi_score"], status, alarm, action, trained_until,
        ))
    return out


def accounting(windows: DataFrame, onset: int, reference_pr_auc: float | None = None) -> DataFrame:
    """One row: when drift was detected, how late, false alarms before it, and the PR-AUC lost.

    ``windows``: end, alarm, static_pr_auc, adaptive_pr_auc.  A window counts as
    after the onset if it ends after it.  Losses are sums of (mean static PR-AUC
    before the onset - the window's) over windows that have one; the gap ends
    with the window of the first alarm after the onset.
    """
    post = F.col("end") > onset
    base = F.coalesce(F.avg(F.when(~post, F.col("static_pr_auc"))), F.lit(reference_pr_auc).cast("double"))
    facts = windows.agg(base.alias("baseline_pr_auc"), F.min(F.when(post & F.col("alarm"), F.col("end"))).alias("detected_at"), F.count_if(~post & F.col("alarm")).alias("false_alarms"))
    after = windows.where(post).crossJoin(F.broadcast(facts))
    lost = lambda c, also=F.lit(True): F.sum(F.when(also, F.col("baseline_pr_auc") - F.col(c)))
    in_gap = F.col("detected_at").isNull() | (F.col("end") <= F.col("detected_at"))
    losses = after.agg(
        lost("adaptive_pr_auc", in_gap).alias("lost_to_detection"), lost("static_pr_auc").alias("lost_static"), lost("adaptive_pr_auc").alias("lost_adaptive"),
        F.avg("static_pr_auc").alias("mean_static"), F.avg("adaptive_pr_auc").alias("mean_adaptive"),
    )
    return facts.crossJoin(losses).withColumn("latency_hours", (F.col("detected_at") - onset) / 3600)
