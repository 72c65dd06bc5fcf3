"""The query surface for analysts: functions that return DataFrames.

Tables: transactions (tx_id, src, dst, amount, t, fmt, score), alerts (alert_id,
tx_id, risk_score, t, status, packet...), rings, windows, runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import ego_network
from ..sources.store import latest_runs

DISPOSITIONS = ("open", "escalated", "dismissed")


def summary(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: span and number of scored transfers, alerts in all and by status."""
    scored = tx.where("score is not null").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_scored"))
    counts = alerts.agg(F.count("*").alias("n_alerts"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in DISPOSITIONS])
    return scored.crossJoin(counts)


def with_rank(alerts: DataFrame) -> DataFrame:
    """rank: 1 + number of alerts with a higher risk, over all statuses.

    Distinct risks are counted and cumulated first, so the global order covers
    one row a risk value.
    """
    levels = alerts.groupBy("risk_score").count()
    above = Window.orderBy(F.desc("risk_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select("risk_score", (1 + F.coalesce(F.sum("count").over(above), F.lit(0))).alias("rank"))
    return alerts.join(ranks, "risk_score")


def list_alerts(alerts: DataFrame, state: str | None = None, sort: str = "risk", limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of alerts and the number that match."""
    ranked = with_rank(alerts)
    found = ranked if state is None else ranked.where(F.col("status") == state)
    order = [F.desc("risk_score"), F.asc("alert_id")] if sort == "risk" else [F.desc("t"), F.asc("alert_id")]
    return found.orderBy(*order).offset(offset).limit(limit), found.count()


def get_alert(alerts: DataFrame, alert_id: int) -> DataFrame:
    """The alert with its packet; fails for one without evidence."""
    found = alerts.where(F.col("alert_id") == alert_id)
    return found.withColumn("source_record_ids", F.when(F.size("source_record_ids") > 0, F.col("source_record_ids")).otherwise(F.raise_error(F.lit("alert without evidence"))))


def set_disposition(alerts: DataFrame, alert_id: int, status: str) -> DataFrame:
    """Alerts with one status changed."""
    if status not in DISPOSITIONS:
        raise ValueError(f"status is one of {DISPOSITIONS}")
    return alerts.withColumn("status", F.when(F.col("alert_id") == alert_id, status).otherwise(F.col("status")))


def account_transactions(tx: DataFrame, account: int | str, until: int, limit: int = 100) -> DataFrame:
    """An account's transfers strictly before ``until``, latest first."""
    return tx.where(((F.col("src") == account) | (F.col("dst") == account)) & (F.col("t") < until)).orderBy(F.desc("t"), "tx_id").limit(limit)


def account_totals(tx: DataFrame, account: int | str) -> DataFrame:
    """Count and sum, in and out."""
    own = lambda c, x: F.coalesce(F.sum(F.when(F.col(c) == account, x)), F.lit(0))
    return tx.where((F.col("src") == account) | (F.col("dst") == account)).agg(
        own("dst", F.lit(1)).alias("in_count"), own("dst", F.col("amount")).alias("in_sum"), own("src", F.lit(1)).alias("out_count"), own("src", F.col("amount")).alias("out_sum")
    )


def network(tx: DataFrame, account: int, until: int, hops: int = 2, limit: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """Edges, nodes with the risk of their riskiest edge, and whether the budget cut edges off."""
    edges = ego_network(tx, account, until, limit, hops)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"), "score").groupBy("node").agg(F.max("score").alias("risk"))
    return edges, nodes, edges.count() >= limit


def list_rings(rings: DataFrame, limit: int = 200) -> DataFrame:
    return rings.orderBy(F.desc("score"), "ring_id").limit(limit)


def ring_transactions(rings: DataFrame, tx: DataFrame) -> DataFrame:
    """ring_id and the transfers between its members."""
    members = rings.select("ring_id", F.explode("members").alias("src"))
    ends = members.select("ring_id", F.col("src").alias("dst"))
    return tx.join(members, "src").join(ends, ["ring_id", "dst"])


def list_models(runs: DataFrame) -> DataFrame:
    return latest_runs(runs).orderBy("model")
