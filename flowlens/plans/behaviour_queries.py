"""Behavioural features over the event and order transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour as B
from ..sources.transfers import EVENT_TX, ORDER_TX, event_transfers, order_transfers
from .registry import query, rounded

_WINDOWS = {"5min": 300, "1h": 3600, "24h": 86400, "7D": 604800}


def _window_sql(windows: dict[str, int], tx: str = EVENT_TX) -> str:
    """Each stream apart: its events and its queries side by side, one range frame a window."""
    parts, joins, columns = [], [], []
    for q, e in (("src", "src"), ("src", "dst"), ("dst", "dst"), ("dst", "src")):
        stream = f"{q}_{'out' if e == 'src' else 'in'}"
        frames = ", ".join(
            f"coalesce(sum(ev) OVER w{w}, 0) AS cnt_{n}, coalesce(sum(ev * amount) OVER w{w}, 0) AS sum_{n}" for n, w in windows.items()
        )
        defs = ", ".join(f"w{w} AS (PARTITION BY acct ORDER BY t RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in windows.values())
        parts.append(f"""{stream} AS (
  SELECT * FROM (
    SELECT tx_id, ev, {frames} FROM (
      SELECT NULL AS tx_id, {e} AS acct, t, amount, 1 AS ev FROM tx
      UNION ALL SELECT tx_id, {q}, t, amount, 0 FROM tx
    ) WINDOW {defs}
  ) WHERE ev = 0)""")
        joins.append(f"JOIN {stream} USING (tx_id)")
        for n in windows:
            columns += [f"CAST({stream}.cnt_{n} AS BIGINT) AS {stream}_cnt_{n}", f"round({stream}.sum_{n}, 4) AS {stream}_sum_{n}"]
    return f"WITH {tx}, {', '.join(parts)} SELECT tx_id, {', '.join(columns)} FROM tx {' '.join(joins)}"


def _windows(tx: DataFrame, windows: dict[str, int]) -> DataFrame:
    made = B.window_features(tx, windows)
    return rounded(made, 4, *[c for c in made.columns if "_sum_" in c])


@query("w1_behavioural_windows", _window_sql(_WINDOWS))
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(event_transfers(spark, sf_dir), _WINDOWS)


@query("w_behavioural_24h", _window_sql({"24h": 86400}))
def w1_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(event_transfers(spark, sf_dir), {"24h": 86400})


@query("w1_order_windows", _window_sql({"24h": 86400, "7D": 604800}, ORDER_TX))
def w1_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(order_transfers(spark, sf_dir), {"24h": 86400, "7D": 604800})


_HISTORY_SQL = """
WITH {tx},
sent AS (
  SELECT *, ln(1 + amount) AS la FROM tx
), o AS (
  SELECT tx_id, count(*) OVER p AS n, avg(la) OVER p AS m, stddev_pop(la) OVER p AS s, max(amount) OVER p AS mx, max(t) OVER p AS last_t
  FROM sent WINDOW p AS (PARTITION BY src ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), firsts AS (
  SELECT src, dst, min(t) AS t FROM tx GROUP BY src, dst
), cross_rows AS (
  SELECT tx_id, 'src_in' AS k, src AS acct, t, 0 AS ev, NULL AS et FROM tx UNION ALL SELECT NULL, 'src_in', dst, t, 1, t FROM tx
  UNION ALL SELECT tx_id, 'dst_in', dst, t, 0, NULL FROM tx UNION ALL SELECT NULL, 'dst_in', dst, t, 1, t FROM tx
  UNION ALL SELECT tx_id, 'dst_out', dst, t, 0, NULL FROM tx UNION ALL SELECT NULL, 'dst_out', src, t, 1, t FROM tx
  UNION ALL SELECT tx_id, 'src_cp', src, t, 0, NULL FROM tx UNION ALL SELECT NULL, 'src_cp', src, t, 1, t FROM firsts
  UNION ALL SELECT tx_id, 'dst_cp', dst, t, 0, NULL FROM tx UNION ALL SELECT NULL, 'dst_cp', dst, t, 1, t FROM firsts
), c AS (
  SELECT tx_id, k, ev, coalesce(sum(ev) OVER p, 0) AS n, max(et) OVER p AS last_t FROM cross_rows
  WINDOW p AS (PARTITION BY k, acct ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wide AS (
  SELECT tx_id, max(CASE WHEN k = 'src_in' THEN n END) AS src_in, max(CASE WHEN k = 'src_in' THEN last_t END) AS src_in_t,
         max(CASE WHEN k = 'dst_in' THEN n END) AS dst_in, max(CASE WHEN k = 'dst_out' THEN n END) AS dst_out,
         max(CASE WHEN k = 'src_cp' THEN n END) AS src_cp, max(CASE WHEN k = 'dst_cp' THEN n END) AS dst_cp
  FROM c WHERE ev = 0 GROUP BY tx_id
)
SELECT tx_id, CAST(n AS BIGINT) AS src_out_n_hist, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS src_has_history,
       round(CASE WHEN n >= 3 THEN (la - m) / (s + 1e-3) END, 4) AS amt_z_src,
       round(CASE WHEN n >= 1 THEN la - m END, 6) AS amt_log_ratio_src_mean,
       round(CASE WHEN n >= 1 THEN amount / (mx + 1e-6) END, 6) AS amt_vs_src_max,
       t - last_t AS src_secs_since_out, t - src_in_t AS src_secs_since_in,
       CAST(src_in AS BIGINT) AS src_in_n_hist, CAST(dst_in AS BIGINT) AS dst_in_n_hist, CAST(dst_out AS BIGINT) AS dst_out_n_hist,
       CAST(src_cp AS BIGINT) AS src_n_counterparties, CAST(dst_cp AS BIGINT) AS dst_n_counterparties
FROM sent JOIN o USING (tx_id) JOIN wide USING (tx_id)
"""


def _history(tx: DataFrame) -> DataFrame:
    return rounded(rounded(B.history_features(tx), 4, "amt_z_src"), 6, "amt_log_ratio_src_mean", "amt_vs_src_max")


@query("w3_history_features", _HISTORY_SQL.format(tx=EVENT_TX))
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(event_transfers(spark, sf_dir))


@query("w3_order_history", _HISTORY_SQL.format(tx=ORDER_TX))
def w3_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(order_transfers(spark, sf_dir))


@query("w2_pass_through", f"""WITH {EVENT_TX}, u AS (
  SELECT tx_id, src AS acct, t, amount, 0 AS ev FROM tx UNION ALL SELECT NULL, dst, t, amount, 1 FROM tx
), s AS (
  SELECT tx_id, amount, ev, coalesce(sum(ev * amount) OVER (PARTITION BY acct ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS got FROM u
) SELECT tx_id, round(amount / (got + 1), 6) AS amt_over_src_in_24h FROM s WHERE ev = 0""")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.behavioural_features(event_transfers(spark, sf_dir), {"24h": 86400})
    return rounded(made.select("tx_id", "amt_over_src_in_24h"), 6, "amt_over_src_in_24h")


@query("w9_counterparty_is_new", f"""WITH {EVENT_TX}
SELECT tx_id, CASE WHEN NOT EXISTS (SELECT 1 FROM tx b WHERE b.src = a.src AND b.dst = a.dst AND b.t < a.t) THEN 1 ELSE 0 END AS counterparty_is_new FROM tx a""")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counterparty_is_new(event_transfers(spark, sf_dir))


def _velocity_sql() -> str:
    windows = {"5min": 300, "1h": 3600, "24h": 86400, "7D": 604800}
    cols = ", ".join(
        f"count(amount) OVER w{w} AS cnt_{n}, round(coalesce(sum(amount) OVER w{w}, 0), 4) AS sum_{n}, coalesce(max(amount) OVER w{w}, 0) AS max_{n}"
        for n, w in windows.items()
    )
    defs = ", ".join(f"w{w} AS (PARTITION BY src ORDER BY t RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in windows.values())
    return f"WITH {EVENT_TX}, v AS (SELECT tx_id, {cols} FROM tx WINDOW {defs}) SELECT *, round(cnt_1h / (cnt_7D / 168.0::DOUBLE + 1e-6), 4) AS burst_1h FROM v"


@query("w11_rolling_velocity", _velocity_sql())
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.rolling_velocity(event_transfers(spark, sf_dir))
    return rounded(made, 4, "burst_1h", *[c for c in made.columns if c.startswith("sum_")])


@query("w13_personal_baseline", f"""WITH {EVENT_TX}, b AS (
  SELECT tx_id, amount, count(*) OVER p AS n, avg(amount) OVER p AS m, stddev_samp(amount) OVER p AS s, max(amount) OVER p AS mx,
         quantile_cont(amount, 0.5) OVER p AS med, row_number() OVER (PARTITION BY src, dst ORDER BY t, tx_id) AS k
  FROM tx WINDOW p AS (PARTITION BY src ORDER BY t, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) SELECT tx_id, round(CASE WHEN n >= 5 THEN (amount - m) / (s + 1e-6) END, 4) AS amt_z_personal,
  round(CASE WHEN n >= 5 THEN amount / (mx + 1e-6) END, 6) AS amt_vs_personal_max,
  round(CASE WHEN n >= 5 THEN ln(1 + amount) - ln(1 + med) END, 6) AS amt_log_ratio_median,
  CASE WHEN n >= 5 THEN 1 ELSE 0 END AS has_history, CASE WHEN k = 1 THEN 1 ELSE 0 END AS counterparty_is_new FROM b""")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.personal_baseline(event_transfers(spark, sf_dir))
    return rounded(rounded(made, 4, "amt_z_personal"), 6, "amt_vs_personal_max", "amt_log_ratio_median")


@query("a23_interarrival", f"""WITH {EVENT_TX}, g AS (
  SELECT src, t, t - lag(t) OVER (PARTITION BY src ORDER BY t, tx_id) AS gap FROM tx
), o AS (
  SELECT src, count(*) AS n, count(*) FILTER (gap > 0) AS k, avg(gap) FILTER (gap > 0) AS m, stddev_pop(gap) FILTER (gap > 0) AS s,
         quantile_cont(gap, 0.5) FILTER (gap > 0) AS med, min(gap) FILTER (gap > 0) AS mn FROM g GROUP BY src
), h AS (
  SELECT src, t // 3600 % 24 AS h, count(*) AS c FROM tx GROUP BY ALL
), e AS (
  SELECT src, sum(-(c / tot) * ln(c / tot)) AS e FROM (SELECT src, CAST(c AS DOUBLE) AS c, sum(c) OVER (PARTITION BY src) AS tot FROM h) GROUP BY src
) SELECT src, round(CASE WHEN n < 3 THEN NULL WHEN k = 0 THEN 0 ELSE s / greatest(m, 1e-9) END, 6) AS iat_cv,
  round(CASE WHEN n < 3 THEN NULL WHEN k = 0 THEN 0 ELSE med END, 6) AS iat_median,
  CAST(CASE WHEN n < 3 THEN NULL WHEN k = 0 THEN 0 ELSE mn END AS DOUBLE) AS iat_min,
  round(CASE WHEN n < 3 THEN NULL WHEN k = 0 THEN 0 ELSE e END, 6) AS hour_entropy,
  round(CASE WHEN n < 3 THEN 0 WHEN k = 0 THEN 1 ELSE exp(-s / greatest(m, 1e-9)) * exp(-e / 3) END, 6) AS automation_score
FROM o JOIN e USING (src)""")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.interarrival(event_transfers(spark, sf_dir)), 6, "iat_cv", "iat_median", "hour_entropy", "automation_score")


@query("a22_concentration", f"""WITH {EVENT_TX}, p AS (SELECT src, dst, sum(amount) AS a FROM tx GROUP BY ALL)
SELECT src, round(CASE WHEN sum(a) > 0 THEN sum(a * a) / (sum(a) * sum(a)) ELSE 0 END, 8) AS hhi FROM p GROUP BY src""")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.concentration(event_transfers(spark, sf_dir)), 8, "hhi")
