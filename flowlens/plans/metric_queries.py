"""Splits, ranking metrics and drift over the event and order transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import metrics as M
from ..operators.set_similarity import similar_pairs
from ..operators import splits as S
from ..sources.transfers import EVENT_TX, ORDER_TX, event_transfers, order_transfers
from ..streaming.look_back import alert_look_back
from ..streaming.replay import detect_stream, run_through
from .registry import SQL, query, rounded

#: A score with some signal and many ties, from whole numbers only.
_SCORE = "CAST((tx_id * 7919) % 1000 + label * 300 AS DOUBLE) / 1300"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    return tx.withColumn("score", ((F.col("tx_id") * 7919) % 1000 + F.col("label") * 300).cast("double") / 1300).withColumn("y", F.col("label"))


_METRIC_SQL = f"""WITH {EVENT_TX}, s AS (SELECT {{keys}} label AS y, {_SCORE} AS score FROM tx),
pts AS (SELECT {{keys}} score, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY {{keys}} score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM pts
  WINDOW w AS ({{part}} ORDER BY score DESC), g AS ({{part}}))
SELECT {{keys}} CAST(max(p + n) AS BIGINT) AS n_rows, CAST(max(p) AS BIGINT) AS n_positive, round(max(p) / max(p + n), 8) AS prevalence,
  round(sum(pos * tp / (tp + fp)) / max(p), 8) AS pr_auc,
  round(sum(neg * (tp - pos) + pos * neg / 2) / max(p * n), 8) AS roc_auc,
  max(score) FILTER (tp + fp >= {{budget}} + 1) AS budget_threshold,
  CAST(min(tp + fp) FILTER (tp + fp >= {{budget}} + 1) AS BIGINT) AS n_flagged,
  round(arg_max(tp / (tp + fp), score) FILTER (tp + fp >= {{budget}} + 1), 8) AS precision_at_budget,
  round(arg_max(tp / p, score) FILTER (tp + fp >= {{budget}} + 1), 8) AS recall_at_budget,
  round(coalesce(max(tp) FILTER (fp <= 0.001 * n), 0) / max(p), 8) AS recall_at_fpr,
  round(max(2 * tp / (tp + fp + p)), 8) AS max_f1,
  max(score) FILTER (2 * tp / (tp + fp + p) = mf) AS max_f1_threshold
FROM (SELECT *, max(2 * tp / (tp + fp + p)) OVER ({{part}}) AS mf FROM c) WHERE p > 0 {{group}}"""


def _suite(df: DataFrame) -> DataFrame:
    return rounded(df, 8, "prevalence", "pr_auc", "roc_auc", "precision_at_budget", "recall_at_budget", "recall_at_fpr", "max_f1")


@query("a12_metric_suite", _METRIC_SQL.format(keys="", part="", budget=200, group=""))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(M.evaluate(_scored(spark, sf_dir), budget=200))


@query("a32_metrics_by_type", _METRIC_SQL.format(keys="fmt,", part="PARTITION BY fmt", budget=50, group="GROUP BY fmt"))
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(M.evaluate(_scored(spark, sf_dir), budget=50, by=["fmt"]))


@query("t1_split_time", f"""WITH {EVENT_TX}, b AS (SELECT min(t) + (max(t) - min(t)) * CAST(0.6 AS DOUBLE) AS b1, min(t) + (max(t) - min(t)) * CAST(0.8 AS DOUBLE) AS b2 FROM tx)
SELECT fold, count(*) AS n, min(t) AS lo, max(t) AS hi FROM (
  SELECT t, CASE WHEN t <= b1 THEN 'train' WHEN t > b1 + 86400 AND t <= b2 THEN 'val' WHEN t > b2 + 86400 THEN 'test' END AS fold FROM tx, b
) WHERE fold IS NOT NULL GROUP BY fold""")
def t1_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.temporal_split(event_transfers(spark, sf_dir))
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


@query("t1_split_rows", f"""WITH {ORDER_TX}, o AS (SELECT t, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM tx),
b AS (SELECT max(t) FILTER (i = CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT)) AS b1, max(t) FILTER (i = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) AS b2 FROM o)
SELECT fold, count(*) AS n, min(t) AS lo, max(t) AS hi FROM (
  SELECT t, CASE WHEN t <= b1 THEN 'train' WHEN t > b1 + 86400 AND t <= b2 THEN 'val' WHEN t > b2 + 86400 THEN 'test' END AS fold FROM tx, b
) WHERE fold IS NOT NULL GROUP BY fold""")
def t1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.temporal_split(order_transfers(spark, sf_dir), split_on="rows")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


@query("t2_rolling_origin", f"""WITH {EVENT_TX}, b AS (SELECT min(t) AS lo, max(t) AS hi FROM tx), k AS (SELECT unnest(range(5)) AS k),
c AS (SELECT k, lo + (hi - lo) * CAST(0.4 AS DOUBLE) + k * 259200 AS cut FROM b, k)
SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (t < cut - 86400) AS n_train, count(*) FILTER (t >= cut AND t < cut + 259200) AS n_test FROM tx, c GROUP BY k
HAVING count(*) FILTER (t < cut - 86400) > 0 AND count(*) FILTER (t >= cut AND t < cut + 259200) > 0""")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for k, train, test in S.rolling_origin(event_transfers(spark, sf_dir), horizon=259200):
        n = train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test"))).withColumn("k", F.lit(k))
        out = n if out is None else out.unionByName(n)
    return out


@query("t3_integrity", f"""WITH {EVENT_TX}, b AS (SELECT min(t) + (max(t) - min(t)) * 0.6 AS b1, min(t) + (max(t) - min(t)) * 0.8 AS b2 FROM tx)
SELECT max(t) FILTER (t <= b1) < min(t) FILTER (t > b1 + 86400 AND t <= b2) AND max(t) FILTER (t > b1 + 86400 AND t <= b2) < min(t) FILTER (t > b2 + 86400) AS ordered,
  CAST(0 AS BIGINT) AS shared FROM tx, b""")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.temporal_split(event_transfers(spark, sf_dir))
    shared = S.shared_ids(out.where("fold = 'train'"), out.where("fold = 'test'")).agg(F.count("*").alias("shared"))
    return S.integrity(out).crossJoin(shared)


@query("t6_permuted_labels")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.permuted_labels(event_transfers(spark, sf_dir), 3).select("tx_id", "label")


_PSI = """q AS (SELECT list_distinct([{0}]) AS e FROM ref), edges AS (SELECT list_sort(e) AS e FROM q),
bins AS (SELECT unnest(range(len(e) + 2)) AS b, e FROM edges)"""


def _psi_sql() -> str:
    qs = ", ".join(f"quantile_cont(amount, {i / 10})" for i in range(1, 10))
    return f"""WITH {EVENT_TX}, m AS (SELECT min(t) + (max(t) - min(t)) / 2 AS mid FROM tx),
ref AS (SELECT amount FROM tx, m WHERE t < mid), cur AS (SELECT amount * 1.2 AS amount FROM tx, m WHERE t >= mid), {_PSI.format(qs)},
h AS (SELECT b, len(e) + 2 AS k, (SELECT count(*) FROM ref WHERE len(list_filter(e, lambda x: x < ref.amount)) = b) AS nr,
  (SELECT count(*) FROM cur WHERE len(list_filter(e, lambda x: x < cur.amount)) = b) AS nc FROM bins),
p AS (SELECT (nr + 1.0::DOUBLE) / (sum(nr) OVER () + k) AS q, (nc + 1.0::DOUBLE) / (sum(nc) OVER () + k) AS p FROM h)
SELECT 'amount' AS feature, round(sum((p - q) * ln(p / q)), 6) AS psi FROM p"""


@query("a9_psi", _psi_sql())
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    mid = tx.agg((F.min("t") + (F.max("t") - F.min("t")) / 2).alias("mid"))
    placed = tx.crossJoin(F.broadcast(mid))
    late = placed.where("t >= mid").withColumn("amount", F.col("amount") * F.lit(1.2))
    return rounded(D.psi(placed.where("t < mid"), late, ["amount"]), 6, "psi")


@query("a10_ks", f"""WITH {EVENT_TX}, m AS (SELECT min(t) + (max(t) - min(t)) / 2 AS mid FROM tx),
v AS (SELECT amount AS x, CASE WHEN t < mid THEN 1 ELSE 0 END AS a FROM tx, m),
d AS (SELECT x, sum(a) AS a, sum(1 - a) AS b FROM v GROUP BY x),
c AS (SELECT sum(a) OVER (ORDER BY x) / CAST(sum(a) OVER () AS DOUBLE) AS f, sum(b) OVER (ORDER BY x) / CAST(sum(b) OVER () AS DOUBLE) AS g FROM d),
k AS (SELECT max(abs(f - g)) AS ks FROM c), n AS (SELECT CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb FROM d), z AS (SELECT ks, na * nb / (na + nb) * ks * ks AS z2 FROM k, n)
SELECT round(any_value(ks), 8) AS ks, round(greatest(0, least(1, 2 * sum(power(-1.0::DOUBLE, i - 1) * exp(-2.0::DOUBLE * i * i * z2)))), 6) AS p_value FROM z, range(1, 101) r(i)""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    mid = tx.agg((F.min("t") + (F.max("t") - F.min("t")) / 2).alias("mid"))
    placed = tx.crossJoin(F.broadcast(mid))
    return rounded(D.ks_statistic(placed.where("t < mid"), placed.where("t >= mid"), "amount").withColumn("p_value", F.round("p_value", 6)), 8, "ks")


@query("d3_window_status")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = _scored(spark, sf_dir)
    mid = tx.agg((F.min("t") + (F.max("t") - F.min("t")) / 2).alias("mid"))
    placed = tx.crossJoin(F.broadcast(mid)).withColumn("log_amount", F.log1p("amount"))
    return D.window_reports(placed.where("t < mid"), placed.where("t >= mid"), ["amount", "log_amount"], hours=24, min_rows=10, threshold=0.9)


_DAILY = """daily AS (SELECT 'volume' AS stream, CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS i, x FROM (
  SELECT t // 86400 AS d, round(avg(amount), 6) AS x FROM tx GROUP BY ALL))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = event_transfers(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).alias("d")).agg(F.round(F.avg("amount"), 6).alias("x"))
    return days.select(F.lit("volume").alias("stream"), F.row_number().over(Window.orderBy("d")).cast("long").alias("i"), "x")


@query("d8_threshold_alarms", f"""WITH {EVENT_TX}, {_DAILY}, a AS (SELECT *, sum(CASE WHEN x < 50 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS g FROM daily)
SELECT stream, i, x FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM a WHERE x >= 50) WHERE k % 2 = 0""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.threshold_alarms(_daily(spark, sf_dir), level=50.0, patience=2)


@query("d6_page_hinkley")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(_daily(spark, sf_dir), lambda: D.PageHinkley(delta=0.5, threshold=10.0, direction="both"))


@query("d7_adwin")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose volumes are lifted from the middle day on: the window must be cut."""
    days = _daily(spark, sf_dir)
    return D.detect(days.withColumn("x", F.col("x") + F.when(F.col("i") > 15, 100).otherwise(0)), lambda: D.Adwin())


@query("d8_threshold_stream", SQL["d8_threshold_alarms"])
def d8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_through(lambda days: detect_stream(days, lambda: D.Patience(level=50.0, patience=2)), _daily(spark, sf_dir), "threshold-stream")


@query("d7_adwin_stream")
def d7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector of ``d7_adwin`` with its window as state, on the hourly mean amount of each payment format."""
    hours = event_transfers(spark, sf_dir).groupBy(F.col("fmt").alias("stream"), F.floor(F.col("t") / 3600).cast("long").alias("i")).agg(F.avg("amount").alias("x"))
    return run_through(lambda values: detect_stream(values, lambda: D.Adwin()), hours, "adwin-stream")


@query("d2_stream_look_back", f"""WITH {EVENT_TX}, e AS (SELECT *, {_SCORE} AS score FROM tx), a AS (SELECT * FROM e WHERE score >= 0.95 AND t + 1 + 3600 <= (SELECT max(t) FROM e)),
s AS (SELECT tx_id, src AS account, t FROM a UNION SELECT tx_id, dst, t FROM a), h AS (SELECT src AS account, t, amount, score FROM e UNION ALL SELECT dst, t, amount, score FROM e WHERE src <> dst)
SELECT s.tx_id, s.account, s.t, count(h.t) AS n, round(coalesce(sum(h.amount), 0), 4) AS amount, count(h.t) FILTER (WHERE h.score >= 0.95) AS hot, round(max(h.score), 6) AS most
FROM s LEFT JOIN h ON h.account = s.account AND h.t < s.t AND h.t >= s.t - 345600 GROUP BY s.tx_id, s.account, s.t""")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both accounts of every alert did in the 96 hours before, for all alerts that the watermark has passed."""
    out = run_through(lambda tx: alert_look_back(tx, 0.95), _scored(spark, sf_dir).select("tx_id", "src", "dst", "t", "amount", "score"), "look-back")
    return rounded(rounded(out, 4, "amount"), 6, "most")


_RING_DATA = """
mem AS (SELECT tx_id % 40 AS ring_id, src AS account, t FROM tx WHERE label = 1 UNION ALL SELECT tx_id % 40, dst, t FROM tx WHERE label = 1),
rings AS (SELECT ring_id, min(t) AS t_start, max(t) AS t_end FROM mem GROUP BY ring_id),
ev AS (SELECT src AS account, t, {score} AS score FROM tx UNION ALL SELECT dst, t, {score} FROM tx)"""


@query("r4_early_warning", f"""WITH {EVENT_TX}, {_RING_DATA.format(score=_SCORE)}
SELECT r.ring_id, round((r.t_end - (SELECT min(e.t) FROM ev e WHERE e.score >= 0.95 AND e.t <= r.t_end AND e.account IN (SELECT m.account FROM mem m WHERE m.ring_id = r.ring_id))) / 60.0::DOUBLE, 4) AS ewt_minutes
FROM rings r""")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.early_warning(*_ring_inputs(spark, sf_dir), 0.95), 4, "ewt_minutes")


def _ring_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tx = _scored(spark, sf_dir)
    touched = tx.where("label = 1").select((F.col("tx_id") % 40).alias("ring_id"), "t", F.explode(F.array("src", "dst")).alias("account"))
    rings = touched.groupBy("ring_id").agg(F.collect_set("account").alias("members"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    return tx.select("t", "score", F.explode(F.array("src", "dst")).alias("account")), rings


@query("a19_early_warning_summary", f"""WITH {EVENT_TX}, {_RING_DATA.format(score=_SCORE)}, f AS (
  SELECT m.ring_id, min(e.t) AS t FROM (SELECT DISTINCT ring_id, account FROM mem) m JOIN rings r USING (ring_id) JOIN ev e ON e.account = m.account AND e.score >= 0.95 AND e.t <= r.t_end GROUP BY m.ring_id
), w AS (SELECT (t_end - f.t) / 60.0::DOUBLE AS x FROM rings LEFT JOIN f USING (ring_id))
SELECT round(count(x) / CAST(count(*) AS DOUBLE), 6) AS detection_rate, round(quantile_cont(x, 0.5), 4) AS median_ewt_minutes, round(quantile_cont(x, 0.25), 4) AS iqr_low,
  round(quantile_cont(x, 0.75), 4) AS iqr_high, CAST(count(*) - count(x) AS DOUBLE) AS n_censored FROM w""")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.summarise_early_warning(M.early_warning(*_ring_inputs(spark, sf_dir), 0.95))
    return rounded(rounded(out, 6, "detection_rate"), 4, "median_ewt_minutes", "iqr_low", "iqr_high")


def _member_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tx = event_transfers(spark, sf_dir)
    sets = lambda k, name: tx.where("label = 1").groupBy((F.col("tx_id") % k).alias(name)).agg(F.collect_set("src").alias("members"))
    return sets(40, "pid"), sets(80, "tid")


@query("j12_jaccard_pairs", f"""WITH {EVENT_TX}, p AS (SELECT DISTINCT tx_id % 40 AS pid, src FROM tx WHERE label = 1), q AS (SELECT DISTINCT tx_id % 80 AS tid, src FROM tx WHERE label = 1),
np AS (SELECT pid, count(*) AS n FROM p GROUP BY pid), nq AS (SELECT tid, count(*) AS n FROM q GROUP BY tid)
SELECT pid, tid, round(count(*) / CAST(any_value(np.n) + any_value(nq.n) - count(*) AS DOUBLE), 8) AS jaccard FROM p JOIN q USING (src) JOIN np USING (pid) JOIN nq USING (tid) GROUP BY pid, tid""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.jaccard_pairs(*_member_sets(spark, sf_dir)), 8, "jaccard")


@query("j12_similar_sets", f"""WITH {EVENT_TX}, p AS (SELECT DISTINCT tx_id % 997 AS pid, src FROM tx), q AS (SELECT DISTINCT tx_id % 1499 AS tid, src FROM tx),
np AS (SELECT pid, count(*) AS n FROM p GROUP BY pid), nq AS (SELECT tid, count(*) AS n FROM q GROUP BY tid),
j AS (SELECT pid, tid, count(*) / CAST(any_value(np.n) + any_value(nq.n) - count(*) AS DOUBLE) AS jaccard FROM p JOIN q USING (src) JOIN np USING (pid) JOIN nq USING (tid) GROUP BY pid, tid)
SELECT pid, tid, round(jaccard, 8) AS jaccard FROM j WHERE jaccard >= 0.3""")
def j12_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    sets = lambda k, name: tx.groupBy((F.col("tx_id") % k).alias(name)).agg(F.collect_set("src").alias("members"))
    return rounded(similar_pairs(sets(997, "pid"), sets(1499, "tid"), 0.3), 8, "jaccard")


@query("a20_ring_metrics")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ring_metrics(*_member_sets(spark, sf_dir))


@query("a17_over_seeds", f"""WITH {EVENT_TX} SELECT fmt AS model, count(*) AS n_seeds, round(avg(amount), 6) AS amount_mean, round(stddev_samp(amount), 6) AS amount_std FROM tx GROUP BY fmt""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.over_seeds(event_transfers(spark, sf_dir).withColumnRenamed("fmt", "model"), ["amount"]), 6, "amount_mean", "amount_std")


@query("a18_indistinguishable", f"""WITH {EVENT_TX}, s AS (SELECT fmt AS model, avg(amount) AS m, stddev_samp(amount) AS sd FROM tx GROUP BY fmt),
n AS (SELECT model, lead(model) OVER w AS next_model, m - lead(m) OVER w AS gap, sd + lead(sd) OVER w AS spread FROM s WINDOW w AS (ORDER BY m DESC, model))
SELECT model, next_model, round(gap, 6) AS gap, round(spread, 6) AS spread FROM n WHERE next_model IS NOT NULL AND gap < spread""")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = M.over_seeds(event_transfers(spark, sf_dir).withColumnRenamed("fmt", "model"), ["amount"])
    return rounded(M.indistinguishable(summary, "amount"), 6, "gap", "spread")
