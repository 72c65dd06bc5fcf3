"""Standardisation of raw transfers, over a raw table derived from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import raw as R
from ..sources.transfers import EVENT_TX, event_transfers, read
from . import serving as V
from .registry import query, rounded

_CURRENCIES = {"US Dollar": 1.0, "Euro": 1.25, "Yen": 0.0078125}
_TAIL, _FIT_END = "2024-01-28", "2024-01-20"

_RAW = f"""{EVENT_TX}, c AS (SELECT * FROM (VALUES (0, 'US Dollar', 1.0::DOUBLE), (1, 'Euro', 1.25::DOUBLE), (2, 'Yen', 0.0078125::DOUBLE)) v(k, name, unit)),
raw AS (SELECT event_id AS raw_row, date_trunc('minute', e.ts) AS ts, lpad(CAST(src % 7 AS VARCHAR), 3, '0') AS from_bank, 'A' || src AS from_account, lpad(CAST(dst % 7 AS VARCHAR), 3, '0') AS to_bank, 'A' || dst AS to_account,
  e.value + 1 AS amount_paid, p.name AS pay_currency, q.name AS recv_currency, (e.value + 1) * p.unit / q.unit * (1 + (event_id % 7) / 1000.0::DOUBLE) AS amount_received, fmt AS payment_format, label AS is_fraud
  FROM events e JOIN tx ON tx_id = event_id JOIN c p ON p.k = event_id % 3 JOIN c q ON q.k = event_id // 3 % 3),
cross_ AS (SELECT pay_currency AS currency, ln(amount_received / amount_paid) AS x, ts FROM raw WHERE pay_currency <> recv_currency AND recv_currency = 'US Dollar'
  UNION ALL SELECT recv_currency, -ln(amount_received / amount_paid), ts FROM raw WHERE pay_currency <> recv_currency AND pay_currency = 'US Dollar'),
rates AS (SELECT currency, exp(quantile_cont(x, 0.5)) AS rate FROM cross_ WHERE ts < TIMESTAMP '{_FIT_END}' GROUP BY currency UNION ALL SELECT 'US Dollar', 1.0),
std AS (SELECT 'T:' || lpad(CAST(raw_row AS VARCHAR), 7, '0') AS tx_id, from_bank || '_' || from_account AS src, to_bank || '_' || to_account AS dst, amount_paid * rate AS amount, raw.* FROM raw JOIN rates ON currency = pay_currency WHERE ts < TIMESTAMP '{_TAIL}')"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.date_format("ts", R.TIME).alias("time"))
    names = F.array(*[F.lit(n) for n in _CURRENCIES])
    units = F.array(*[F.lit(u) for u in _CURRENCIES.values()])
    pay, got = (F.col("tx_id") % 3).cast("int"), (F.floor(F.col("tx_id") / 3) % 3).cast("int")
    paid = F.col("amount") + 1
    bank = lambda c: F.lpad((F.col(c) % 7).cast("string"), 3, "0")
    account = lambda c: F.concat(F.lit("A"), F.col(c).cast("string"))
    return tx.join(times, "tx_id").select(
        F.col("tx_id").alias("raw_row"), "time", bank("src").alias("from_bank"), account("src").alias("from_account"), bank("dst").alias("to_bank"), account("dst").alias("to_account"),
        (paid * units[pay] / units[got] * (1 + (F.col("tx_id") % 7) / 1000)).alias("amount_received"), names[got].alias("recv_currency"), paid.alias("amount_paid"), names[pay].alias("pay_currency"),
        F.col("fmt").alias("payment_format"), F.col("label").cast("byte").alias("is_fraud"),
    )


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_standard(_raw(spark, sf_dir), "T", _TAIL, _FIT_END)


@query("a1_usd_rates", f"WITH {_RAW} SELECT currency, round(rate, 8) AS rate FROM rates")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).where(F.to_timestamp_ntz("time", F.lit(R.TIME)) < F.lit(_FIT_END).cast("timestamp_ntz"))
    return rounded(R.usd_rates(rows), 8, "rate")


@query("p1_standard_schema", f"""WITH {_RAW} SELECT tx_id, src, dst, round(amount, 6) AS amount, epoch_us(ts) // 1000000 AS t, from_bank AS src_bank, to_bank AS dst_bank,
CAST(src = dst AS INTEGER) AS is_self_transfer, CAST(from_bank <> to_bank AS INTEGER) AS is_cross_bank, CAST(pay_currency <> recv_currency AS INTEGER) AS is_cross_currency FROM std""")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _standard(spark, sf_dir)
    flags = [F.col(c).cast("int").alias(c) for c in ("is_self_transfer", "is_cross_bank", "is_cross_currency")]
    t = F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("t")
    return rounded(made.select("tx_id", "src", "dst", "amount", t, "src_bank", "dst_bank", *flags), 6, "amount")


@query("p4_row_features", f"""WITH {_RAW}, v AS (SELECT payment_format AS w, dense_rank() OVER (ORDER BY payment_format) - 1 AS k FROM (SELECT DISTINCT payment_format FROM std)),
cp AS (SELECT pay_currency AS w, dense_rank() OVER (ORDER BY pay_currency) - 1 AS k FROM (SELECT DISTINCT pay_currency FROM std)), cr AS (SELECT recv_currency AS w, dense_rank() OVER (ORDER BY recv_currency) - 1 AS k FROM (SELECT DISTINCT recv_currency FROM std))
SELECT tx_id, round(ln(1 + amount), 6) AS log_amount, hour(ts) AS hour, v.k AS payment_format, cp.k AS pay_currency, cr.k AS recv_currency, CAST(std.pay_currency <> std.recv_currency AS INTEGER) AS is_cross_currency,
  CAST(from_bank <> to_bank AS INTEGER) AS is_cross_bank, CAST(src = dst AS INTEGER) AS is_self_transfer, CAST(amount_paid % 100 = 0 AS INTEGER) AS is_round_amount
FROM std JOIN v ON v.w = payment_format JOIN cp ON cp.w = std.pay_currency JOIN cr ON cr.w = std.recv_currency""")
def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rounded(R.tabular_features(_standard(spark, sf_dir)), 6, "log_amount")
    return made.withColumns({c: F.col(c).cast("int") for c in ("is_cross_currency", "is_cross_bank", "is_self_transfer")})


@query("a2_load_report", f"""WITH {_RAW}, n AS (SELECT count(*) AS n_raw, sum(is_fraud) AS pos FROM raw), s AS (SELECT count(*) AS n_rows, sum(is_fraud) AS pos FROM std)
SELECT n_raw, n_rows, n_raw - n_rows AS n_dropped_tail, CAST(n.pos - s.pos AS BIGINT) AS pos_dropped_tail, CAST(s.pos AS BIGINT) AS n_pos, (SELECT count(DISTINCT a) FROM (SELECT src AS a FROM std UNION ALL SELECT dst FROM std)) AS n_accounts,
  n_raw - (SELECT count(*) FROM (SELECT DISTINCT ts, from_bank, from_account, to_bank, to_account, amount_received, recv_currency, amount_paid, pay_currency, payment_format, is_fraud FROM raw)) AS n_duplicates FROM n, s""")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir)
    return R.load_report(rows, R.to_standard(rows, "T", _TAIL, _FIT_END))


_PATTERNS = f"{_RAW}, pat AS (SELECT raw_row // 500 AS pattern_id, * FROM raw WHERE is_fraud = 1)"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir)
    patterns = R._accounts(rows.where("is_fraud = 1")).select(F.floor(F.col("raw_row") / 500).alias("pattern_id"), *R.KEY, "is_fraud")
    return R.match_patterns(_standard(spark, sf_dir), patterns, _TAIL)


@query("j1_pattern_transfers", f"WITH {_PATTERNS} SELECT pattern_id, std.tx_id FROM pat LEFT JOIN std USING (raw_row)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("pattern_id", "tx_id")


@query("a3_pattern_report", f"""WITH {_PATTERNS}, o AS (SELECT pattern_id, bool_or(std.tx_id IS NULL) AS cut, bool_and(std.tx_id IS NULL) AS gone FROM pat LEFT JOIN std USING (raw_row) GROUP BY pattern_id)
SELECT count(*) AS n_patterns, count(*) FILTER (cut AND NOT gone) AS n_truncated, count(*) FILTER (gone) AS n_in_tail FROM o""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pattern_report(_matched(spark, sf_dir))


@query("v_network_nodes", f"""WITH {EVENT_TX}, u AS (SELECT (min(t) + max(t)) // 2 AS u FROM tx), past AS (SELECT *, (tx_id * 7919) % 1000 AS score FROM tx, u WHERE t < u),
own AS (SELECT * FROM past WHERE src = 3 OR dst = 3 ORDER BY t DESC, tx_id LIMIT 200) SELECT node, max(score) AS risk FROM (SELECT src AS node, score FROM own UNION ALL SELECT dst, score FROM own) GROUP BY node""")
def v_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir).withColumn("score", (F.col("tx_id") * 7919) % 1000)
    lo, hi = tx.agg(F.min("t"), F.max("t")).first()
    return V.network(tx, 3, (lo + hi) // 2, hops=1)[1]


@query("v_disposition", f"WITH {EVENT_TX} SELECT tx_id AS alert_id, CASE WHEN tx_id = 7 THEN 'escalated' ELSE 'open' END AS status FROM tx WHERE tx_id % 7 = 0")
def v_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = event_transfers(spark, sf_dir).where("tx_id % 7 = 0").select(F.col("tx_id").alias("alert_id"), F.lit("open").alias("status"))
    return V.set_disposition(alerts, 7, "escalated")


@query("v_ring_transactions", f"""WITH {EVENT_TX}, m AS (SELECT DISTINCT tx_id % 9 AS ring_id, src AS a FROM tx WHERE tx_id % 50 = 0)
SELECT x.ring_id, count(*) AS n, CAST(sum(tx_id) AS BIGINT) AS ids FROM tx JOIN m x ON x.a = src JOIN m y ON y.a = dst AND y.ring_id = x.ring_id GROUP BY x.ring_id""")
def v_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    rings = tx.where("tx_id % 50 = 0").groupBy((F.col("tx_id") % 9).alias("ring_id")).agg(F.collect_set("src").alias("members"))
    return V.ring_transactions(rings, tx).groupBy("ring_id").agg(F.count("*").alias("n"), F.sum("tx_id").alias("ids"))
