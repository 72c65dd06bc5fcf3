"""Adaptation, explanation, experiment and checking operators over the event transfers."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import adaptation as A
from ..operators import experiment as X
from ..operators import explain, metrics
from ..operators import rings as R
from ..operators import scoring as C
from ..operators import splits as S
from ..session import materialize
from ..sources import raw
from ..sources.transfers import EVENT_TX, event_transfers
from .registry import query, rounded

_DAY = 86400
_FEATURES = ["log_amount", "hour", "same_fifth"]


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers with three row features and a label that leans on the amount."""
    tx = event_transfers(spark, sf_dir)
    return materialize(
        tx.select(
            "tx_id", "t", "src", "dst", "amount", "fmt", F.log1p("amount").alias("log_amount"), (F.col("t") % _DAY / 3600).alias("hour"),
            (F.col("src") % 5 == F.col("dst") % 5).cast("double").alias("same_fifth"), F.when(F.col("amount") > 100, 1).otherwise(F.col("label")).alias("label"),
        ),
        "plain",
    )


def _logistic() -> C.MlScorer:
    return C.MlScorer("logistic", _FEATURES)


def _start(df: DataFrame) -> int:
    return df.agg(F.min("t")).first()[0] // _DAY * _DAY


@query("d10_policies")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy does at one moment."""
    df = _plain(spark, sf_dir)
    now = _start(df) + 20 * _DAY
    model = A.fit_chronological(_logistic, df.where(F.col("t") < now - 5 * _DAY), now - 5 * _DAY).model
    recent = materialize(model.score(df.where((F.col("t") >= now - 5 * _DAY) & (F.col("t") < now))), "recent")
    moment = A.Moment(now, df.where(F.col("t") < now), recent.drop("label"), 0.5, 0.05, _logistic)
    rows = []
    for name, policy in {"static": A.static(), "recalibrate": A.recalibrate(), "retrain_recent": A.retrain(7 * _DAY), "retrain_all": A.retrain()}.items():
        made = policy(moment)
        rows.append((name, made.action, made.threshold, made.fit.rows if made.fit else 0, made.fit.positives if made.fit else 0))
    return spark.createDataFrame(rows, "policy string, action string, threshold double, n_train long, n_train_pos long")


@query("d11_walk_forward")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _plain(spark, sf_dir)
    walk = A.walk_forward(df, _FEATURES, _logistic, _start(df) + 15 * _DAY, 5 * _DAY, A.Level(0.0), A.retrain(7 * _DAY), 0.05, embargo=_DAY)
    return spark.createDataFrame(walk.records, A.RECORD)


_WINDOWS = f"""{EVENT_TX}, w AS (SELECT (t // 86400 + 1) * 86400 AS "end", avg(amount) / 1000 AS static_pr_auc, avg(amount) / 900 AS adaptive_pr_auc, count(*) % 5 = 0 AS alarm FROM tx GROUP BY ALL),
o AS (SELECT (min(t) + max(t)) // 2 // 86400 * 86400 AS onset FROM tx)"""


@query("d12_accounting", f"""WITH {_WINDOWS}, b AS (SELECT avg(static_pr_auc) FILTER ("end" <= onset) AS base, min("end") FILTER ("end" > onset AND alarm) AS hit, count(*) FILTER ("end" <= onset AND alarm) AS fa FROM w, o)
SELECT round(any_value(base), 6) AS baseline_pr_auc, any_value(hit) AS detected_at, any_value(fa) AS false_alarms, round(sum(base - adaptive_pr_auc) FILTER (hit IS NULL OR "end" <= hit), 6) AS lost_to_detection,
  round(sum(base - static_pr_auc), 6) AS lost_static, round(sum(base - adaptive_pr_auc), 6) AS lost_adaptive, round(avg(static_pr_auc), 6) AS mean_static, round(avg(adaptive_pr_auc), 6) AS mean_adaptive,
  round((any_value(hit) - any_value(onset)) / 3600.0::DOUBLE, 6) AS latency_hours FROM w, o, b WHERE "end" > onset""")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    windows = tx.groupBy(((F.floor(F.col("t") / _DAY) + 1) * _DAY).alias("end")).agg(
        (F.avg("amount") / 1000).alias("static_pr_auc"), (F.avg("amount") / 900).alias("adaptive_pr_auc"), (F.count("*") % 5 == 0).alias("alarm")
    )
    lo, hi = tx.agg(F.min("t"), F.max("t")).first()
    out = A.accounting(windows, (lo + hi) // 2 // _DAY * _DAY)
    return rounded(out, 6, *[c for c in out.columns if c not in ("detected_at", "false_alarms")])


@query("m14_tree_contributions")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir)


def contributions(spark: SparkSession, sf_dir: str, shown: Column | None = None) -> DataFrame:
    """Contributions of boosted trees, fitted on all transfers, to each of the transfers ``shown`` (all)."""
    rows = VectorAssembler(inputCols=_FEATURES, outputCol="x").transform(_plain(spark, sf_dir))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=20, maxDepth=4, seed=0).fit(rows)
    return explain.tree_contributions(model, rows if shown is None else rows.where(shown), _FEATURES, "x")


@query("m11_stacker")
def m11_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.temporal_split(_plain(spark, sf_dir)).withColumns({"a": F.least(F.lit(1.0), F.col("amount") / 500), "b": F.col("hour") / 24, "c": (F.col("tx_id") * 7919) % 1000 / F.lit(1000.0)})
    return C.stack(df, ["a", "b", "c"])[0].where("fold = 'test'").select("tx_id", "score")


@query("m13_ring_fallback", f"WITH {EVENT_TX} SELECT tx_id % 4 AS ring_id, round(avg(amount), 6) AS score FROM tx GROUP BY tx_id % 4")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = event_transfers(spark, sf_dir).groupBy((F.col("tx_id") % 4).alias("ring_id")).agg(F.avg("amount").alias("mean_score"), F.max("label").alias("y"))
    return rounded(C.RingScorer(["mean_score"]).fit(rings).score(rings).select("ring_id", "score"), 6, "score")


@query("m15_edge_inputs", f"""WITH {EVENT_TX}, v AS (SELECT tx_id, sign(amount - 50) * ln(1 + abs(amount - 50)) AS a, CASE WHEN tx_id % 4 <> 0 THEN ln(1 + amount) END AS b FROM tx),
s AS (SELECT avg(a) AS ma, stddev_pop(a) + 1e-6 AS sa, avg(b) AS mb, stddev_pop(b) + 1e-6 AS sb FROM v WHERE tx_id % 2 = 0)
SELECT tx_id, round(greatest(-10, least(10, (a - ma) / sa)), 5) AS e_a, round(greatest(-10, least(10, (coalesce(b, mb) - mb) / sb)), 5) AS e_b, CAST(b IS NULL AS DOUBLE) AS missing_b FROM v, s""")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir).select("tx_id", (F.col("amount") - 50).alias("a"), F.when(F.col("tx_id") % 4 != 0, F.col("amount")).alias("b"))
    made = C.EdgeInputs(["a", "b"]).fit(tx.where("tx_id % 2 = 0")).transform(tx)
    return rounded(made.select("tx_id", "e_a", "e_b", "missing_b"), 5, "e_a", "e_b")


@query("m16_ablation")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = materialize(S.temporal_split(_plain(spark, sf_dir)), "ablation")
    train, test = (split.where(F.col("fold") == f) for f in ("train", "test"))

    def fit_score(columns: list[str]) -> DataFrame:
        return C.MlScorer("logistic", columns).fit(train).score(test).select(F.col("label").alias("y"), "score")

    return X.ablate({"amount": ["log_amount"], "time": ["hour"], "banks": ["same_fifth"]}, fit_score, budget=50)


@query("x7_runs_over_seeds")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = X.prepare(_plain(spark, sf_dir), lambda tx: tx)

    def fit_score(rows: DataFrame, seed: int) -> DataFrame:
        noise = F.pmod(F.xxhash64(F.lit(seed), "tx_id"), F.lit(1000)) / 5000.0
        return rows.where("fold <> 'train'").select("tx_id", "fold", F.col("label").alias("y"), (F.col("amount") / 500 + noise).alias("score"))

    return X.format_table(X.run_experiment("amount with noise", fit_score, split, X.Settings(budget=50, seeds=(0, 1, 2))))


@query("x8_summary", f"""WITH {EVENT_TX}, r AS (SELECT fmt AS model, 'test' AS fold, tx_id % 5 AS seed, avg(amount) / 1000 AS m FROM tx GROUP BY ALL)
SELECT model, fold, count(*) AS n_seeds, round(avg(m), 6) AS pr_auc_mean, round(stddev_pop(m), 6) AS pr_auc_std FROM r GROUP BY model, fold""")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    runs = tx.groupBy(F.col("fmt").alias("model"), F.lit("test").alias("fold"), (F.col("tx_id") % 5).alias("seed")).agg((F.avg("amount") / 1000).alias("pr_auc"))
    made = X.summary(runs.withColumns({m: F.lit(0.0) for m in X.METRICS if m != "pr_auc"}))
    return rounded(made.select("model", "fold", "n_seeds", "pr_auc_mean", "pr_auc_std"), 6, "pr_auc_mean", "pr_auc_std")


@query("x11_best_trial", f"""WITH {EVENT_TX} SELECT model, trial, val_pr_auc FROM (SELECT fmt AS model, tx_id AS trial, amount AS val_pr_auc, row_number() OVER (PARTITION BY fmt ORDER BY amount DESC, tx_id) AS k FROM tx) WHERE k = 1""")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = event_transfers(spark, sf_dir).select(F.col("fmt").alias("model"), F.col("tx_id").alias("trial"), F.col("amount").alias("val_pr_auc"))
    return X.best_on_validation(logs)


@query("t6_leakage_canary")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.leakage_canary(lambda train, test: _logistic().fit(train).score(test), _plain(spark, sf_dir))
    return spark.createDataFrame([(found["observed"], found["chance"], found["ratio"])], "observed double, chance double, ratio double")


@query("t6_permuted_counts", f"WITH {EVENT_TX} SELECT label, count(*) AS n, count(DISTINCT tx_id) AS n_ids FROM tx GROUP BY label")
def t6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = S.permuted_labels(event_transfers(spark, sf_dir), 3)
    return dealt.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("tx_id").alias("n_ids"))


@query("t7_checked_edges", f"WITH {EVENT_TX}, c AS (SELECT (min(t) + max(t)) // 2 AS c FROM tx) SELECT src, dst, max(t) AS last_t FROM tx, c WHERE t < c GROUP BY src, dst")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import account_graph

    tx = event_transfers(spark, sf_dir)
    lo, hi = tx.agg(F.min("t"), F.max("t")).first()
    return S.assert_no_future_edges(account_graph(tx, (lo + hi) // 2), (lo + hi) // 2).select("src", "dst", "last_t")


@query("p11_out_of_order", f"""WITH {EVENT_TX}, late AS (SELECT tx_id, t - CASE WHEN tx_id % 13 = 0 THEN 9000 ELSE 0 END AS t FROM tx)
SELECT tx_id FROM (SELECT tx_id, t, max(t) OVER (ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM late) WHERE t < top""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = event_transfers(spark, sf_dir).withColumn("t", F.col("t") - F.when(F.col("tx_id") % 13 == 0, 9000).otherwise(0))
    return raw.out_of_order(late, "tx_id", "t").select("tx_id")


@query("p13_feature_labels")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*fn.FIXED, *[f"{s}_{k}_24h" for s in fn.STREAMS for k in ("cnt", "sum")], *[f"{s}_{n}" for s in ("src", "dst") for n in fn.NODES], "some_thing"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", fn.feature_label(F.col("name")).alias("label"))


@query("a31_minute_counts", f"""WITH {EVENT_TX}, m AS (SELECT unnest(range(CAST((SELECT min(t) // 60 FROM tx) AS BIGINT), CAST((SELECT max(t) // 60 + 1 FROM tx) AS BIGINT))) AS m), c AS (SELECT t // 60 AS m, count(*) AS n FROM tx GROUP BY ALL)
SELECT m * 60 AS minute_start, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (m)""")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucket_counts(event_transfers(spark, sf_dir), 60).withColumnRenamed("bucket_start", "minute_start")


_RINGS = """p AS (SELECT *, tx_id % 30 AS pattern_id FROM tx WHERE label = 1), win AS (SELECT (min(t) + max(t)) // 2 AS w FROM tx),
mem AS (SELECT pattern_id, src AS a, tx_id FROM p, win WHERE t < w UNION ALL SELECT pattern_id, dst, tx_id FROM p, win WHERE t < w)"""


@query("r2_truth_rings", f"""WITH {EVENT_TX}, {_RINGS}, s AS (SELECT pattern_id, min(t) AS t_start, max(t) AS t_end FROM p GROUP BY pattern_id)
SELECT printf('P-%04d', CAST(pattern_id AS INTEGER)) AS ring_id, count(DISTINCT a) AS n_members, CAST(sum(DISTINCT a) AS BIGINT) AS members_sum, count(DISTINCT tx_id) AS n_tx_in_window, any_value(t_start) AS t_start, any_value(t_end) AS t_end
FROM mem JOIN s USING (pattern_id) GROUP BY pattern_id""")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _truth(spark, sf_dir)
    total = F.aggregate("members", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return made.select("ring_id", F.size("members").cast("long").alias("n_members"), total.alias("members_sum"), "n_tx_in_window", "t_start", "t_end")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    lo, hi = tx.agg(F.min("t"), F.max("t")).first()
    patterns = tx.where("label = 1").select((F.col("tx_id") % 30).alias("pattern_id"), F.col("fmt").alias("typology"), "tx_id", "t")
    return R.truth_rings(patterns, tx, tx.where(F.col("t") < (lo + hi) // 2))


@query("r3_candidate_labels", f"""WITH {EVENT_TX}, {_RINGS}, tm AS (SELECT DISTINCT pattern_id AS tid, a FROM mem), rm AS (SELECT DISTINCT tx_id % 60 AS rid, src AS a FROM tx WHERE label = 1),
nt AS (SELECT tid, count(*) AS n FROM tm GROUP BY tid), nr AS (SELECT rid, count(*) AS n FROM rm GROUP BY rid),
j AS (SELECT rid, count(*) / CAST(any_value(nr.n) + any_value(nt.n) - count(*) AS DOUBLE) AS j FROM rm JOIN tm USING (a) JOIN nr USING (rid) JOIN nt USING (tid) GROUP BY rid, tid)
SELECT nr.rid AS ring_id, CAST(coalesce(max(j), 0) >= 0.1 AS INTEGER) AS y FROM nr LEFT JOIN j USING (rid) GROUP BY nr.rid""")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = event_transfers(spark, sf_dir).where("label = 1").groupBy((F.col("tx_id") % 60).alias("ring_id")).agg(F.collect_set("src").alias("members"))
    return R.label_candidates(rings, _truth(spark, sf_dir), 0.1)


@query("r6_rings_of_alerts", f"""WITH {EVENT_TX}, c AS (SELECT max(t) // 86400 * 86400 AS c FROM tx), past AS (SELECT tx.* FROM tx, c WHERE t < c AND t >= c - 96 * 3600),
m AS (SELECT tx_id % 20 AS ring_id, src AS a FROM past WHERE tx_id % 10 = 0), g AS (SELECT tx_id % 20 AS ring_id, max(tx_id) AS score FROM past WHERE tx_id % 10 = 0 GROUP BY ALL),
b AS (SELECT a, arg_max(m.ring_id, struct_pack(s := score, r := m.ring_id)) AS ring_id FROM m JOIN g USING (ring_id) GROUP BY a)
SELECT tx_id, coalesce(x.ring_id, y.ring_id) AS ring_id FROM tx JOIN c ON t >= c LEFT JOIN b x ON x.a = src LEFT JOIN b y ON y.a = dst""")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    cut = tx.agg(F.max("t")).first()[0] // _DAY * _DAY
    past = R.recent_transfers(tx, cut).where("tx_id % 10 = 0")
    rings = past.groupBy((F.col("tx_id") % 20).alias("ring_id")).agg(F.collect_set("src").alias("members"), F.max("tx_id").alias("score"))
    return R.rings_of_alerts(tx.where(F.col("t") >= cut), rings).select("tx_id", "ring_id")
