"""Ranking metrics of scored rows.

All of them come from one table: counts of positives and negatives for each
distinct score, cumulated from the highest score down.  Rows are aggregated by
score first; the cumulation goes over ranges of scores, so no task gets more
than its range and a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .set_similarity import similar_pairs


def cumulative(scored: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score", buckets: int = 256) -> DataFrame:
    """score, tp0/fp0 (above), tp/fp (at or above), p and n (all) for each distinct score.

    Scores are cut into ``buckets`` equal ranges; totals of whole ranges above
    come from a small table.
    """
    keys = by or []
    points = scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("rows")
    ).withColumn("neg", F.col("rows") - F.col("pos"))
    span = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(buckets)
    slot = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(buckets - 1))).otherwise(F.lit(0))
    points = points.crossJoin(F.broadcast(span)).withColumn("slot", slot.cast("int")).drop("lo", "hi")
    totals = points.groupBy(*keys, "slot").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("slot"))
    whole = Window.partitionBy(*keys)
    above = higher.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(
        *keys, "slot", zero(F.sum("bp").over(above)).alias("ap"), zero(F.sum("bn").over(above)).alias("an"),
        F.sum("bp").over(whole).alias("p"), F.sum("bn").over(whole).alias("n"),
    )
    inside = Window.partitionBy(*keys, "slot").orderBy(F.desc("score"))
    return points.join(totals, [*keys, "slot"]).select(
        *keys, "score", "pos", "neg", "p", "n",
        (F.col("ap") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("an") + F.sum("neg").over(inside)).alias("fp"),
    )


def _f1(tp: Column, fp: Column, p: Column) -> Column:
    return 2 * tp / (tp + fp + p)


def evaluate(scored: DataFrame, budget: int = 500, fpr: float = 1e-3, by: list[str] | None = None) -> DataFrame:
    """The metric suite, one row a group; groups without positives are left out.

    PR-AUC is the average precision over distinct scores, ROC-AUC counts ties
    as halves.  The budget threshold is the (budget + 1)-th largest score and
    flags every row that reaches it.
    """
    keys = by or []
    points = cumulative(scored, by).where("p > 0")
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    flagged = tp + fp
    reached = flagged >= budget + 1
    low = F.col("fp") <= fpr * n
    best = F.max(F.struct(_f1(tp, fp, p).alias("f1"), F.col("score")))
    at_budget = F.coalesce(F.max(F.when(reached, F.struct("score", "tp", "fp"))), F.min(F.struct("score", "tp", "fp")))
    at_fpr = F.min(F.when(low, F.struct(F.col("score"), F.col("tp"))))
    got = points.groupBy(*keys).agg(
        F.max("p").alias("n_positive"), F.max(p + n).alias("n_rows"),
        (F.sum(F.col("pos") * tp / flagged) / F.max("p")).alias("pr_auc"),
        (F.sum(F.col("neg") * (tp - F.col("pos")) + F.col("pos") * F.col("neg") / 2) / F.max(p * n)).alias("roc_auc"),
        at_budget.alias("b"), at_fpr.alias("l"), best.alias("f"), F.max("p").alias("pp"),
    ).where("n_positive > 0")
    return got.select(
        *keys, "n_rows", "n_positive", (F.col("n_positive") / F.col("n_rows")).alias("prevalence"), "pr_auc", "roc_auc",
        F.col("b.score").alias("budget_threshold"),
        (F.col("b.tp") + F.col("b.fp")).alias("n_flagged"),
        (F.col("b.tp") / (F.col("b.tp") + F.col("b.fp"))).alias("precision_at_budget"),
        (F.col("b.tp") / F.col("pp")).alias("recall_at_budget"),
        F.coalesce(F.col("l.tp") / F.col("pp"), F.lit(0.0)).alias("recall_at_fpr"),
        F.col("f.f1").alias("max_f1"), F.col("f.score").alias("max_f1_threshold"),
    )


def early_warning(events: DataFrame, rings: DataFrame, tau: float, from_start: bool = False) -> DataFrame:
    """ring_id and minutes between the first alert on a member and the ring's end; null if none.

    ``events``: account, t, score.  ``rings``: ring_id, members, t_start, t_end
    in seconds.  As published, alerts before the ring's start count;
    ``from_start`` leaves them out.
    """
    members = rings.select("ring_id", "t_start", "t_end", F.explode(F.array_distinct("members")).alias("account"))
    fits = F.col("t") <= F.col("t_end")
    if from_start:
        fits = fits & (F.col("t") >= F.col("t_start"))
    hits = members.join(events.where(F.col("score") >= tau), "account").where(fits).groupBy("ring_id").agg(F.min("t").alias("first_t"))
    return rings.join(hits, "ring_id", "left").select("ring_id", ((F.col("t_end") - F.col("first_t")) / 60.0).alias("ewt_minutes"))


def summarise_early_warning(ewt: DataFrame) -> DataFrame:
    """Detection rate, median and quartiles over detected rings, and the censored rest."""
    q = lambda p: F.percentile("ewt_minutes", F.lit(p))
    seen = F.count("ewt_minutes")
    return ewt.agg(
        (seen / F.greatest(F.count("*"), F.lit(1))).alias("detection_rate"), q(0.5).alias("median_ewt_minutes"),
        q(0.25).alias("iqr_low"), q(0.75).alias("iqr_high"),
        F.when(seen == 0, F.greatest(F.count("*"), F.lit(1))).otherwise(F.count("*") - seen).cast("double").alias("n_censored"),
    )


def jaccard_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """pid, tid, jaccard for every predicted and true member set that share a member."""
    # Sizes are counted over the exploded rows: a generator beside an array would work through the array once a member.
    left, right = (sets.select(key, F.explode("members").alias("m")).distinct() for sets, key in ((predicted, "pid"), (truth, "tid")))
    shared = left.join(right, "m").groupBy("pid", "tid").agg(F.count("*").alias("common"))
    sized = shared.join(left.groupBy("pid").agg(F.count("*").alias("np")), "pid").join(right.groupBy("tid").agg(F.count("*").alias("nt")), "tid")
    return sized.select("pid", "tid", (F.col("common") / (F.col("np") + F.col("nt") - F.col("common"))).alias("jaccard"))


def ring_metrics(predicted: DataFrame, truth: DataFrame, thetas: tuple[float, ...] = (0.3, 0.5, 0.7), max_rounds: int = 1000) -> DataFrame:
    """Ring precision and recall under greedy one-to-one matching, for each theta.

    Greedy by (jaccard, pid, tid) descending equals taking, round by round,
    every pair that is the best one left of both its sides; a round is two
    grouped maxima, so sides never meet in one task.
    """
    pairs = similar_pairs(predicted, truth, min(thetas))
    np_, nt = predicted.count(), truth.count()
    members = lambda df, name: df.select(F.explode("members").alias("m")).distinct().withColumn(name, F.lit(1))
    both = members(predicted, "a").join(members(truth, "b"), "m", "full").agg(
        F.sum(F.col("a") * F.col("b")).alias("hit"), F.sum("a").alias("a"), F.sum("b").alias("b")
    ).first()
    rows = []
    for theta in thetas:
        left, matched, total = materialize(pairs.where(F.col("jaccard") >= theta), "ring-pairs"), 0, 0.0
        for _ in range(max_rounds):
            key = F.struct("jaccard", "pid", "tid")
            best_p = left.groupBy("pid").agg(F.max(key).alias("k")).select("k")
            best_t = left.groupBy("tid").agg(F.max(key).alias("k")).select("k")
            taken = materialize(best_p.join(best_t, "k").select("k.*"), "ring-taken")
            n, s = taken.agg(F.count("*"), F.coalesce(F.sum("jaccard"), F.lit(0.0))).first()
            if not n:
                break
            matched, total = matched + n, total + s
            left = materialize(left.join(taken.select("pid"), "pid", "left_anti").join(taken.select("tid"), "tid", "left_anti"), "ring-pairs")
        else:
            raise RuntimeError(f"matching did not settle in {max_rounds} rounds")
        hit, a, b = ((both[k] or 0) for k in ("hit", "a", "b"))
        rows.append((theta, matched / max(np_, 1), matched / max(nt, 1), total / matched if matched else 0.0, hit / max(a, 1), hit / max(b, 1)))
    schema = "theta double, ring_precision double, ring_recall double, mean_jaccard double, member_precision double, member_recall double"
    return predicted.sparkSession.createDataFrame(rows, schema)


def over_seeds(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric by model."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return results.groupBy("model").agg(F.count("*").alias("n_seeds"), *aggs)


def indistinguishable(summary: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Neighbours in the ranking whose gap is below the sum of their deviations (a row a model: small)."""
    order = Window.orderBy(F.desc(f"{metric}_mean"), "model")
    nxt = lambda c: F.lead(c).over(order)
    pairs = summary.select(
        "model", nxt("model").alias("next_model"), (F.col(f"{metric}_mean") - nxt(f"{metric}_mean")).alias("gap"),
        (F.coalesce(f"{metric}_std", F.lit(0.0)) + F.coalesce(nxt(f"{metric}_std"), F.lit(0.0))).alias("spread"),
    )
    return pairs.where("next_model is not null and gap < spread")


def bucket_counts(tx: DataFrame, seconds: int) -> DataFrame:
    """bucket_start and the transfers in each span of ``seconds``, empty ones between the first and the last included."""
    placed = tx.select(F.floor(F.col("t") / seconds).alias("b"))
    grid = placed.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("b"))
    return grid.join(placed.groupBy("b").count(), "b", "left").select((F.col("b") * seconds).alias("bucket_start"), F.coalesce("count", F.lit(0)).alias("n"))
