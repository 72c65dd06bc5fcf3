"""Scorers: rules, Spark ML models, isolation forest, fusion, calibration, tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logit, sigmoid, signed_log
from ..session import materialize
from .forest import Forest
from .forest import Params as ForestParams
from .metrics import cumulative
from .quantiles import exact_quantiles

RULES = ("large_amount", "far_above_own_history", "burst_1h", "fan_in_24h", "pass_through_1h", "new_cross_bank_counterparty", "cross_currency")


def fit_rules(train: DataFrame, quantile: float = 0.99) -> dict[str, float]:
    """Thresholds from the training rows, without labels."""
    of = {"large_amount": "log_amount", "burst_1h": "src_out_cnt_1h", "fan_in_24h": "dst_in_cnt_24h"}
    long = train.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("g"), F.col(c).cast("double").alias("x")) for rule, c in of.items()])))
    found = exact_quantiles(long, [quantile])
    return {rule: found[rule][0] if rule in found else None for rule in of}


def rule_hits(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Boolean columns of the rules, rule_hits (names) and the score: hits, ties broken by amount."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "large_amount": F.col("log_amount") > limits["large_amount"],
        "far_above_own_history": F.col("amt_z_src") > 3,
        "burst_1h": F.col("src_out_cnt_1h") > limits["burst_1h"],
        "fan_in_24h": F.col("dst_in_cnt_24h") > limits["fan_in_24h"],
        "pass_through_1h": (F.col("src_secs_since_in") <= 3600) & F.col("amt_over_src_in_24h").between(0.5, 1.5),
        "new_cross_bank_counterparty": (F.col("counterparty_is_new") == 1) & (F.col("is_cross_bank") == 1),
        "cross_currency": F.col("is_cross_currency") == 1,
    }
    out = df.withColumns({f"rule_{n}": yes(c) for n, c in rules.items()})
    names = F.array_compact(F.array(*[F.when(F.col(f"rule_{n}"), n) for n in rules]))
    return out.withColumn("rule_hits", names).withColumn("rule_score", F.size("rule_hits") + 1e-3 * F.col("log_amount") / 30)


def random_scores(df: DataFrame, seed: int = 0) -> DataFrame:
    """tx_id and a score in [0, 1) that depends on id and seed alone: the floor for every ranking."""
    mixed = F.pmod(F.col("tx_id").cast("long") * 2_654_435_761 + seed * 40_503, F.lit(1 << 32))
    return df.select("tx_id", (mixed / float(1 << 32)).alias("score"))


def join_scores(df: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """``df`` with a column for each model's scores (tx_id, score); rows that a model left out are left out."""
    for name, scored in scores.items():
        df = df.join(scored.select("tx_id", F.col("score").alias(name)), "tx_id")
    return df


def _balanced(train: DataFrame, label: str) -> DataFrame:
    pos, n = train.agg(F.sum(label), F.count("*")).first()
    weight = F.when(F.col(label) == 1, n / (2.0 * max(pos or 0, 1))).otherwise(n / (2.0 * max(n - (pos or 0), 1)))
    return train.withColumn("__weight", weight)


def _prepared(features: list[str], scale: bool) -> list:
    stages = [Imputer(strategy="median", inputCols=[f"__v_{f}" for f in features], outputCols=[f"__i_{f}" for f in features]), VectorAssembler(inputCols=[*[f"__i_{f}" for f in features], *[f"__m_{f}" for f in features]], outputCol="__x")]
    return [*stages, StandardScaler(inputCol="__x", outputCol="__features", withMean=True)] if scale else stages


def _inputs(df: DataFrame, features: list[str], log: bool) -> DataFrame:
    """``df`` with its features as doubles (__v_) and flags of missing ones (__m_)."""
    value = lambda f: signed_log(F.col(f).cast("double")) if log else F.col(f).cast("double")
    return df.withColumns({f"__m_{f}": F.col(f).isNull().cast("double") for f in features} | {f"__v_{f}": value(f) for f in features})


class MlScorer:
    """A Spark ML classifier, or a forest over counted cells, on behavioural columns: imputed by the median, with missing flags."""

    def __init__(self, kind: str, features: list[str], label: str = "label", seed: int = 0, **params: object):
        self.kind, self.features, self.label, self.seed, self.params = kind, features, label, seed, params

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> MlScorer:
        """Fit on ``train``; boosting stops early on the loss of ``val``."""
        if self.kind == "forest":
            own = {"numTrees": 300, "maxDepth": 10, "subsamplingRate": 0.8} | self.params
            self.model = Forest(self.features, self.label, ForestParams(own["numTrees"], own["maxDepth"], own["subsamplingRate"], self.seed)).fit(train)
            return self
        common = {"labelCol": self.label, "weightCol": "__weight"}
        linear = self.kind == "logistic"
        column = "__features" if linear else "__x"
        own = [*[f"__v_{f}" for f in self.features], *[f"__m_{f}" for f in self.features], self.label]
        made = _inputs(train, self.features, linear).select(*own)
        made = materialize(made, "scorer-rows")  # every stage and step of the fit reads them
        rows = _balanced(made, self.label).withColumn("__val", F.lit(False))
        if self.kind == "boosting" and val is not None:
            rows = rows.unionByName(_inputs(val, self.features, linear).select(*own).withColumns({"__weight": F.lit(1.0), "__val": F.lit(True)}))
            common["validationIndicatorCol"] = "__val"
        model = {
            "logistic": lambda: LogisticRegression(featuresCol=column, **common, **({"regParam": 0.01} | self.params)),
            "boosting": lambda: GBTClassifier(featuresCol=column, seed=self.seed, **common, **({"maxIter": 100, "maxDepth": 5, "stepSize": 0.1} | self.params)),
        }[self.kind]()
        self.model = Pipeline(stages=[*_prepared(self.features, linear), model]).fit(rows)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score, the probability of label 1."""
        if self.kind == "forest":
            return self.model.score(df)
        out = self.model.transform(_inputs(df, self.features, self.kind == "logistic"))
        return out.select(*[c for c in df.columns if c != "score"], vector_to_array("probability")[1].alias("score"))


def random_search(train: DataFrame, val: DataFrame, make: Callable[[dict], MlScorer], space: dict[str, list], trials: int, seed: int = 0) -> tuple[dict, list[tuple[dict, float]]]:
    """Best parameters by validation PR-AUC among random ones, and the log of trials."""
    rng = np.random.default_rng(seed)
    log = []
    for _ in range(trials):
        params = {k: v[int(rng.integers(len(v)))] for k, v in space.items()}
        scored = make(params).fit(train, val).score(val)
        log.append((params, average_precision(scored.select(F.col("label").alias("y"), "score"))))
    return max(log, key=lambda x: x[1])[0], log


def average_precision(scored: DataFrame) -> float:
    points = cumulative(scored)
    return points.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("p")).first()[0]


def subsample_negatives(df: DataFrame, rate: float, seed: int, label: str = "label") -> DataFrame:
    """All positives and a hashed share of the others."""
    return df.where((F.col(label) == 1) | (F.pmod(F.xxhash64(F.lit(seed), "tx_id"), F.lit(1_000_000)) < int(rate * 1_000_000)))


def isolation_forest(train: DataFrame, df: DataFrame, features: list[str], trees: int = 300, sample: int = 256, seed: int = 0) -> DataFrame:
    """tx_id, score: isolation depth turned into an anomaly score.

    A tree sees ``sample`` rows by design; each gets its own hashed sample, so
    training reads the data once and collects trees * sample small rows.
    """
    n = max(train.count(), 1)
    rows = train.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], "tx_id")
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "tx_id"), F.lit(n)) < trees * sample * 2).orderBy(F.xxhash64(F.lit(seed), "tx_id")).limit(trees * sample)
    data = picked.drop("tx_id").toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    own = min(sample, len(data))
    depth = int(np.ceil(np.log2(max(own, 2))))
    euler = 0.5772156649
    path = lambda m: 0.0 if m <= 1 else 2.0 * (np.log(m - 1) + euler) - 2.0 * (m - 1) / m

    def grow(x: np.ndarray, level: int) -> tuple:
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
        if level >= depth or len(x) <= 1 or not len(spread):
            return (level + path(len(x)),)
        j = int(rng.choice(spread))
        cut = rng.uniform(x[:, j].min(), x[:, j].max())
        return j, cut, grow(x[x[:, j] < cut], level + 1), grow(x[x[:, j] >= cut], level + 1)

    forest = [grow(data[rng.choice(len(data), own, replace=False)], 0) for _ in range(trees)] if len(data) else []
    scale = path(own) or 1.0

    def descend(tree: tuple, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if len(tree) == 1:
            out[rows] += tree[0]
            return
        left = x[rows, tree[0]] < tree[1]
        descend(tree[2], x, rows[left], out)
        descend(tree[3], x, rows[~left], out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].fillna(0.0).to_numpy(float)
            total = np.zeros(len(x))
            for tree in forest:
                descend(tree, x, np.arange(len(x)), total)
            yield pd.DataFrame({"tx_id": batch["tx_id"], "score": 2.0 ** (-total / max(len(forest), 1) / scale)})

    return df.select("tx_id", *[F.col(f).cast("double") for f in features]).mapInPandas(run, f"tx_id {dict(df.dtypes)['tx_id']}, score double")


def _weight_bounds(grid: DataFrame, bins: int) -> DataFrame:
    """w, low and high: between which the average precision of each weight lies, from counts of bins of scores.

    The positives of a bin gain most where its negatives come after them, and
    least where they come before and all but one of the positives after it.
    """
    span = grid.groupBy("w").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    slot = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = grid.join(F.broadcast(span), "w").groupBy("w", slot.cast("int").alias("slot")).agg(F.sum("label").alias("pos"), F.count("*").alias("rows"))
    higher = Window.partitionBy("w").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    before = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0))
    placed = counts.select("w", "pos", "rows", before("pos").alias("tp"), before("rows").alias("above"))
    most = F.col("pos") * (F.col("tp") + F.col("pos")) / (F.col("above") + F.col("pos"))
    least = F.col("pos") * (F.col("tp") + 1) / (F.col("above") + F.col("rows") - F.col("pos") + 1)
    total = lambda c: F.try_divide(F.sum(F.when(F.col("pos") > 0, c)), F.sum("pos"))
    return placed.groupBy("w").agg(total(least).alias("low"), total(most).alias("high"))


def fuse(scores: DataFrame, a: str, b: str, val: str = "val", steps: int = 21, bins: int = 1 << 15) -> tuple[DataFrame, float]:
    """Two models' standardised logits mixed by the weight with the best validation PR-AUC.

    ``scores``: tx_id, fold, label and the two score columns.  All weights are
    bounded in one pass over the validation fold, from counts of ``bins`` bins
    of scores; the exact figure is worked out for the weights that may be best.
    """
    z = scores.withColumns({"za": logit(F.col(a)), "zb": logit(F.col(b))})
    m = z.where(F.col("fold") == val).agg(*[f(c).alias(f"{n}_{c}") for c in ("za", "zb") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    for c in ("za", "zb"):
        z = z.withColumn(c, (F.col(c) - m[f"m_{c}"]) / max(m[f"s_{c}"] or 0.0, 1e-9))
    held = materialize(z.where(F.col("fold") == val).select(F.col("label").cast("long").alias("label"), "za", "zb"), "fusion-validation")

    def mixed(weights: list[float]) -> DataFrame:
        w = F.explode(F.array(*[F.lit(w) for w in weights])).alias("w")
        return held.select("label", "za", "zb", w).select("w", "label", (F.col("w") * F.col("za") + (1 - F.col("w")) * F.col("zb")).alias("score"))

    bounds = _weight_bounds(mixed([i / (steps - 1) for i in range(steps)]), bins).collect()  # a row a weight
    least = max((r["low"] for r in bounds if r["low"] is not None), default=None)  # None: no positives
    left = sorted(r["w"] for r in bounds if least is not None and r["high"] >= least - 1e-9)
    if len(left) > 1:
        points = cumulative(mixed(left).withColumnRenamed("label", "y"), ["w"])
        best = points.groupBy("w").agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("p")).alias("ap")).orderBy(F.desc("ap"), "w").first()["w"]
    else:
        best = left[0] if left else 0.0
    return z.withColumn("score", sigmoid(best * F.col("za") + (1 - best) * F.col("zb"))), best


def stack(scores: DataFrame, names: list[str], val: str = "val") -> tuple[DataFrame, dict[str, float]]:
    """More than two models: a logistic regression on their standardised logits, fitted on the validation fold.

    The score is the sigmoid of the weighted logits without the intercept: a
    monotone map, so the ranking is the regression's.
    """
    z = scores.withColumns({f"__z_{n}": logit(F.col(n)) for n in names})
    m = z.where(F.col("fold") == val).agg(*[f(f"__z_{n}").alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = z.withColumns({f"__z_{n}": (F.col(f"__z_{n}") - m[f"m_{n}"]) / ((m[f"s_{n}"] or 0.0) + 1e-9) for n in names})
    x = VectorAssembler(inputCols=[f"__z_{n}" for n in names], outputCol="__x")
    fitted = LogisticRegression(featuresCol="__x", labelCol="label").fit(x.transform(z.where(F.col("fold") == val)))
    weights = dict(zip(names, map(float, fitted.coefficients), strict=True))
    total = sum((F.lit(w) * F.col(f"__z_{n}") for n, w in weights.items()), F.lit(0.0))
    return z.withColumn("score", sigmoid(total)).drop(*[f"__z_{n}" for n in names]), weights


class RingScorer:
    """Second stage for rings: a balanced logistic regression on candidate features, or else their mean score.

    Fewer than ``least`` labelled rings, or rings of one label only, leave the
    mean score of the members as the score.
    """

    def __init__(self, features: list[str], least: int = 5):
        self.features, self.least, self.model, self.weights = features, least, None, {}

    def fit(self, rings: DataFrame) -> RingScorer:
        """``rings``: the features and y."""
        n, low, high = rings.agg(F.count("*"), F.min("y"), F.max("y")).first()
        if n < self.least or low == high:
            return self
        stages = [VectorAssembler(inputCols=self.features, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__s", withMean=True)]
        regression = LogisticRegression(featuresCol="__s", labelCol="y", weightCol="__weight", regParam=1.0 / n)
        self.model = Pipeline(stages=[*stages, regression]).fit(_balanced(rings, "y"))
        self.weights = dict(zip(self.features, map(float, self.model.stages[-1].coefficients), strict=True))
        return self

    def score(self, rings: DataFrame) -> DataFrame:
        if self.model is None:
            return rings.withColumn("score", F.col("mean_score").cast("double"))
        out = self.model.transform(rings).withColumn("score", vector_to_array("probability")[1])
        return out.select(*[c for c in rings.columns if c != "score"], "score")


class EdgeInputs:
    """Edge features for a network: signed logs, standardised by training rows, within -10 to 10, with missing flags.

    Missing values get the training mean, which is zero once standardised;
    flags exist for the columns that miss values in training.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def fit(self, train: DataFrame) -> EdgeInputs:
        value = {c: F.nanvl(signed_log(F.col(c).cast("double")), F.lit(None).cast("double")) for c in self.columns}
        stats = [f(v).alias(f"{k}_{c}") for c, v in value.items() for k, f in (("m", F.avg), ("s", F.stddev_pop), ("n", lambda v: F.count_if(v.isNull())))]
        found = train.agg(*stats).first()
        self.mean = {c: found[f"m_{c}"] or 0.0 for c in self.columns}
        self.std = {c: (found[f"s_{c}"] or 0.0) + 1e-6 for c in self.columns}
        self.flagged = [c for c in self.columns if found[f"n_{c}"]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with e_<column> and missing_<column>."""
        value = {c: F.nanvl(signed_log(F.col(c).cast("double")), F.lit(None).cast("double")) for c in self.columns}
        z = {f"e_{c}": F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.coalesce(v, F.lit(self.mean[c])) - self.mean[c]) / self.std[c])) for c, v in value.items()}
        return df.withColumns(z | {f"missing_{c}": value[c].isNull().cast("double") for c in self.flagged})


def platt(val: DataFrame, df: DataFrame, label: str = "label") -> DataFrame:
    """Scores calibrated by a logistic fit on the validation logits."""
    x = VectorAssembler(inputCols=["__z"], outputCol="__x")
    model = LogisticRegression(featuresCol="__x", labelCol=label).fit(x.transform(val.withColumn("__z", logit(F.col("score")))))
    slope, base = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn("score", sigmoid(slope * logit(F.col("score")) + base))
