"""Ring candidates from high-scoring transfers, their features, truth and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .graph import connected_components
from .quantiles import column_quantiles
from .set_similarity import similar_pairs

#: Features of a candidate.
FEATURES = (
    "n_members", "n_edges", "density", "mean_score", "max_score", "min_score", "log_total_amount", "amount_cv", "span_hours",
    "has_cycle", "max_in_degree_share", "max_out_degree_share", "n_formats", "cross_bank_share",
)


def _moves(links: DataFrame, own: DataFrame, turn: int) -> DataFrame:
    """x, degree, total, g, moved: each node in the neighbouring group of largest modularity gain.

    Half of the nodes, by a hash that changes with the turn, may move at once, so
    that neighbours don't swap for ever.
    """
    keys = ["component", "x"]
    sizes = own.groupBy("component", "g").agg(F.sum("degree").alias("size"))
    near = links.join(own.select("component", F.col("x").alias("y"), "g"), ["component", "y"]).groupBy(*keys, "g").agg(F.sum("w").alias("k"))
    stay = own.select(*keys, "g", F.lit(0).cast("long").alias("k"))
    options = near.unionByName(stay).groupBy(*keys, "g").agg(F.sum("k").alias("k")).join(sizes, ["component", "g"])
    at_home = F.col("g") == F.col("g0")
    gain = F.col("k") - F.col("degree") * (F.col("size") - F.when(at_home, F.col("degree")).otherwise(0)) / F.col("total")
    rated = options.join(own.withColumnRenamed("g", "g0"), keys).withColumn("gain", gain)
    best = rated.groupBy(*keys, "degree", "total", "g0").agg(F.max(F.when(at_home, F.col("gain"))).alias("home"), F.max("gain").alias("gain"), F.min_by("g", F.struct(-F.col("gain"), F.col("g"))).alias("best"))
    goes = (F.col("gain") > F.col("home") + 1e-9) & (F.pmod(F.xxhash64("x", F.lit(turn)), F.lit(2)) == 0)
    return best.select(*keys, "degree", "total", F.when(goes, F.col("best")).otherwise(F.col("g0")).alias("g"), goes.alias("moved"))


def communities(edges: DataFrame, turns: int = 20) -> DataFrame:
    """node, component, part (its least node) of components (component, src, dst) by the Louvain method, all at once.

    Nodes move to neighbouring groups in up to ``turns`` turns, groups become
    the nodes of the next level, and so on until none merge.  Every turn is a few
    groupings over links, so no component is gathered.
    """
    pairs = edges.where("src <> dst")
    links = pairs.select("component", F.col("src").alias("x"), F.col("dst").alias("y")).unionAll(pairs.select("component", "dst", "src"))
    links = materialize(links.groupBy("component", "x", "y").agg(F.count("*").alias("w")), "community-links")
    degree = links.groupBy("component", "x").agg(F.sum("w").cast("double").alias("degree"))
    total = degree.groupBy("component").agg(F.sum("degree").alias("total"))
    own = materialize(degree.join(total, "component").withColumn("g", F.col("x")), "community-own")
    part = own.select("component", F.col("x").alias("node"), F.col("x").alias("part"))
    while True:
        still = 0
        for turn in range(turns):
            after = materialize(_moves(links, own, turn), "community-own")
            still = 0 if after.where("moved").limit(1).count() else still + 1
            own = after.drop("moved")
            if still == 3:
                break
        if not own.where("g <> x").limit(1).count():
            break
        to = own.select("component", "x", "g")
        part = materialize(part.join(to.withColumnRenamed("x", "part"), ["component", "part"]).select("component", "node", F.col("g").alias("part")), "community-part")
        ends = links.join(to.withColumnRenamed("g", "gx"), ["component", "x"]).join(to.select("component", F.col("x").alias("y"), F.col("g").alias("gy")), ["component", "y"]).where("gx <> gy")
        links = materialize(ends.groupBy("component", F.col("gx").alias("x"), F.col("gy").alias("y")).agg(F.sum("w").alias("w")), "community-links")
        merged = own.groupBy("component", F.col("g").alias("x"), "total").agg(F.sum("degree").alias("degree"))
        own = materialize(merged.withColumn("g", F.col("x")), "community-own")
    names = part.groupBy("component", "part").agg(F.min("node").alias("least"))
    return part.join(names, ["component", "part"]).select("node", "component", F.col("least").alias("part"))


def candidates(scored: DataFrame, quantile: float = 0.99, max_size: int = 50, min_size: int = 3) -> DataFrame:
    """ring_id, members, tx_ids and features of suspicious subgraphs.

    Transfers at or above the score quantile form a graph; its components are
    the candidates, larger ones split into communities, transfers between
    communities dropped.
    """
    tau = (column_quantiles(scored, "score", [quantile]) or [None])[0]
    hot = scored.where(F.col("score") >= tau)
    comps = connected_components(hot.select("src", "dst"))
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    edges = hot.join(comps.withColumnRenamed("node", "src"), "src").join(sizes, "component")
    big = edges.where(F.col("n") > max_size).select("component", "src", "dst")
    parts = comps.select("node", F.col("component").alias("part"))
    if big.limit(1).count():
        parts = comps.join(communities(big), ["node", "component"], "left").select("node", F.coalesce("part", "component").alias("part"))
    ranked = parts.groupBy("part").agg(F.sort_array(F.collect_set("node")).alias("members")).where(F.size("members") >= min_size)
    order = Window.orderBy(F.desc(F.size("members")), F.col("members")[0])
    rings = ranked.withColumn("ring_id", F.format_string("R-%04d", F.row_number().over(order)))  # a row a candidate
    of = lambda end: parts.select(F.col("node").alias(end), F.col("part").alias("part_" + end))
    inner = hot.join(of("src"), "src").join(of("dst"), "dst").where("part_src = part_dst").withColumnRenamed("part_src", "part").drop("part_dst")
    return candidate_features(inner.join(rings.select("part", "ring_id", "members"), "part"))


def candidate_features(edges: DataFrame) -> DataFrame:
    """Features of each ring from its transfers (ring_id, members, src, dst, amount, t, score, fmt, src_bank, dst_bank)."""
    has_bank = {"src_bank", "dst_bank"} <= set(edges.columns)
    cross = F.avg((F.col("src_bank") != F.col("dst_bank")).cast("double")) if has_bank else F.lit(0.0)
    pairs = edges.select("ring_id", "src", "dst").distinct()
    shape = pairs.groupBy("ring_id").agg(F.count("*").alias("m"))
    top = lambda end: pairs.groupBy("ring_id", end).count().groupBy("ring_id").agg(F.max("count").alias("top_" + end))
    n = F.size("members")
    base = edges.groupBy("ring_id").agg(
        F.first("members").alias("members"), F.array_sort(F.collect_list("tx_id")).alias("tx_ids"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_edges"),
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.log1p(F.sum("amount")).alias("log_total_amount"),
        (F.stddev_pop("amount") / F.greatest(F.avg("amount"), F.lit(1e-9))).alias("amount_cv"), ((F.max("t") - F.min("t")) / 3600).alias("span_hours"),
        F.count_distinct("fmt").alias("n_formats"), cross.alias("cross_bank_share"),
    )
    full = base.join(shape, "ring_id").join(top("dst"), "ring_id").join(top("src"), "ring_id").join(has_cycle(pairs), "ring_id", "left")
    return full.select(
        "ring_id", "members", "tx_ids", "first_t", "last_t", n.alias("n_members"), "n_edges", (F.col("m") / F.greatest(n * (n - 1), F.lit(1))).alias("density"),
        "mean_score", "max_score", "min_score", "log_total_amount", "amount_cv", "span_hours", F.coalesce("has_cycle", F.lit(0)).alias("has_cycle"),
        (F.col("top_dst") / F.col("m")).alias("max_in_degree_share"), (F.col("top_src") / F.col("m")).alias("max_out_degree_share"), "n_formats", "cross_bank_share",
    )


def has_cycle(pairs: DataFrame) -> DataFrame:
    """ring_id, has_cycle: whether peeling off accounts without payers or payees leaves any pair; all rings at once."""
    left = materialize(pairs.select("ring_id", "src", "dst").distinct(), "ring-cycle")
    n = left.count()
    while n:
        # Merged, not broadcast: every round would send its accounts through the driver.
        paid, pays = (left.select("ring_id", F.col(a).alias(b)).distinct().hint("merge") for a, b in (("dst", "src"), ("src", "dst")))
        left = materialize(left.join(paid, ["ring_id", "src"], "left_semi").join(pays, ["ring_id", "dst"], "left_semi").select("ring_id", "src", "dst"), "ring-cycle")
        before, n = n, left.count()
        if n == before:
            break
    cyclic = left.select("ring_id").distinct().withColumn("has_cycle", F.lit(1))
    return pairs.select("ring_id").distinct().join(cyclic, "ring_id", "left").select("ring_id", F.coalesce("has_cycle", F.lit(0)).alias("has_cycle"))


def truth_rings(patterns: DataFrame, tx: DataFrame, window_tx: DataFrame) -> DataFrame:
    """ring_id, members (accounts of the pattern's transfers in the window), t_start, t_end (of the whole pattern)."""
    whole = patterns.groupBy("pattern_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min("typology").alias("typology"))
    inside = patterns.join(window_tx.select("tx_id"), "tx_id", "left_semi").join(tx.select("tx_id", "src", "dst"), "tx_id")
    members = inside.select("pattern_id", "tx_id", F.explode(F.array("src", "dst")).alias("a")).groupBy("pattern_id").agg(F.sort_array(F.collect_set("a")).alias("members"), F.count_distinct("tx_id").alias("n_tx_in_window"))
    return members.join(whole, "pattern_id").withColumn("ring_id", F.format_string("P-%04d", F.col("pattern_id").cast("int")))


def label_candidates(rings: DataFrame, truth: DataFrame, theta: float = 0.5) -> DataFrame:
    """ring_id, y: 1 if some true ring overlaps with a Jaccard of theta or more."""
    pairs = similar_pairs(rings.select(F.col("ring_id").alias("pid"), "members"), truth.select(F.col("ring_id").alias("tid"), "members"), theta)
    like = pairs.select(F.col("pid").alias("ring_id")).distinct().withColumn("y", F.lit(1))
    return rings.select("ring_id").join(like, "ring_id", "left").select("ring_id", F.coalesce("y", F.lit(0)).alias("y"))


def recent_transfers(tx: DataFrame, batch_start: int, hours: int = 96) -> DataFrame:
    """Transfers of the ``hours`` before a batch of alerts: what its rings are found in."""
    return tx.where((F.col("t") < batch_start) & (F.col("t") >= batch_start - hours * 3600))


def rings_of_alerts(alerts: DataFrame, rings: DataFrame) -> DataFrame:
    """``alerts`` with the best ring of the sender, or else of the receiver; null if neither is in one."""
    best = ring_of_account(rings)
    of = lambda side: best.select(F.col("account").alias(side), F.col("ring_id").alias(f"__{side}"))
    joined = alerts.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return joined.select(*alerts.columns, F.coalesce("__src", "__dst").alias("ring_id"))


def ring_of_account(rings: DataFrame) -> DataFrame:
    """account and its best-scoring ring."""
    return rings.select(F.explode("members").alias("account"), "ring_id", "score").groupBy("account").agg(F.max_by("ring_id", F.struct("score", "ring_id")).alias("ring_id"))
