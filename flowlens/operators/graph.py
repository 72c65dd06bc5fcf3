"""Account graphs strictly before a cut-off: features, components, cycles, neighbourhoods.

A graph is its edge table (src, dst, cnt, weight, last_t).  Measures that only
add up over time (degrees, volumes, reciprocal partners) come for all periods at
once from increments at first occurrences and running sums; iterative ones run
on one snapshot and end every few rounds in a stored table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep, materialize
from .components import both_ways, connected_components, strongly_connected  # noqa: F401
from .quantiles import column_quantiles
from .temporal import DAY, closes_cycle, numbered, temporal_edges, temporal_node_measures  # noqa: F401

#: Links of a block of accounts that are ranked together.
RANK_LINKS = 500_000


def account_graph(tx: DataFrame, cutoff: int) -> DataFrame:
    """Edges from transfers strictly before ``cutoff``."""
    past = tx.where(F.col("t") < cutoff)
    return past.groupBy("src", "dst").agg(F.count("*").alias("cnt"), F.sum("amount").alias("weight"), F.max("t").alias("last_t"))


def snapshot_starts(tx: DataFrame, delta: int = DAY) -> DataFrame:
    """One period_start every ``delta`` from the floored first time to one past the last."""
    ends = tx.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    floor = lambda c: (F.floor(F.col(c) / delta) * delta).cast("long")
    return ends.select(F.explode(F.sequence(floor("lo"), F.col("hi") + delta, F.lit(delta).cast("long"))).alias("period_start"))


def node_features(edges: DataFrame, by: str | None = None) -> DataFrame:
    """Degrees, counts, log volumes, asymmetry, flow-through, reciprocal partners and neighbours' mean degrees.

    ``by`` names a column that tells apart graphs that are measured at once.
    """
    g = [by] if by else []
    out = edges.groupBy(*g, F.col("src").alias("node")).agg(F.count("*").alias("out_degree"), F.sum("cnt").alias("out_tx"), F.sum("weight").alias("ow"))
    inn = edges.groupBy(*g, F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.sum("cnt").alias("in_tx"), F.sum("weight").alias("iw"))
    back = edges.select(*g, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = edges.join(back, [*g, "src", "dst"], "left_semi").groupBy(*g, F.col("src").alias("node")).agg(F.count("*").alias("reciprocal_partners"))
    n_out = edges.join(out.select(*g, F.col("node").alias("dst"), F.col("out_degree").alias("d")), [*g, "dst"], "left")
    n_in = edges.join(inn.select(*g, F.col("node").alias("src"), F.col("in_degree").alias("d")), [*g, "src"], "left")
    mean = F.avg(F.coalesce("d", F.lit(0)))
    wide = out.join(inn, [*g, "node"], "full")
    for more in (mutual, n_out.groupBy(*g, F.col("src").alias("node")).agg(mean.alias("nbr_out_degree_mean")), n_in.groupBy(*g, F.col("dst").alias("node")).agg(mean.alias("nbr_in_degree_mean"))):
        wide = wide.join(more, [*g, "node"], "left")
    wide = wide.fillna(0, subset=[c for c in wide.columns if c not in (*g, "node")])
    o, i = F.col("out_degree"), F.col("in_degree")
    most = F.greatest("ow", "iw")
    return wide.select(
        *g, "node", "in_degree", "out_degree", "in_tx", "out_tx",
        F.log1p("iw").alias("log_in_weight"), F.log1p("ow").alias("log_out_weight"),
        ((o - i) / (o + i + 1)).alias("degree_asymmetry"),
        F.when(most > 0, F.least("ow", "iw") / most).otherwise(0.0).alias("flow_through"),
        "reciprocal_partners", "nbr_out_degree_mean", "nbr_in_degree_mean",
    )


def _rank_plans(links: pd.DataFrame) -> pd.DataFrame:
    """The links from one block to another: what the first adds up for each receiver, and who these are."""
    links = links.sort_values(["bi", "ai"])
    a, b = int(links["a"].iloc[0]), int(links["b"].iloc[0])
    to = links["bi"].to_numpy(np.int32)
    starts = np.flatnonzero(np.append(True, np.diff(to) != 0))
    rows = [(a, "send", b, pickle.dumps((links["ai"].to_numpy(np.int32), starts))), (b, "hear", a, pickle.dumps(to[starts]))]
    return pd.DataFrame(rows, columns=["block", "role", "other", "payload"])


def _rank_nodes(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("i")
    value = part["g"].to_numpy(), part["node"].to_numpy(), part["n"].to_numpy(float), part["deg"].to_numpy(float)
    return pd.DataFrame({"block": part["block"].iloc[:1], "role": "nodes", "other": -1, "payload": [pickle.dumps(value)]})


def _rank_rounds(blocks: int, alpha: float, last: int):
    """Rounds of a block: its ranks from what it hears, and what it passes on to every block, with the rank passed on in all."""

    def run(part: pd.DataFrame, heard: dict[int, tuple[np.ndarray, dict]], first: int) -> pd.DataFrame:
        roles = {(role, int(other)): pickle.loads(payload) for role, other, payload in zip(part["role"], part["other"], part["payload"], strict=True)}
        g, node, n, deg = roles["nodes", -1]
        groups, member = np.unique(g, return_inverse=True)
        me, k, r = int(part["block"].iloc[0]), first, 1.0 / n
        while True:
            if k:
                got, kept = np.zeros(len(n)), np.zeros(len(groups))
                for other in sorted(heard):
                    values, passed = heard[other]
                    if len(values):
                        got[roles["hear", other]] += values
                    kept += [passed.get(v, 0.0) for v in groups.tolist()]
                r = (1 - alpha) / n + alpha * (got + (1.0 - kept[member]) / n)
            if k == last:
                return pd.DataFrame({"g": g, "node": node, "pagerank": r * n})
            passed = dict(zip(groups.tolist(), np.bincount(member, np.where(deg > 0, r, 0.0)).tolist(), strict=True))
            share = np.divide(r, deg, out=np.zeros(len(r)), where=deg > 0)
            out = {other: (np.add.reduceat(share[roles["send", other][0]], roles["send", other][1]) if ("send", other) in roles else np.zeros(0), passed) for other in range(blocks)}
            if blocks > 1:
                return pd.DataFrame([(other, me, pickle.dumps(v)) for other, v in out.items()], columns=["block", "other", "payload"])
            heard, k = out, k + 1

    return run


def pagerank(edges: DataFrame, iterations: int = 50, alpha: float = 0.85, by: str | None = None) -> DataFrame:
    """node, pagerank over the accounts of the graph, times their number: 1 on average.

    Unweighted; rank of accounts without payees is spread over all.  ``by`` names
    a column that tells apart graphs that are ranked at once.  Accounts are dealt
    to blocks of about ``RANK_LINKS`` links, which stay where they are: a round
    shuffles what each block passes on to the accounts of every other, added up,
    without their names.  The rank that is passed on adds up to that of the
    accounts with payees.
    """
    g = F.col(by) if by else F.lit(0)
    links = materialize(edges.select(g.alias("g"), "src", "dst").distinct(), "pagerank-links")
    blocks = max(1, -(-links.count() // RANK_LINKS))
    degree = links.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    nodes = links.select("g", F.col("src").alias("node")).union(links.select("g", "dst")).distinct()
    sizes = materialize(nodes.groupBy("g").agg(F.count("*").cast("double").alias("n")), "pagerank-sizes")
    place = F.row_number().over(Window.partitionBy("block").orderBy("g", "node")) - 1
    nodes = nodes.join(degree, ["g", "node"], "left").join(F.broadcast(sizes), "g").select("g", "node", "n", F.coalesce("deg", F.lit(0)).alias("deg"), F.pmod(F.xxhash64("g", "node"), F.lit(blocks)).alias("block"))
    nodes = materialize(nodes.withColumn("i", place), "pagerank-nodes")
    of = lambda end, block, i: nodes.select("g", F.col("node").alias(end), F.col("block").alias(block), F.col("i").alias(i))
    ends = links.join(of("src", "a", "ai"), ["g", "src"]).join(of("dst", "b", "bi"), ["g", "dst"]).select("a", "b", "ai", "bi")
    shape, mail = "block long, role string, other long, payload binary", "block long, other long, payload binary"
    rows = nodes.groupBy("block").applyInPandas(_rank_nodes, shape).unionByName(ends.groupBy("a", "b").applyInPandas(_rank_plans, shape))
    rows = keep(rows.repartition(blocks, "block"))
    types = dict(nodes.dtypes)
    found = f"g {types['g']}, node {types['node']}, pagerank double"
    run = _rank_rounds(blocks, alpha, iterations)
    step = lambda k: lambda part, inbox: run(part, {int(o): pickle.loads(v) for o, v in zip(inbox["other"], inbox["payload"], strict=True)}, k)
    state = rows.groupBy("block").applyInPandas(lambda part: run(part, {}, 0), mail if blocks > 1 and iterations else found)
    for k in range(1, iterations + 1 if blocks > 1 else 1):
        if k % 10 == 0:
            state = materialize(state, "pagerank-mail")  # keeps the plan short
        state = rows.groupBy("block").cogroup(state.repartition(blocks, "block").groupBy("block")).applyInPandas(step(k), mail if k < iterations else found)
    out = materialize(state, "pagerank")
    rows.unpersist()
    return out.select(*([F.col("g").alias(by)] if by else []), "node", "pagerank")


def period_node_features(tx: DataFrame, delta: int = DAY) -> DataFrame:
    """tx_id and src_/dst_ copies of the additive node features before each transfer's period.

    Every measure grows by an increment in the period of its cause: a pair's
    first transfer adds a degree, the later of two opposite firsts a reciprocal
    partner.  Running sums over an account's periods then serve all snapshots.
    """
    period = (F.floor(F.col("t") / delta) * delta).cast("long")
    rows = tx.withColumn("p", period)
    pairs = rows.groupBy("src", "dst", "p").agg(F.count("*").alias("c"), F.sum("amount").alias("w"))
    first = pairs.groupBy("src", "dst").agg(F.min("p").alias("first"))
    back = first.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("first").alias("other"))
    mutual = first.join(back, ["src", "dst"]).select(F.col("src").alias("node"), F.greatest("first", "other").alias("p"), F.lit(1).alias("reciprocal_partners"))
    names = ("in_degree", "out_degree", "in_tx", "out_tx", "in_weight", "out_weight", "reciprocal_partners")
    full = lambda df: df.select("node", "p", *[(F.col(n) if n in df.columns else F.lit(0)).cast("double").alias(n) for n in names])
    parts = [
        full(first.select(F.col("src").alias("node"), F.col("first").alias("p"), F.lit(1).alias("out_degree"))),
        full(first.select(F.col("dst").alias("node"), F.col("first").alias("p"), F.lit(1).alias("in_degree"))),
        full(pairs.select(F.col("src").alias("node"), "p", F.col("c").alias("out_tx"), F.col("w").alias("out_weight"))),
        full(pairs.select(F.col("dst").alias("node"), "p", F.col("c").alias("in_tx"), F.col("w").alias("in_weight"))),
        full(mutual),
    ]
    steps = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4]).groupBy("node", "p").agg(*[F.sum(n).alias(n) for n in names])
    past = Window.partitionBy("node").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # A node has a step in every period it takes part in, so every lookup meets one.
    state = steps.select("node", "p", *[zero(F.sum(n).over(past)).alias(n) for n in names])
    o, i = F.col("out_degree"), F.col("in_degree")
    most = F.greatest("out_weight", "in_weight")
    state = state.select(
        "node", "p", *[F.col(n).cast("long").alias(n) for n in ("in_degree", "out_degree", "in_tx", "out_tx", "reciprocal_partners")],
        F.log1p("in_weight").alias("log_in_weight"), F.log1p("out_weight").alias("log_out_weight"),
        ((o - i) / (o + i + 1)).alias("degree_asymmetry"), F.when(most > 0, F.least("out_weight", "in_weight") / most).otherwise(0.0).alias("flow_through"),
    )
    side = lambda s: state.select(F.col("node").alias(s), "p", *[F.col(c).alias(f"{s}_{c}") for c in state.columns[2:]])
    return rows.select("tx_id", "src", "dst", "p").join(side("src"), ["src", "p"]).join(side("dst"), ["dst", "p"]).drop("src", "dst", "p")


def pair_history(tx: DataFrame, delta: int = DAY) -> DataFrame:
    """tx_id, prior_pair_tx (earlier transfers of the pair) and reverse_edge_exists, before the period."""
    rows = tx.withColumn("p", (F.floor(F.col("t") / delta) * delta).cast("long"))
    counts = rows.groupBy("src", "dst", "p").agg(F.count("*").alias("c"))
    past = Window.partitionBy("src", "dst").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    prior = counts.select("src", "dst", "p", F.coalesce(F.sum("c").over(past), F.lit(0)).alias("prior_pair_tx"))
    first = counts.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("p").alias("back"))
    seen = prior.join(first, ["src", "dst"], "left").withColumn("reverse_edge_exists", F.coalesce((F.col("back") < F.col("p")).cast("int"), F.lit(0)))
    return rows.select("tx_id", "src", "dst", "p").join(seen.drop("back"), ["src", "dst", "p"]).select("tx_id", "prior_pair_tx", "reverse_edge_exists")


#: Measures of an account in a snapshot.
NODE_FEATURES = (
    "in_degree", "out_degree", "in_tx", "out_tx", "log_in_weight", "log_out_weight", "degree_asymmetry", "flow_through",
    "reciprocal_partners", "pagerank", "log_scc_size", "nbr_out_degree_mean", "nbr_in_degree_mean",
)


def all_node_features(edges: DataFrame, iterations: int = 50) -> DataFrame:
    """All measures of ``NODE_FEATURES`` for each account of one graph."""
    sizes = strongly_connected(edges).select("node", F.log("scc_size").alias("log_scc_size"))
    joined = node_features(edges).join(pagerank(edges, iterations), "node").join(sizes, "node")
    return joined.select("node", *NODE_FEATURES)


def graph_features(tx: DataFrame, delta: int = DAY, iterations: int = 50) -> DataFrame:
    """tx_id, src_ and dst_ copies of all node measures, closes_cycle, reverse_edge_exists, prior_pair_tx.

    All come from the graph before the transfer's period; accounts that it does
    not hold have zeros.  No snapshot is written out: additive measures are
    running sums over an account's periods, the others come from
    :mod:`temporal`.
    """
    rows, periods, last = numbered(tx, delta)
    asked = rows.select(F.col("src").alias("node"), "i").union(rows.select("dst", "i"))
    nodes = materialize(temporal_node_measures(temporal_edges(tx, periods, delta), asked, last, iterations), "temporal-measures")
    own = ("pagerank", "log_scc_size", "nbr_out_degree_mean", "nbr_in_degree_mean")
    of = lambda end: nodes.select(F.col("node").alias(end), "i", F.col("scc").alias(f"{end}_scc"), F.log("scc_size").alias(f"{end}_log_scc_size"), *[F.col(c).alias(f"{end}_{c}") for c in own if c != "log_scc_size"])
    both = rows.select("tx_id", "src", "dst", "i").join(of("src"), ["src", "i"]).join(of("dst"), ["dst", "i"])
    closes = ((F.col("src_scc") == F.col("dst_scc")) & (F.col("src_log_scc_size") > 0)).cast("int").alias("closes_cycle")
    iterated = both.select("tx_id", closes, *[f"{side}_{c}" for side in ("src", "dst") for c in own])
    measures = [f"{side}_{c}" for side in ("src", "dst") for c in NODE_FEATURES]
    wide = period_node_features(tx, delta).join(iterated, "tx_id").select("tx_id", *[F.col(c).cast("double").alias(c) for c in measures], "closes_cycle")
    return wide.join(pair_history(tx, delta), "tx_id")


def account_bank(tx: DataFrame, order: str = "tx_id") -> DataFrame:
    """account and the bank it is first seen at: as a sender anywhere before as a receiver, then by ``order``.

    ``tx``: src, dst, src_bank, dst_bank.
    """
    seen = lambda end, turn: tx.select(F.col(end).alias("account"), F.col(f"{end}_bank").alias("bank"), F.struct(F.lit(turn), F.col(order)).alias("at"))
    return seen("src", 0).unionByName(seen("dst", 1)).groupBy("account").agg(F.min_by("bank", "at").alias("bank"))


def snapshot_intervals(tx: DataFrame, delta: int = DAY) -> DataFrame:
    """fmt, src, dst, log_count, last_t, first_start, last_start: the states of each pair and the snapshots that show them.

    A state holds from the snapshot after the pair's activity to that of its next
    one, so there is a row for each pair and active period, however many
    snapshots follow.
    """
    last = snapshot_starts(tx, delta).agg(F.max("period_start").alias("end"))
    pairs = tx.withColumn("p", (F.floor(F.col("t") / delta) * delta).cast("long")).groupBy("fmt", "src", "dst", "p").agg(F.count("*").alias("c"), F.max("t").alias("m"))
    running = Window.partitionBy("fmt", "src", "dst").orderBy("p")
    state = pairs.select(
        "fmt", "src", "dst", F.log1p(F.sum("c").over(running)).alias("log_count"), F.max("m").over(running).alias("last_t"),
        (F.col("p") + delta).alias("first_start"), F.lead("p").over(running).alias("next_p"),
    )
    placed = state.crossJoin(F.broadcast(last)).withColumn("last_start", F.coalesce("next_p", "end"))
    return placed.where("first_start <= last_start and first_start <= end").drop("next_p", "end")


def snapshot_edges(tx: DataFrame, period_start: int, delta: int = DAY) -> DataFrame:
    """fmt, src, dst, log_count, last_t, recent of one snapshot; ``recent``: active in the last ``delta`` before it."""
    shown = snapshot_intervals(tx, delta).where((F.col("first_start") <= period_start) & (F.col("last_start") >= period_start))
    return shown.select("fmt", "src", "dst", "log_count", "last_t", (F.col("last_t") >= period_start - delta).alias("recent"))


def snapshot_totals(tx: DataFrame, delta: int = DAY) -> DataFrame:
    """period_start, fmt, n_edges, log_counts, last_t, n_recent of every snapshot that has edges.

    States add to the totals at their first snapshot and are taken off after
    their last; running sums over the snapshots do the rest.
    """
    states = snapshot_intervals(tx, delta)
    comes = states.select("fmt", F.col("first_start").alias("period_start"), F.lit(1).alias("n"), F.col("log_count").alias("x"), "last_t", F.lit(1).alias("r"))
    goes = states.select("fmt", (F.col("last_start") + delta).alias("period_start"), F.lit(-1).alias("n"), (-F.col("log_count")).alias("x"), F.lit(None).cast("long").alias("last_t"), F.lit(0).alias("r"))
    steps = comes.unionByName(goes).groupBy("fmt", "period_start").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("last_t").alias("last_t"), F.sum("r").alias("r"))
    grid = tx.select("fmt").distinct().crossJoin(F.broadcast(snapshot_starts(tx, delta)))
    order = Window.partitionBy("fmt").orderBy("period_start")  # a row a snapshot
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = grid.join(steps, ["fmt", "period_start"], "left").select(
        "period_start", "fmt", F.sum(zero("n")).over(order).alias("n_edges"), F.sum(zero("x")).over(order).alias("log_counts"),
        F.max("last_t").over(order).alias("last_t"), zero("r").alias("n_recent"),
    )
    return out.where("n_edges > 0")


def ego_network(tx: DataFrame, account: int, until: int, limit: int = 200, hops: int = 2) -> DataFrame:
    """Transfers around an account strictly before ``until``: its own, latest first, then its neighbours', riskiest first."""
    past = tx.where(F.col("t") < until)
    touches = (F.col("src") == account) | (F.col("dst") == account)
    own = past.where(touches).orderBy(F.desc("t"), "tx_id").limit(limit)
    if hops < 2:
        return own.withColumn("hop", F.lit(1))
    near = own.select(F.explode(F.array("src", "dst")).alias("n")).where(F.col("n") != account).distinct()
    at_src = past.join(F.broadcast(near), past.src == near.n, "left_semi")
    at_dst = past.join(F.broadcast(near), past.dst == near.n, "left_semi")
    n_own = own.count()
    second = at_src.union(at_dst).dropDuplicates(["tx_id"]).orderBy(F.desc_nulls_last("score"), F.desc("t"), "tx_id").limit(max(0, limit - n_own))
    fresh = second.join(own.select("tx_id"), "tx_id", "left_anti").select(*own.columns)
    return own.withColumn("hop", F.lit(1)).unionByName(fresh.withColumn("hop", F.lit(2)))


def hop_distances(edges: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """node, hops from the nearest root over undirected edges, up to ``depth``."""
    links = both_ways(edges).where("node <> other").distinct()
    seen = roots.select("node", F.lit(0).alias("hops")).distinct()
    front = seen
    for k in range(1, depth + 1):
        front = links.join(front.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k))
        front = materialize(front, "hops")
        seen = seen.unionByName(front)
    return seen


def edge_homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of edges between accounts of one label; edges with an unlabelled end are left out."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("y").alias("y_" + end))
    return edges.join(of("src"), "src").join(of("dst"), "dst").agg(F.avg((F.col("y_src") == F.col("y_dst")).cast("double")).alias("homophily"))


def positive_adjacency(tx: DataFrame, label: str = "label") -> DataFrame:
    """Share of positive and of other transfers with an end on another positive transfer."""
    ends = tx.where(F.col(label) == 1).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    of = lambda end: ends.select(F.col("node").alias(end), F.col("k").alias("k_" + end))
    both = tx.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    more = lambda end: F.coalesce("k_" + end, F.lit(0)) - F.col(label) > 0
    touches = (more("src") | more("dst")).cast("double")
    return both.agg(
        F.avg(F.when(F.col(label) == 1, touches)).alias("positive_touching_positive"),
        F.avg(F.when(F.col(label) != 1, touches)).alias("negative_touching_positive"),
    )


def degree_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Isolated share, median, 99th percentile and maximum of edge ends over all nodes."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    d = nodes.join(degree, "node", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    d = materialize(d, "degrees")
    median, high = column_quantiles(d, "d", [0.5, 0.99]) or (None, None)
    return d.agg(
        F.avg((F.col("d") == 0).cast("double")).alias("isolated_fraction"), F.lit(median).cast("double").alias("median_degree"),
        F.lit(high).cast("double").alias("p99_degree"), F.max("d").alias("max_degree"),
    )


def propagate(features: DataFrame, edges: DataFrame, columns: list[str], layers: int = 2) -> DataFrame:
    """Fixed message passing: each layer adds the mean over payers and over payees to a node's own values."""
    state = features.select("node", *columns)
    links = edges.select("src", "dst").distinct()
    for k in range(layers):
        got = links.join(state.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(*[F.avg(c).alias("i_" + c) for c in columns])
        sent = links.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.avg(c).alias("o_" + c) for c in columns])
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        state = state.join(got, "node", "left").join(sent, "node", "left").select(
            "node", *[((F.col(c) + zero("i_" + c) + zero("o_" + c)) / 3).alias(c) for c in columns]
        )
        state = materialize(state, f"layer-{k}")
    return state
