"""Graph operators over the event transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.transfers import EVENT_TX, event_transfers
from .registry import query, rounded

#: 2024-style cut-offs do not fit every table: half of the time span serves.
_CUT = "cut AS (SELECT (min(t) + (max(t) - min(t)) // 2) // 86400 * 86400 AS c FROM tx)"
_EDGES = f"WITH RECURSIVE {EVENT_TX}, {_CUT}, e AS (SELECT src, dst, count(*) AS cnt, sum(amount) AS weight, max(t) AS last_t FROM tx, cut WHERE t < c GROUP BY src, dst)"
#: The graph of all transfers.
_ALL = f"WITH RECURSIVE {EVENT_TX}, e AS (SELECT DISTINCT src, dst FROM tx)"


def _cut(tx: DataFrame) -> int:
    lo, hi = tx.agg(F.min("t"), F.max("t")).first()
    return (lo + (hi - lo) // 2) // 86400 * 86400


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    return G.account_graph(tx, _cut(tx))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_transfers(spark, sf_dir).select("src", "dst").distinct()


@query("n1_account_graph", _EDGES + " SELECT src, dst, cnt, round(weight, 4) AS weight, last_t FROM e")
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_edges(spark, sf_dir), 4, "weight")


@query("n2_snapshot_starts", f"WITH {EVENT_TX} SELECT unnest(range(CAST(min(t) // 86400 * 86400 AS BIGINT), CAST(max(t) + 86400 + 1 AS BIGINT), 86400)) AS period_start FROM tx")
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.snapshot_starts(event_transfers(spark, sf_dir))


_DEGREES = """n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
d AS (SELECT node, (SELECT count(*) FROM e WHERE e.dst = node) AS i, (SELECT count(*) FROM e WHERE e.src = node) AS o,
  (SELECT coalesce(sum(cnt), 0) FROM e WHERE e.dst = node) AS it, (SELECT coalesce(sum(cnt), 0) FROM e WHERE e.src = node) AS ot,
  (SELECT coalesce(sum(weight), 0) FROM e WHERE e.dst = node) AS iw, (SELECT coalesce(sum(weight), 0) FROM e WHERE e.src = node) AS ow,
  (SELECT count(*) FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node) AS rp FROM n)"""
_MEASURES = """d.node, i AS in_degree, o AS out_degree, CAST(it AS BIGINT) AS in_tx, CAST(ot AS BIGINT) AS out_tx, round(ln(1 + iw), 6) AS log_in_weight, round(ln(1 + ow), 6) AS log_out_weight,
  round((o - i) / CAST(o + i + 1 AS DOUBLE), 6) AS degree_asymmetry, round(CASE WHEN greatest(iw, ow) > 0 THEN least(iw, ow) / greatest(iw, ow) ELSE 0 END, 6) AS flow_through, rp AS reciprocal_partners,
  round(coalesce((SELECT avg(x.o) FROM e JOIN d x ON x.node = e.dst WHERE e.src = d.node), 0), 6) AS nbr_out_degree_mean,
  round(coalesce((SELECT avg(x.i) FROM e JOIN d x ON x.node = e.src WHERE e.dst = d.node), 0), 6) AS nbr_in_degree_mean"""


@query("n3_node_features", f"{_EDGES}, {_DEGREES} SELECT {_MEASURES} FROM d")
def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.node_features(_edges(spark, sf_dir)), 6, "log_in_weight", "log_out_weight", "degree_asymmetry", "flow_through", "nbr_out_degree_mean", "nbr_in_degree_mean")


def _ranks(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(rounds):
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (coalesce(g, 0)
  + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n)) AS r
  FROM n LEFT JOIN (SELECT e.dst AS node, sum(r / deg) AS g FROM e JOIN r{k} ON r{k}.node = e.src JOIN payees USING (src) GROUP BY e.dst) USING (node))""")
    return "payees AS (SELECT src, count(*) AS deg FROM e GROUP BY src), " + ", ".join(steps)


@query("n5_pagerank", f"{_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), {_ranks(50)} SELECT node, round(r * (SELECT count(*) FROM n), 6) AS pagerank FROM r50")
def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.pagerank(_edges(spark, sf_dir)), 6, "pagerank")


@query("n6_strongly_connected", _ALL + """, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
m AS (SELECT node, node AS o FROM n UNION SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src)
SELECT node, count(*) AS scc_size FROM m GROUP BY node""")
def n6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strongly_connected(_whole(spark, sf_dir)).select("node", "scc_size")


@query("n10_components", _ALL + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT a AS node FROM u),
r(node, c) USING KEY (node) AS (SELECT node, node FROM n UNION SELECT u.a, min(r.c) FROM r JOIN u ON u.b = r.node JOIN recurring.r old ON old.node = u.a WHERE r.c < old.c GROUP BY u.a)
SELECT node, c AS component FROM r""")
def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected_components(_whole(spark, sf_dir))


@query("n8_period_node_features", f"""WITH {EVENT_TX}, q AS (SELECT *, t // 86400 * 86400 AS p FROM tx),
f AS (SELECT src, dst, min(p) AS p FROM q GROUP BY src, dst), mu AS (SELECT a.src AS node, greatest(a.p, b.p) AS p FROM f a JOIN f b ON a.src = b.dst AND a.dst = b.src),
u AS (SELECT src AS acct, p, 1 AS od, 0 AS idg, 0 AS ot, 0 AS it, 0.0::DOUBLE AS ow, 0.0::DOUBLE AS iw, 0 AS rp FROM f UNION ALL SELECT dst, p, 0, 1, 0, 0, 0, 0, 0 FROM f
  UNION ALL SELECT src, p, 0, 0, 1, 0, amount, 0, 0 FROM q UNION ALL SELECT dst, p, 0, 0, 0, 1, 0, amount, 0 FROM q UNION ALL SELECT node, p, 0, 0, 0, 0, 0, 0, 1 FROM mu),
g AS (SELECT acct, p, sum(od) AS od, sum(idg) AS idg, sum(ot) AS ot, sum(it) AS it, sum(ow) AS ow, sum(iw) AS iw, sum(rp) AS rp FROM u GROUP BY acct, p),
s AS (SELECT acct, p, {", ".join(f"coalesce(sum({c}) OVER w, 0) AS {c}" for c in ("od", "idg", "ot", "it", "ow", "iw", "rp"))} FROM g WINDOW w AS (PARTITION BY acct ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT tx_id, {", ".join(f"CAST({a}.idg AS BIGINT) AS {b}_in_degree, CAST({a}.od AS BIGINT) AS {b}_out_degree, CAST({a}.it AS BIGINT) AS {b}_in_tx, CAST({a}.ot AS BIGINT) AS {b}_out_tx, CAST({a}.rp AS BIGINT) AS {b}_reciprocal_partners, round(ln(1 + {a}.iw), 6) AS {b}_log_in_weight, round(ln(1 + {a}.ow), 6) AS {b}_log_out_weight, round(({a}.od - {a}.idg) / CAST({a}.od + {a}.idg + 1 AS DOUBLE), 6) AS {b}_degree_asymmetry, round(CASE WHEN greatest({a}.ow, {a}.iw) > 0 THEN least({a}.ow, {a}.iw) / greatest({a}.ow, {a}.iw) ELSE 0 END, 6) AS {b}_flow_through" for a, b in (("x", "src"), ("y", "dst")))}
FROM q JOIN s x ON x.acct = q.src AND x.p = q.p JOIN s y ON y.acct = q.dst AND y.p = q.p""")
def n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.period_node_features(event_transfers(spark, sf_dir))
    return rounded(made, 6, *[c for c in made.columns if c.endswith(("weight", "asymmetry", "through"))])


@query("n7_pair_history", f"""WITH {EVENT_TX} SELECT tx_id, (SELECT count(*) FROM tx b WHERE b.src = a.src AND b.dst = a.dst AND b.t < a.t // 86400 * 86400) AS prior_pair_tx,
CASE WHEN EXISTS (SELECT 1 FROM tx b WHERE b.src = a.dst AND b.dst = a.src AND b.t < a.t // 86400 * 86400) THEN 1 ELSE 0 END AS reverse_edge_exists FROM tx a""")
def n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pair_history(event_transfers(spark, sf_dir))


@query("n7_closes_cycle", f"""WITH RECURSIVE {EVENT_TX}, q AS (SELECT *, t // 86400 * 86400 AS p FROM tx), f AS (SELECT src, dst, min(p) AS first FROM q GROUP BY src, dst),
e AS (SELECT d.p, src, dst FROM f JOIN (SELECT DISTINCT p FROM q) d ON first < d.p),
reach AS (SELECT p, src, dst FROM e UNION SELECT r.p, r.src, e.dst FROM reach r JOIN e ON r.p = e.p AND r.dst = e.src),
c AS (SELECT DISTINCT a.p, a.src, a.dst FROM reach a JOIN reach b ON a.p = b.p AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst), m AS (SELECT DISTINCT p, src FROM c)
SELECT tx_id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.p = q.p AND c.src = q.src AND c.dst = q.dst) OR src = dst AND EXISTS (SELECT 1 FROM m WHERE m.p = q.p AND m.src = q.src) THEN 1 ELSE 0 END AS closes_cycle FROM q""")
def n7_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closes_cycle(event_transfers(spark, sf_dir))


def _period_ranks(rounds: int) -> str:
    """PageRank in every snapshot; s holds the accounts of each, z what accounts without payees have."""
    steps = ["s AS (SELECT p, count(*) AS c FROM n GROUP BY p), r0 AS (SELECT p, node, 1.0::DOUBLE / c AS r FROM n JOIN s USING (p))"]
    for k in range(rounds):
        steps.append(f"""z{k} AS MATERIALIZED (SELECT p, sum(r) AS z FROM r{k} JOIN d USING (p, node) WHERE o = 0 GROUP BY p),
g{k} AS MATERIALIZED (SELECT p, e.dst AS node, sum(r / o) AS g FROM e JOIN r{k} USING (p) JOIN d USING (p, node) WHERE node = e.src GROUP BY p, e.dst),
r{k + 1} AS MATERIALIZED (SELECT p, node, 0.15::DOUBLE / c + 0.85::DOUBLE * (coalesce(g, 0) + coalesce(z, 0) / c) AS r FROM n JOIN s USING (p) LEFT JOIN g{k} USING (p, node) LEFT JOIN z{k} USING (p))""")
    return ", ".join(steps)


_NODE_COLUMNS = {
    "in_degree": "i", "out_degree": "o", "in_tx": "it", "out_tx": "ot", "log_in_weight": "ln(1 + iw)", "log_out_weight": "ln(1 + ow)", "degree_asymmetry": "(o - i) / CAST(o + i + 1 AS DOUBLE)",
    "flow_through": "CASE WHEN greatest(iw, ow) > 0 THEN least(iw, ow) / greatest(iw, ow) ELSE 0 END", "reciprocal_partners": "coalesce(rp, 0)", "pagerank": "r * c", "log_scc_size": "ln(coalesce(m, 1))",
    "nbr_out_degree_mean": "coalesce(mo, 0)", "nbr_in_degree_mean": "coalesce(mi, 0)",
}
_ALL_PERIODS = f"""WITH RECURSIVE {EVENT_TX}, q AS (SELECT *, t // 86400 * 86400 AS p FROM tx),
e AS MATERIALIZED (SELECT x.p, src, dst, count(*) AS cnt, sum(amount) AS weight FROM q JOIN (SELECT DISTINCT p FROM q) x ON q.p < x.p GROUP BY x.p, src, dst),
n AS MATERIALIZED (SELECT p, src AS node FROM e UNION SELECT p, dst FROM e),
d AS MATERIALIZED (SELECT p, node, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(it, 0) AS it, coalesce(ot, 0) AS ot, coalesce(iw, 0) AS iw, coalesce(ow, 0) AS ow, rp FROM n
  LEFT JOIN (SELECT p, src AS node, count(*) AS o, sum(cnt) AS ot, sum(weight) AS ow FROM e GROUP BY ALL) USING (p, node)
  LEFT JOIN (SELECT p, dst AS node, count(*) AS i, sum(cnt) AS it, sum(weight) AS iw FROM e GROUP BY ALL) USING (p, node)
  LEFT JOIN (SELECT a.p, a.src AS node, count(*) AS rp FROM e a JOIN e b ON a.p = b.p AND a.src = b.dst AND a.dst = b.src GROUP BY ALL) USING (p, node)),
{_period_ranks(50)},
reach AS (SELECT p, src, dst FROM e UNION SELECT r.p, r.src, e.dst FROM reach r JOIN e ON r.p = e.p AND r.dst = e.src),
mutual AS MATERIALIZED (SELECT DISTINCT a.p, a.src, a.dst FROM reach a JOIN reach b ON a.p = b.p AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
v AS MATERIALIZED (SELECT p, node, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {name}" for name, c in _NODE_COLUMNS.items())} FROM d JOIN r50 USING (p, node) JOIN s USING (p)
  LEFT JOIN (SELECT p, src AS node, count(*) + 1 AS m FROM mutual GROUP BY ALL) USING (p, node)
  LEFT JOIN (SELECT e.p, e.src AS node, avg(d.o) AS mo FROM e JOIN d ON d.p = e.p AND d.node = e.dst GROUP BY ALL) USING (p, node)
  LEFT JOIN (SELECT e.p, e.dst AS node, avg(d.i) AS mi FROM e JOIN d ON d.p = e.p AND d.node = e.src GROUP BY ALL) USING (p, node))
SELECT tx_id, {", ".join(f"coalesce({t}.{name}, 0) AS {end}_{name}" for end, t in (("src", "x"), ("dst", "y")) for name in _NODE_COLUMNS)},
  CASE WHEN q.src <> q.dst AND mutual.p IS NOT NULL OR q.src = q.dst AND x.log_scc_size > 0 THEN 1 ELSE 0 END AS closes_cycle,
  coalesce(pair.cnt, 0) AS prior_pair_tx, CASE WHEN back.p IS NULL THEN 0 ELSE 1 END AS reverse_edge_exists
FROM q LEFT JOIN v x ON x.p = q.p AND x.node = q.src LEFT JOIN v y ON y.p = q.p AND y.node = q.dst LEFT JOIN mutual ON mutual.p = q.p AND mutual.src = q.src AND mutual.dst = q.dst
  LEFT JOIN e pair ON pair.p = q.p AND pair.src = q.src AND pair.dst = q.dst LEFT JOIN e back ON back.p = q.p AND back.src = q.dst AND back.dst = q.src"""
_EXACT_COLUMNS = ("in_degree", "out_degree", "in_tx", "out_tx", "reciprocal_partners")


@query("n8_graph_features", _ALL_PERIODS)
def n8_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.graph_features(event_transfers(spark, sf_dir))
    return rounded(made, 6, *[f"{end}_{c}" for end in ("src", "dst") for c in G.NODE_FEATURES])


@query("n3_all_node_features", f"""{_EDGES}, {_DEGREES}, {_ranks(50)}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS node, count(DISTINCT a.dst) AS c FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT {_MEASURES}, round(r * (SELECT count(*) FROM n), 6) AS pagerank, round(ln(1 + coalesce(m.c, 0)), 6) AS log_scc_size FROM d JOIN r50 ON r50.node = d.node LEFT JOIN m ON m.node = d.node""")
def n3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.all_node_features(_edges(spark, sf_dir)), 6, *[c for c in G.NODE_FEATURES if c not in _EXACT_COLUMNS])


@query("n14_account_bank", f"""WITH {EVENT_TX}, s AS (SELECT src AS account, (tx_id + src) % 7 AS bank, 0 AS turn, tx_id FROM tx UNION ALL SELECT dst, (tx_id + dst) % 5, 1, tx_id FROM tx)
SELECT account, arg_min(bank, struct_pack(turn := turn, tx_id := tx_id)) AS bank FROM s GROUP BY account""")
def n14(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir).withColumns({"src_bank": (F.col("tx_id") + F.col("src")) % 7, "dst_bank": (F.col("tx_id") + F.col("dst")) % 5})
    return G.account_bank(tx)


@query("n13_snapshot_edges", f"""WITH {EVENT_TX}, p AS (SELECT unnest(range(CAST(min(t) // 86400 * 86400 AS BIGINT), CAST(max(t) + 86401 AS BIGINT), 86400)) AS period_start FROM tx),
s AS (SELECT period_start, fmt, src, dst, count(*) AS c, max(t) AS last_t FROM p JOIN tx ON t < period_start GROUP BY ALL)
SELECT period_start, fmt, count(*) AS n_edges, round(sum(ln(1 + c)), 4) AS log_counts, max(last_t) AS last_t, count(*) FILTER (last_t >= period_start - 86400) AS n_recent FROM s GROUP BY ALL""")
def n13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.snapshot_totals(event_transfers(spark, sf_dir)), 4, "log_counts")


@query("n13_one_snapshot", f"""WITH {EVENT_TX}, {_CUT} SELECT fmt, src, dst, round(ln(1 + count(*)), 8) AS log_count, max(t) AS last_t, max(t) >= any_value(c) - 86400 AS recent FROM tx, cut WHERE t < c GROUP BY fmt, src, dst""")
def n13_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    return rounded(G.snapshot_edges(tx, _cut(tx)), 8, "log_count")


@query("n9_ego_network", f"""WITH {EVENT_TX}, u AS (SELECT (min(t) + max(t)) // 2 AS u FROM tx), past AS (SELECT *, (tx_id * 7919) % 1000 AS score FROM tx, u WHERE t < u),
own AS (SELECT * FROM past WHERE src = 3 OR dst = 3 ORDER BY t DESC, tx_id LIMIT 100), near AS (SELECT src AS n FROM own UNION SELECT dst FROM own),
sec AS (SELECT * FROM past WHERE src IN (SELECT n FROM near WHERE n <> 3) OR dst IN (SELECT n FROM near WHERE n <> 3) ORDER BY score DESC, t DESC, tx_id LIMIT (SELECT 100 - count(*) FROM own))
SELECT tx_id, 1 AS hop FROM own UNION ALL SELECT tx_id, 2 FROM sec WHERE tx_id NOT IN (SELECT tx_id FROM own)""")
def n9(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir).withColumn("score", (F.col("tx_id") * 7919) % 1000)
    lo, hi = tx.agg(F.min("t"), F.max("t")).first()
    return G.ego_network(tx, 3, (lo + hi) // 2, limit=100).select("tx_id", "hop")


@query("n16_hop_distances", _ALL + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 0 AS node, 0 AS d UNION SELECT u.b, d + 1 FROM w JOIN u ON w.node = u.a WHERE d < 4) SELECT node, min(d) AS hops FROM w GROUP BY node""")
def n16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hop_distances(_whole(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 4)


@query("a24_homophily", _EDGES + " SELECT round(avg(CASE WHEN src % 3 = 0 AND dst % 3 = 0 OR src % 3 <> 0 AND dst % 3 <> 0 THEN 1 ELSE 0 END), 8) AS homophily FROM e")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return rounded(G.edge_homophily(edges, nodes.withColumn("y", (F.col("node") % 3 == 0).cast("int"))), 8, "homophily")


@query("a25_positive_adjacency", f"""WITH {EVENT_TX}, p AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM tx WHERE label = 1 UNION ALL SELECT dst FROM tx WHERE label = 1) GROUP BY node),
x AS (SELECT label, coalesce(a.k, 0) - label > 0 OR coalesce(b.k, 0) - label > 0 AS hit FROM tx LEFT JOIN p a ON a.node = src LEFT JOIN p b ON b.node = dst)
SELECT round(avg(CAST(hit AS INTEGER)) FILTER (label = 1), 8) AS positive_touching_positive, round(avg(CAST(hit AS INTEGER)) FILTER (label <> 1), 8) AS negative_touching_positive FROM x""")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.positive_adjacency(event_transfers(spark, sf_dir)), 8, "positive_touching_positive", "negative_touching_positive")


@query("a26_degree_summary", _EDGES + """, n AS (SELECT DISTINCT src AS node FROM tx UNION SELECT dst FROM tx), d AS (SELECT node, (SELECT count(*) FROM e WHERE src = node) + (SELECT count(*) FROM e WHERE dst = node) AS d FROM n)
SELECT round(avg(CASE WHEN d = 0 THEN 1 ELSE 0 END), 8) AS isolated_fraction, quantile_cont(d, 0.5) AS median_degree, round(quantile_cont(d, 0.99), 6) AS p99_degree, max(d) AS max_degree FROM d""")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_transfers(spark, sf_dir)
    nodes = tx.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return rounded(rounded(G.degree_summary(_edges(spark, sf_dir), nodes), 8, "isolated_fraction"), 6, "p99_degree")


@query("n15_propagation")
def n15(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return G.propagate(G.node_features(edges), edges, ["log_in_weight", "log_out_weight", "flow_through"])
