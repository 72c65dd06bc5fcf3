"""Connected and strongly connected components of account graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Edges of a graph that one task takes as a whole (some 100 MB); larger ones go by rounds over all tasks.
ONE_TASK = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component: the smallest account reachable over undirected edges."""
    links = materialize(both_ways(edges).where("node <> other").distinct(), "cc-links")
    alone = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = materialize(alone.withColumn("component", F.col("node")), "cc")
    for _ in range(max_rounds):
        near = links.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("least"))
        # the label of one's label halves the length of chains
        grand = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        after = labels.join(near, "node", "left").join(grand, "component", "left").select(
            "node", F.least("component", "least", "jump").alias("component"), F.col("component").alias("old")
        )
        after = materialize(after, "cc")
        moved = after.where("component <> old").limit(1).count()
        labels = after.drop("old")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def strongly_connected(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node, scc (a member that names it), scc_size.

    Forward-backward colouring: accounts without incoming or outgoing edges are
    trimmed; the largest account id spreads forward as colour; what reaches a
    colour's root backwards within the colour is one component and leaves.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    done = nodes.select("node", F.col("node").alias("scc")).limit(0)
    for _ in range(max_rounds):
        while True:
            inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            trimmed = materialize(inner.select("src", "dst"), "scc-edges")
            same = trimmed.count() == left.count()
            left = trimmed
            if same:
                break
        if left.isEmpty():
            break
        live = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = _spread(live.withColumn("c", F.col("node")), left)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("c").alias(end + "_c"))
        same_colour = materialize(left.join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c").select("src", "dst"), "scc-colour")
        roots = colour.withColumn("c", F.when(F.col("node") == F.col("c"), F.col("c")))
        back = _spread(roots, same_colour.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = materialize(back.where("c is not null").select("node", F.col("c").alias("scc")), "scc-found")
        done = done.union(found)
        gone = found.select(F.col("node").alias("src"))
        left = materialize(left.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"), "scc-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    full = nodes.join(done, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))
    return full.join(full.groupBy("scc").agg(F.count("*").alias("scc_size")), "scc")


def _spread(start: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """The largest non-null ``c`` that reaches each node along the links."""
    state = materialize(start, "spread")
    for _ in range(max_rounds):
        got = links.join(state.where("c is not null").select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("g"))
        after = materialize(state.join(got, "node", "left").select("node", F.greatest("c", "g").alias("c"), F.col("c").alias("old")), "spread")
        moved = after.where(~F.col("c").eqNullSafe(F.col("old"))).limit(1).count()
        state = after.drop("old")
        if not moved:
            return state
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def strong_members(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A member of its strongly connected component for each of ``n`` nodes: depth first, without recursion."""
    order = np.argsort(src, kind="stable")
    after = dst[order].tolist()
    start = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, low, seen, out = start[:n], [0] * n, [0] * n, [-1] * n
    count, held = 0, []
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                held.append(v)
            if at[v] < start[v + 1]:
                w = after[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif out[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if low[v] == seen[v]:
                while out[v] < 0:
                    out[held.pop()] = v
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
    return np.array(out, np.int64)


def _strong_group(edges: pd.DataFrame) -> pd.DataFrame:
    names, codes = np.unique(np.concatenate([edges["src"], edges["dst"]]), return_inverse=True)
    member = strong_members(len(names), codes[: len(edges)], codes[len(edges) :])
    found = pd.DataFrame({"lo": edges["lo"].iloc[0], "node": names, "name": names[member]})
    return found[found.groupby("name")["node"].transform("size") > 1]


def strong_groups(edges: DataFrame) -> DataFrame:
    """lo, node, name (a member): components of more than one account in many graphs at once, told apart by ``lo``.

    ``edges``: lo, src, dst, a stored table.  Graphs of up to ``ONE_TASK`` edges
    take a task each; the others are solved together by rounds.
    """
    kind = edges.schema["src"].dataType.simpleString()
    sizes = edges.groupBy("lo").count()
    large = [r["lo"] for r in sizes.where(F.col("count") > ONE_TASK).collect()]  # a graph a stretch of periods
    small = edges.where(~F.col("lo").isin(large)).groupBy("lo").applyInPandas(_strong_group, f"lo int, node {kind}, name {kind}")
    if not large:
        return small
    tagged = lambda end: F.struct("lo", F.col(end).alias("node")).alias(end)
    found = strongly_connected(edges.where(F.col("lo").isin(large)).select(tagged("src"), tagged("dst"))).where("scc_size > 1")
    return small.unionByName(found.select("node.lo", "node.node", F.col("scc.node").alias("name")))
