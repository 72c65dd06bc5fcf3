"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed per document, then reduced to distinct values.  A
trie over the fingerprints is joined with itself: pairs of nodes are traversed
together, the bits in which their paths differ are added up, and a pair is
dropped once they exceed the Hamming budget.  Small tries are traversed many at
a time, level by level, by array operations.

To spread that over executors, the 64 bits are cut into ``budget + d`` blocks:
two fingerprints within the budget agree in at least ``d`` blocks, so each
choice of ``d`` blocks, with their bits, names a subtrie task, and every link
is found in one of them.  A subtrie emits links that span its components, never
all pairs of a dense group.  Components are joined up by large-star/small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, materialize, shuffle_partitions, spread

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Nodes with up to this many fingerprints a side are compared directly.
LEAF = 32
#: Fingerprints that a subtrie task has on average, at most, before keys get finer.
SUBTRIE = 64
#: Rows of one subtrie above which it is cut by further blocks.
HOT_SUBTRIE = 4096
#: Fingerprints of a subtrie that is traversed together with others, and of such subtries at a time.
SMALL, TOGETHER = 128, 20_000
#: Links (16 bytes each) that one task may join up to components; beyond, they are joined up in rounds.
ONE_TASK = 1_000_000


# --- fingerprints ---------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; 0 without words.

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    shingles keep repeats; fewer words form one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = [joined[a:b] for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in spans], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        block = h[at : at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = np.array([fingerprint(t) for t in batch["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInPandas(_fingerprints, "doc_id long, fp long")


# --- trie self-join -------------------------------------------------------


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def trie_links(values: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Index pairs that span the components of "at most ``budget`` bits differ".

    ``values`` are sorted distinct uint64, so every trie node is a range of
    them.  A stack holds node pairs (range, range, bit, differing bits).  A pair
    is pruned when its differing bits exceed the budget; when the bits left
    cannot exceed it, all of both nodes link at once; small nodes are compared
    directly.
    """
    n = len(values)
    parent = np.arange(n)
    links: list[tuple[int, int]] = []

    def unite(i: int, j: int) -> None:
        a, b = _find(parent, i), _find(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((i, j))

    def middle(lo: int, hi: int, bit: int) -> int:
        mask = np.uint64(1) << np.uint64(bit)
        base = (values[lo] >> np.uint64(bit + 1)) << np.uint64(bit + 1)
        return lo + int(np.searchsorted(values[lo:hi], base | mask))

    stack = [(0, n, 0, n, 63, 0)] if n > 1 else []
    while stack:
        a, b, c, d, bit, acc = stack.pop()
        if b - a == 0 or d - c == 0 or acc > budget or (a == c and b - a == 1):
            continue
        if acc + bit + 1 <= budget:
            for i in range(a + 1, b):
                unite(a, i)
            for j in range(c, d):
                unite(a, j)
            continue
        if (b - a) <= LEAF and (d - c) <= LEAF:
            x = np.bitwise_count(values[a:b, None] ^ values[None, c:d]) <= budget
            for i, j in zip(*np.nonzero(x), strict=True):
                if a + i != c + j:
                    unite(a + int(i), c + int(j))
            continue
        m = middle(a, b, bit)
        if a == c:
            stack += [(a, m, a, m, bit - 1, acc), (m, b, m, b, bit - 1, acc), (a, m, m, b, bit - 1, acc + 1)]
            continue
        o = middle(c, d, bit)
        stack += [(a, m, c, o, bit - 1, acc), (m, b, o, d, bit - 1, acc), (a, m, o, d, bit - 1, acc + 1), (m, b, c, o, bit - 1, acc + 1)]
    return links


def block_masks(depth: int, budget: int = BUDGET) -> list[int]:
    """Bit masks of every choice of ``depth`` blocks out of ``budget + depth``."""
    n = budget + depth
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n)]
    return [sum(chosen) for chosen in combinations(blocks, depth)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _highest_bits(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.log2(np.maximum(high, 1)), np.log2(np.maximum(low, 1))).astype(np.int64)


class Tries:
    """Path-compressed tries over groups of sorted distinct values.

    Node i < n is the leaf of value i; node n + i branches at the highest bit in
    which values i - 1 and i of one group differ.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        n = len(values)
        bits = np.zeros(n, np.int64)
        bits[1:] = _highest_bits(values[1:] ^ values[:-1])
        bits[starts] = 64
        left, right, roots, path = [0] * n, [0] * n, [], []
        for i, bit in enumerate([*bits.tolist()[1:], 64], 1):
            last = i - 1
            if bit == 64:
                if path:
                    roots.append(n + path[0])
                path = []
                continue
            while path and bits[path[-1]] < bit:
                last = n + path.pop()
            left[i], right[i] = last, i
            if path:
                right[path[-1]] = n + i
            path.append(i)
        own = np.arange(n)
        self.values, self.roots = values, np.array(roots, np.int64)
        self.bit = np.concatenate([np.full(n, -1), bits])
        self.left, self.right = np.concatenate([own, left]), np.concatenate([own, right])
        self.prefix = np.concatenate([values, values])  # of a value below the node

    def pairs(self, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the value pairs within the budget."""
        n, x = len(self.values), self.roots
        y, found = x, []
        while len(x):
            same = x == y
            whole = x[same]
            a, b = self.left[whole], self.right[whole]
            inner = np.concatenate([a[a >= n], b[b >= n]])
            p, q = x[~same], y[~same]
            swap = self.bit[p] < self.bit[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            differ = np.bitwise_count((self.prefix[p] ^ self.prefix[q]) >> (self.bit[p] + 1).astype(np.uint64))
            p, q = p[differ <= budget], q[differ <= budget]
            leaf = p < n
            found.append((p[leaf], q[leaf]))
            p, q = p[~leaf], q[~leaf]
            x = np.concatenate([inner, a, self.left[p], self.right[p]])
            y = np.concatenate([inner, b, q, q])
        return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """A part of the links (a, b) over 0..n-1 that spans the same components."""
    parent = np.arange(n)
    kept: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = _find(parent, i), _find(parent, j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept[0].append(i)
            kept[1].append(j)
    return kept


def _group_links(keys: np.ndarray, values: np.ndarray, budget: int) -> pa.RecordBatch:
    """Spanning links of each group of values with equal keys."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[fresh], values[fresh]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    small = (sizes > 1) & (sizes <= SMALL)
    chosen, total = np.flatnonzero(small), np.cumsum(sizes[small])
    for part in np.split(chosen, np.searchsorted(total, np.arange(TOGETHER, total[-1] if len(total) else 0, TOGETHER))):
        if len(part):
            own = values[np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in part.tolist()])]
            begins = np.cumsum(np.concatenate([[0], sizes[part][:-1]]))
            i, j = _spanning(*Tries(own, begins).pairs(budget), len(own))
            out.append((own[i], own[j]))
    for g in np.flatnonzero(sizes > SMALL).tolist():
        own = values[starts[g] : starts[g] + sizes[g]]
        links = trie_links(own, budget)
        out.append((own[[i for i, _ in links]], own[[j for _, j in links]]))
    a, b = (np.concatenate([o[k] for o in out] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _subtries(budget: int):
    """Rows come sorted by key; a group that a batch cuts is held back for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            values = np.concatenate([values, batch.column("fp").to_numpy().view(np.uint64)])
            if len(keys) >= TOGETHER:
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield _group_links(keys[:last], values[:last], budget)
                    keys, values = keys[last:], values[last:]
        if len(keys):
            yield _group_links(keys, values, budget)

    return run


def _keyed(rows: DataFrame, masks: list[int], *outer: str) -> DataFrame:
    """fp and a hash of each choice of blocks with their bits (within the ``outer`` key)."""
    choices = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(_signed(x)).cast("long").alias("x")) for i, x in enumerate(masks)])
    chosen = rows.withColumn("c", F.explode(choices))
    return chosen.select("fp", F.xxhash64(*outer, "c.m", F.col("fp").bitwiseAND(F.col("c.x"))).alias("key"))


def hamming_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` within the budget.

    The number of distinct fingerprints sets how fine the subtrie keys are; every
    depth is exact.  A hot key is cut again by the blocks of the next depth.
    Keys that share a hash share a subtrie.
    """
    n = distinct.count()
    depth = 1
    while depth < 3 and n / 2 ** (64 * depth / (budget + depth)) > SUBTRIE:
        depth += 1
    keyed = _keyed(distinct, block_masks(depth, budget))
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > HOT_SUBTRIE).select("key"), "simhash-hot")
    if hot.limit(1).count():
        finer = _keyed(keyed.join(hot, "key", "left_semi"), block_masks(depth + 1, budget), "key")
        keyed = keyed.join(hot, "key", "left_anti").select("fp", "key").unionByName(finer)
    dealt = keyed.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_subtries(budget), "a long, b long")


# --- components -----------------------------------------------------------


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a partition as u and the least node that they join it to."""
    read = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([r[k] for r in read] or [np.empty(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = _find(parent, i), _find(parent, j)
        parent[max(x, y)] = min(x, y)
    root = np.array([_find(parent, i) for i in range(len(nodes))], np.int64)
    inner = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], ["u", "v"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that is reachable over ``links(a, b)``, of nodes other than roots.

    The links of each partition are first contracted to its components.  Up to
    ``ONE_TASK`` links are then joined up by one task; more of them by rounds
    of large-star and small-star until they stay as they are, each a few
    grouped passes that end in a stored table.
    """
    both_ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(both_ends.mapInArrow(_contract, "u long, v long"), "links")
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return materialize(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "links").select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = edges.distinct()
    before = state(edges)
    for _ in range(max_rounds):
        both = materialize(edges.union(edges.select("v", "u")), "links-both")
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "links-least")
        large = join_by_count(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "links-low")
        small = join_by_count(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that is reachable over links of at most
    ``budget`` differing bits, the row's own included.  Null and wordless texts
    have fingerprint 0 and link like any other.  Rows with a null doc_id take
    part and carry links; they never name a component unless all of it is null.
    Repeated rows are all kept.  An empty table gives an empty result.  Columns
    other than doc_id and text are ignored.
    """
    prints = materialize(fingerprints(docs), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = components(hamming_links(classes.select("fp"), budget))
    rooted = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "simhash-roots")
    known = join_by_count(rooted, named, ["root"], "size")
    if known is None:
        return prints.withColumn("component_id", F.col("doc_id"))
    known = materialize(known.select("fp", "n", "component_id"), "simhash-named")
    return join_by_count(prints, known, ["fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id.

    Rows with a null doc_id are kept.  Of rows that repeat that doc_id the one
    with the least hash of all columns stays.
    """
    marks = near_duplicates(docs)
    kept = materialize(marks.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count(), "simhash-kept")
    named = docs.where(F.col("doc_id").isNotNull())
    left = named.join(kept.where("count = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("count > 1").limit(1).count():
        row = [F.col(f"`{c}`") for c in docs.columns]
        again = named.join(kept.where("count > 1").select("doc_id"), "doc_id", "left_semi")
        one = again.groupBy("doc_id").agg(F.min_by(F.struct(*row), F.xxhash64(*row)).alias("__row")).select("__row.*")
        left = left.unionByName(one.select(*docs.columns))
    return left.unionByName(docs.where(F.col("doc_id").isNull()))
