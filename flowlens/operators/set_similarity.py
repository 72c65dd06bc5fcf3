"""Pairs of similar sets by prefix, length and position filters.

Members are ordered from the rarest to the most frequent.  Sets whose Jaccard
similarity reaches theta share a member among the first few of each (its
prefix), have sizes within theta of each other, and have enough members left
after the shared one.  Only such pairs are compared; frequent members meet only
in sets that have few rarer ones.  Equal sets are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Sets from which a member counts as hot, at least; at most so many hot members are broadcast.
HOT, HOT_MEMBERS = 5_000, 100_000
#: Tasks in which members meet, at least, and members of the larger side that one takes.
MEETINGS, MEETING_ROWS = 24, 4_000_000
#: Members that are laid side by side to compare pairs, where it is fewer to count meetings.
BESIDE = 50_000_000


def _exploded(sets: DataFrame, key: str) -> DataFrame:
    """key and m, every member of a set once."""
    return sets.select(key, F.explode(F.array_distinct("members")).alias("m")).where("m is not null")


def _with_frequency(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with df; members of many sets are joined where their rows are."""
    most, total = counts.agg(F.max("df"), F.sum("df")).first()
    bar = max(HOT, (total or 0) // HOT_MEMBERS)
    if (most or 0) <= bar:
        return rows.join(counts, "m")
    hot = counts.where(F.col("df") > bar)
    return rows.join(F.broadcast(hot), "m").unionByName(rows.join(F.broadcast(hot.select("m")), "m", "left_anti").join(counts.where(F.col("df") <= bar), "m"))


def _ordered(sets: DataFrame, key: str, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (c, a number; n; members rarest first), and the class c of each key."""
    ranked = _with_frequency(_exploded(sets, key), counts).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "m"))).alias("ranked"))
    named = materialize(ranked.select(key, F.transform("ranked", lambda x: x["m"]).alias("members")).withColumn("c", F.struct(F.xxhash64("members").alias("a"), F.xxhash64(F.lit(1), "members").alias("b"))), "ordered-sets")
    # A class is known by a number: pairs of classes are what most rows are of.
    classes = named.groupBy("c").agg(F.first("members").alias("members")).withColumn("n", F.size("members")).withColumnRenamed("c", "hash")
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "distinct-sets")
    return classes.drop("hash"), named.select(key, F.col("c").alias("hash")).join(classes.select("hash", "c"), "hash").select(key, "c")


def _prefixes(classes: DataFrame, theta: float, name: str) -> DataFrame:
    """m, and place (from 0), size and class of the sets that have it in their prefix."""
    length = F.col("n") - F.ceil(theta * F.col("n") - 1e-9).cast("int") + 1
    return classes.select(F.col("c").alias(name), F.col("n").alias(f"n_{name}"), F.posexplode(F.slice("members", F.lit(1), length))).select(
        F.col("col").alias("m"), F.col("pos").alias(f"at_{name}"), f"n_{name}", name
    )


def _tasks(left: DataFrame, right: DataFrame) -> int:
    """Tasks in which members meet: few, so that most meetings of a pair are added up before the shuffle, more for long tables."""
    rows = [df.agg(F.sum("n")).first()[0] or 0 for df in (left, right)]
    return max(MEETINGS, -(-max(rows) // MEETING_ROWS))


def _met(left: DataFrame, right: DataFrame, tasks: int) -> DataFrame:
    return left.repartition(tasks, "m").join(right.repartition(tasks, "m").hint("shuffle_hash"), "m")


def candidate_classes(left: DataFrame, right: DataFrame, theta: float) -> DataFrame:
    """p and t, pairs of distinct sets that the filters leave."""
    met = _met(_prefixes(left, theta, "p"), _prefixes(right, theta, "t"), _tasks(left, right))
    a, b = F.col("n_p"), F.col("n_t")
    rest: Column = F.least(a - F.col("at_p"), b - F.col("at_t"))  # shared members from this one on, at most
    long_enough = (b >= theta * a - 1e-9) & (a >= theta * b - 1e-9)
    # Where the first shared member of both prefixes stands, all shared ones are still to come.
    first = met.where(long_enough).groupBy("p", "t").agg(F.max(rest).alias("rest"), F.count("*").alias("met"), F.max("n_p").alias("n_p"), F.max("n_t").alias("n_t"))
    # Shared members that are not in both prefixes stand behind the prefix that ends first.
    behind = lambda n: F.ceil(theta * n - 1e-9) - 1
    most = F.least(F.col("rest"), F.col("met") + F.greatest(behind(a), behind(b)))
    return first.where(most >= theta / (1 + theta) * (a + b) - 1e-9).select("p", "t")


def _common(found: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """p, t, n_p, n_t and the members that they share, for each pair of ``found``.

    Few pairs get their members side by side.  For many that would write every
    set once a pair; then members meet, and the meetings are counted.
    """
    side = lambda classes, name, *more: classes.select(F.col("c").alias(name), F.col("n").alias(f"n_{name}"), *more)
    sized = found.join(side(left, "p"), "p").join(side(right, "t"), "t")
    beside = sized.agg(F.sum(F.col("n_p") + F.col("n_t"))).first()[0] or 0
    rows = lambda classes, name: classes.select(F.col("c").alias(name), F.explode("members").alias("m"))
    often = lambda classes: classes.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").cast("double").alias("d"))
    if beside > BESIDE:
        meetings = often(left).join(often(right).withColumnRenamed("d", "e"), "m").agg(F.sum(F.col("d") * F.col("e"))).first()[0] or 0
        if meetings < 4 * beside:
            counted = _met(rows(left, "p"), rows(right, "t"), _tasks(left, right)).groupBy("p", "t").agg(F.count("*").alias("common"))
            return sized.join(counted, ["p", "t"])
    members = lambda classes, name: side(classes, name, F.col("members").alias(f"m_{name}"))
    both = found.join(members(left, "p"), "p").join(members(right, "t"), "t")
    return both.select("p", "t", "n_p", "n_t", F.size(F.array_intersect("m_p", "m_t")).alias("common"))


def similar_pairs(predicted: DataFrame, truth: DataFrame, theta: float) -> DataFrame:
    """pid, tid, jaccard of all pairs of ``predicted`` (pid, members) and ``truth`` (tid, members) with a similarity of ``theta`` or more.

    ``theta`` is above 0.  Null and repeated members don't count; empty sets
    are similar to none.
    """
    if theta <= 0:
        raise ValueError("the similarity is above 0")
    both = _exploded(predicted.withColumnRenamed("pid", "k"), "k").select("m").unionAll(_exploded(truth.withColumnRenamed("tid", "k"), "k").select("m"))
    counts = materialize(both.groupBy("m").agg(F.count("*").alias("df")), "member-counts")
    left, of_p = _ordered(predicted, "pid", counts)
    right, of_t = _ordered(truth, "tid", counts)
    found = materialize(candidate_classes(left, right, theta), "similar-candidates")
    compared = _common(found, left, right)
    scored = compared.select("p", "t", (F.col("common") / (F.col("n_p") + F.col("n_t") - F.col("common"))).alias("jaccard")).where(F.col("jaccard") >= theta)
    return scored.join(of_p.withColumnRenamed("c", "p"), "p").join(of_t.withColumnRenamed("c", "t"), "t").select("pid", "tid", "jaccard")
