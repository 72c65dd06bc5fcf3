"""Mixing sources to target weights by entropy balancing.

Every document i gets a rate r_i that minimises the relative entropy
sum_i size_i * (r_i log r_i - r_i + 1), so a word is the unit of mass, subject
to one word constraint a source: sum of size_i * r_i over the source equals its
target.  The optimum is an exponential tilt r_i = exp(lambda_source); the convex
dual in lambda separates by source, and Newton's method solves all of them in
parallel on the distributed table of source totals.  Rates become whole copies
by stratified systematic rounding and a greedy repair of what is left over.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_count, join_small, materialize, null_key

#: Words are the maximal runs of characters other than these white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one stratum of the rounding may hold, about.
STRATUM_ROWS = 20_000
#: Strata of a source, at least.
STRATA = 64
#: Further copies of equal rows that one task writes.
LOT = 1000
#: Newton steps; each gains at least one in lambda, then digits double.
NEWTON_STEPS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """Target words of each source from ``totals(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words; no target exceeds ``limit`` times its source.
    The excess is reshared by weight: the fixed point is the water level theta
    with sum of min(limit * size, weight * theta) equal to the whole.
    ``totals`` has a row a source, so its windows stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = share * F.sum("source_size").over(all_rows)
    theta = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("theta", theta)
    fits = F.when(F.col("theta") * F.col("weight") <= F.col("cap"), F.struct("cap", "theta"))
    level = F.min(F.when(fits.isNotNull(), F.struct((F.col("cap") / F.col("weight")).alias("r"), "theta"))).over(all_rows)
    return levelled.withColumn("level", level).select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level.theta"), F.col("cap"))).cast("double").alias("target"),
    )


def newton_rate(size: Column, target: Column, limit: float = 2.0) -> Column:
    """exp(lambda) at the root of the dual gradient size * exp(lambda) - target.

    Newton's step is -(gradient / Hessian) = target / (size * exp(lambda)) - 1,
    damped to at most 1 so that it never overshoots far.
    """
    step = lambda lam: F.least(target / (size * F.exp(lam)) - 1.0, F.lit(1.0))
    lam = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), lambda acc, _: acc + step(acc))
    return F.when((size <= 0) | (target <= 0), F.lit(0.0)).otherwise(F.least(F.exp(lam), F.lit(limit)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: int = 2, seed: int = 29) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every document.

    Null texts and empty texts have size 0 and get no copies (rate 0).  A null
    source is a source of its own.  Repeated rows are numbered and rounded one
    by one.  No document gets more than ``limit`` copies.  Reruns agree, however
    the rows are dealt: strata and order come from seeded hashes of the row and
    its number among equal rows.  An empty table gives an empty result; columns
    other than doc_id, text and source are ignored.
    """
    return _mixed(docs, weights, share, limit, seed).drop("__h")


def repeat_by_mix(docs: DataFrame, seed: int = 29) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, columns as they are.

    Rows that are equal in all columns are interchangeable: together they come
    as often as the mix takes them together.  ``docs`` is read twice or more,
    so pass a stored table; its columns must be hashable (no maps).
    """
    row = [F.col(f"`{c}`") for c in docs.columns]
    keys = [F.xxhash64(F.lit(seed), *row).alias("__k1"), F.xxhash64(F.lit(~seed), *row).alias("__k2")]
    keyed = docs.select(F.struct(*row).alias("__row"), *keys)  # so that no column's name clashes
    taken = materialize(
        _mixed(docs.select("doc_id", "source", "text", *keys), (5.0, 2.0, 1.0), 1.5, 2, seed, ["__k1", "__k2"])
        .groupBy("__k1", "__k2").agg(F.count("*").alias("__m"), F.sum("copies").alias("__c")).where("__c > 0"),
        "mix-taken",
    )
    joined = join_by_count(keyed, taken, ["__k1", "__k2"], "__m")
    if joined is None:
        return docs.limit(0)
    each = F.floor(F.col("__c") / F.col("__m")).cast("int")
    whole = joined.where(each > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), each)))
    if not taken.where("__m > 1").limit(1).count():
        return whole.select("__row.*")
    over = (F.col("__c") % F.col("__m")).cast("int")
    one = joined.where((F.col("__m") > 1) & (over > 0)).dropDuplicates(["__k1", "__k2"])
    lots = one.withColumn("__g", F.explode(F.sequence(F.lit(0), F.floor((over - 1) / LOT).cast("int")))).repartition("__k1", "__k2", "__g")
    rest = lots.withColumn("__i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LOT), over - F.col("__g") * LOT))))
    return whole.select("__row.*").unionByName(rest.select("__row.*"))


def _numbered(sized: DataFrame) -> DataFrame:
    """Rows with ``__u``, a hash of ``__h`` and the row's number among those that share it.

    Repeated rows are numbered within each part of the stored table and the
    parts' counts are added up, so no group of equal rows is gathered.
    """
    again = materialize(sized.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1"), "mix-again")
    if not again.limit(1).count():
        return sized.withColumn("__u", F.xxhash64("__h", F.lit(0).cast("long"))).drop("__part")
    marked = join_small(sized, again, ["__h"], "left")
    counts = marked.where("__n is not null").groupBy("__h", "__part").count()
    before = Window.partitionBy("__h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__h", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__h", "__part").orderBy("size")
    many = marked.where("__n is not null").withColumn("__i", F.row_number().over(within) - 1).join(bases, ["__h", "__part"])
    number = (F.col("__base") + F.col("__i")).cast("long")
    once = marked.where("__n is null").withColumn("__u", F.xxhash64("__h", F.lit(0).cast("long")))
    return once.drop("__part", "__n").unionByName(many.withColumn("__u", F.xxhash64("__h", number)).drop("__part", "__n", "__i", "__base"))


def _mixed(
    docs: DataFrame, weights: tuple[float, ...], share: float, limit: int, seed: int, carried: list[str] | None = None
) -> DataFrame:
    carried = carried or []
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            null_key(F.col("source")).alias("__key"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("__h"),
            F.spark_partition_id().alias("__part"),
            *carried,
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source", "__key").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, float(limit))
    rates = materialize(
        targets.withColumn("rate", newton_rate(F.col("source_size"), F.col("target"), float(limit))).withColumn(
            "__key", null_key(F.col("source"))
        ).drop("source"),
        "mix-rates",
    )
    rows = sized.count()
    strata = max(STRATA, -(-rows // STRATUM_ROWS))
    rated = join_small(_numbered(sized), rates, ["__key"]).withColumn("__s", F.pmod(F.col("__u"), F.lit(strata)))
    within = Window.partitionBy("__key", "__s").orderBy(F.desc("size"), "__u", "doc_id")
    shift = (F.col("__s") + 0.5) / F.lit(float(strata))
    running = lambda i: F.floor(i * F.col("rate") + shift)
    rounded = rated.withColumn("__i", F.row_number().over(within)).withColumn(
        "copies",
        F.when(F.col("size") == 0, F.lit(0)).otherwise(
            F.least(running(F.col("__i")) - running(F.col("__i") - 1), F.lit(limit))
        ).cast("long"),
    )
    rounded = materialize(rounded.drop("__i", "__s"), "mix-rounded")
    rounded = rounded.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    repaired = join_small(rounded, _repairs(rounded, rates, limit), ["__key", "__id", "__u"], "left")
    return repaired.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "__h", *carried,
        (F.col("copies") + F.coalesce(F.col("__delta"), F.lit(0))).alias("copies"),
    )


def _repairs(rounded: DataFrame, rates: DataFrame, limit: int) -> DataFrame:
    """A few copies more or less, largest documents first, that bring each source to its target.

    Candidates are up to 16 documents of every power of two in size, found by a
    map-side minimum; the fold over them is bounded by that, whatever the
    source holds.
    """
    octave = F.floor(F.log2("size")).cast("int")
    pick = (
        rounded.where("size > 0")
        .groupBy("__key", octave.alias("__o"), F.pmod(F.col("__u"), F.lit(16)).alias("__b"))
        .agg(F.min(F.struct("__u", "__id", "size", "copies")).alias("c"))
        .groupBy("__key")
        .agg(
            F.reverse(F.array_sort(F.collect_list(F.struct("c.size", "c.__u", "c.__id", "c.copies")))).alias("__cand")
        )
    )
    left = rounded.groupBy("__key").agg(F.sum(F.col("size") * F.col("copies")).alias("__taken"))
    state = left.join(rates, "__key").join(pick, "__key")
    start = F.struct(
        (F.col("target") - F.col("__taken")).cast("double").alias("resid"),
        F.array().cast("array<struct<id:bigint,h:bigint,delta:bigint>>").alias("picks"),
    )

    def fold(acc: Column, x: Column) -> Column:
        wanted = F.round(acc["resid"] / x["size"]).cast("long")
        delta = F.greatest(-x["copies"], F.least(F.lit(limit).cast("long") - x["copies"], wanted))
        return F.struct(
            (acc["resid"] - delta * x["size"]).alias("resid"),
            F.when(delta == 0, acc["picks"]).otherwise(
                F.concat(
                    acc["picks"],
                    F.array(F.struct(x["__id"].alias("id"), x["__u"].alias("h"), delta.alias("delta"))),
                )
            ).alias("picks"),
        )

    picked = state.select("__key", F.explode(F.aggregate("__cand", start, fold)["picks"]).alias("p"))
    return picked.select("__key", F.col("p.id").alias("__id"), F.col("p.h").alias("__u"), F.col("p.delta").alias("__delta"))
