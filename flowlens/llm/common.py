"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import clear_scratch, materialize, scratch_path, scratch_root  # noqa: F401

#: A side is broadcast only when its counted rows stay within this bound.
BROADCAST_ROWS = 100_000
#: Rows of one key from which it counts as hot, at least.
HOT_ROWS = 5_000
#: Copies of a small side that is joined by key when it exceeds the bound.
JOIN_SALTS = 16


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if a small file leaves it fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def null_key(col: Column) -> Column:
    """A non-null join key that keeps null apart from every string."""
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), text))


def join_by_count(big: DataFrame, classes: DataFrame, on: list[str], n: str = "n") -> DataFrame | None:
    """Inner join of a stored table to ``classes``, one row a key, with ``n`` the rows of ``big`` that it has.

    Keys with many rows are broadcast and their rows stay where they are, the
    others are shuffled.  "Many" rises with the table, so that there are never
    more than ``BROADCAST_ROWS`` such keys and no other key gathers many rows.
    None if there are no classes.
    """
    most, total = classes.agg(F.max(n), F.sum(n)).first()
    if most is None:
        return None
    bar = max(HOT_ROWS, total // BROADCAST_ROWS)
    if most <= bar:
        return big.join(classes, on)
    hot = classes.where(F.col(n) > bar)
    near = big.join(F.broadcast(hot), on)
    far = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(classes.where(F.col(n) <= bar), on)
    return near.unionByName(far)


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a table of few wide keys to a large one without gathering a hot key.

    ``small`` is counted: within ``max_rows`` it is broadcast, beyond it every
    row of ``small`` is repeated ``JOIN_SALTS`` times and the rows of ``big``
    are spread over the copies.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(JOIN_SALTS)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(JOIN_SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
