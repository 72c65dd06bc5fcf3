"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded
hash.  Pass two shuffles every bucket (Fisher-Yates, Spark's ``shuffle``
expression) and numbers its records.  Bucket offsets turn bucket positions into
one global random order, which is dealt over the shards in turn, so shard sizes
differ by one row at most and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, shuffle_partitions

#: Bytes that one bucket may hold while it is shuffled in memory.
BUCKET_BYTES = 32 << 20
#: Buckets at least; their number depends on the rows alone, and so does the order.
BUCKETS = 64
#: Bytes of a row besides its text.
ROW_BYTES = 64


def record_bytes(df: DataFrame) -> Column:
    """Bytes of a row in memory, its text included if it has one."""
    return F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES if "text" in df.columns else F.lit(ROW_BYTES)


def external_shuffle(
    df: DataFrame, n_shards: int, seed: int = 17, row_bytes: Column | None = None, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long) to every row of ``df``.

    ``row_bytes`` estimates what a row takes in memory (64 bytes by default).
    Bucket number depends on the whole row and the seed.  An empty table stays
    empty; null columns hash like any other value; repeated rows are all kept
    and may share a bucket.  Columns named ``shard`` or ``slot`` are replaced.
    ``df`` is read three times, so pass a stored table.
    """
    base = df.drop("shard", "slot")
    columns = base.columns
    weight = F.lit(ROW_BYTES) if row_bytes is None else row_bytes
    total = base.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("b")).first()["b"]
    n = max(BUCKETS, -(-int(total) // bucket_bytes))
    placed = base.select(
        F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns]), F.lit(n)).cast("int").alias("__bucket"),
        F.struct(
            F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in columns]).alias("__order"),
            F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"),
        ).alias("__item"),
    )
    counts = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    buckets = (
        placed.repartition(n, "__bucket")
        .sortWithinPartitions("__bucket", "__item.__order")
        .groupBy("__bucket")
        .agg(F.collect_list("__item").alias("__items"))
    )
    dealt = buckets.select("__bucket", F.posexplode(F.shuffle("__items", F.lit(seed))).alias("__pos", "__item"))
    place = F.col("__base") + F.col("__pos")
    return join_small(dealt, offsets, ["__bucket"]).select(
        "__item.__row.*",
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(place / F.lit(n_shards)).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 17) -> None:
    """Write the rows of ``df`` into ``n_shards`` folders, each in slot order.

    A shard takes several files, each a contiguous run of slots.  Null texts
    weigh as empty ones and stay null; repeated rows are all written; an empty
    table writes no file of rows; other columns are kept, and ``shard`` and
    ``slot`` replace columns of those names.
    """
    out = external_shuffle(df, n_shards, seed, record_bytes(df))
    files = max(1, shuffle_partitions(df.sparkSession))
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """Shard, slot and digest of every document; size counts UTF-8 bytes plus 1.

    Whole documents are scattered and shuffled; the digest is that of the
    records that come out.  ``docs`` is read three times, so pass a stored table.
    """
    records = docs.select("doc_id", "text")
    out = external_shuffle(records, n_shards, seed, record_bytes(records))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "shard",
        "slot",
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
