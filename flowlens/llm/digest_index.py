"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest.  New rows
are reduced to one row a digest (map-side first), anti-joined to the index by
sort-merge, and what the index lacks is appended to it.  The index side of the
join is read bucket by bucket and never shuffled.

Every row of the index bears the name of the batch that brought it.  A batch
that broke off can be added again: rows of its own do not count as earlier ones.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_count, materialize, shuffle_partitions

#: Digests that one bucket should hold (some 100 MB in memory).
BUCKET_ROWS = 1_000_000
_COLUMNS = "digest BINARY, doc_id BIGINT, row BIGINT, batch STRING"


def normalized(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    """The 32 bytes of the SHA-256 of the normalized text's UTF-8."""
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for every row) and digest; stored, so that texts are read once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def classes(rows: DataFrame) -> DataFrame:
    """One row a digest: the rows that have it (n) and the one of the largest doc_id, of repeated ids the last."""
    top = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), top.alias("top")).select("digest", "n", "top.doc_id", "top.row")


@dataclass
class DigestIndex:
    """An index in the folder ``path``; ``buckets`` is fixed when the folder is made."""

    spark: SparkSession
    path: str
    buckets: int = 16

    @property
    def name(self) -> str:
        return f"digest_index_{xxhash.xxh64_hexdigest(self.path)}"

    def table(self) -> DataFrame:
        """The index as a bucketed table; an unused folder is an empty one."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self.spark.table(self.name)

    def missing(self, found: DataFrame, batch: str | None = None) -> DataFrame:
        """The rows of ``found``, one a digest, whose digest no other batch has brought."""
        known = self.table()
        earlier = known if batch is None else known.where(F.col("batch") != batch)
        return found.join(earlier.select("digest").hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append the digests of ``rows`` (doc_id, row, digest) that are new; returns what the batch has added.

        Of equal new texts the row of the largest doc_id enters.  A digest that
        an earlier batch brought stays with that batch's row.  Adding a batch
        again adds only what it lacks.
        """
        new = self.missing(classes(rows).drop("n")).select("digest", "doc_id", "row", F.lit(batch).alias("batch"))
        new.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.table().where(F.col("batch") == batch)

    def compacted(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same index in a new folder with one file a bucket, and other buckets if asked."""
        out = DigestIndex(self.spark, path, buckets or self.buckets)
        rows = self.table().repartition(out.buckets, "digest")
        out.table()
        rows.write.insertInto(out.name)
        self.spark.catalog.refreshTable(out.name)
        return out

    def forget(self) -> None:
        """Drop the table's name from the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(spark: SparkSession, rows: int) -> int:
    """No fewer than the partitions of a shuffle: Spark would shuffle a table of fewer buckets, too."""
    return max(shuffle_partitions(spark), -(-rows // BUCKET_ROWS))


def dedup_batches(docs: DataFrame, path: str, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the digests stay in the index at ``path``.

    The rows are added in ``batches`` ranges of doc_id, the largest ids first,
    so that of equal texts the row with the largest doc_id stays, whichever
    batch the others come in.  Null ids come last and stay only where no other
    row has the text.  Of rows that repeat both id and text one stays.  Null
    texts are empty ones.  An empty table gives an empty result.  Columns other
    than doc_id and text are ignored.

    ``path`` must be unused: ids of an index that holds other tables would stay
    before these.  A digest with many rows is broadcast, its rows stay in place.
    """
    spark = docs.sparkSession
    rows = digested(docs)
    cuts = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("cuts")).first()
    index = DigestIndex(spark, path, buckets_for(spark, cuts["n"]))
    index.table()
    bounds = sorted(set(cuts["cuts"] or []), reverse=True)
    for i, (high, low) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        part = rows
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() & F.lit(low is None))
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        index.add(part, f"batch-{i}")
    known = index.table().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = materialize(sizes.join(known.hint("merge"), "digest"), "digest-classes")
    index.forget()
    found = join_by_count(rows, groups, ["digest"], "group_size")
    if found is None:
        found = rows.join(groups, "digest")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
