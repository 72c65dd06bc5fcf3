"""Stored tables with a manifest, feature cache and score store."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> str:
    """Hash of a table's rows, whatever their order or files: count, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, s, x = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{n}|{s}|{x}".encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def save(df: DataFrame, path: str, **facts: object) -> None:
    """Write parquet and, beside it, a manifest with the content hash and given facts."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/data")
    manifest = json.dumps({"hash": content_hash(stored), **facts}, default=str)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table, if its content still has the manifest's hash."""
    df = spark.read.parquet(f"{path}/data")
    if content_hash(df) != manifest(spark, path)["hash"]:
        raise ValueError(f"{path} was changed after it was written")
    return df


def cached(df: DataFrame, build, root: str, **parameters: object) -> DataFrame:
    """``build(df)``, stored under a key of the input's content and the parameters."""
    spark = df.sparkSession
    key = hashlib.sha256(f"{content_hash(df)}|{json.dumps(parameters, sort_keys=True, default=str)}".encode()).hexdigest()[:16]
    path = f"{root}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_scores(scores: DataFrame, root: str) -> None:
    """tx_id, fold, score by model and seed."""
    scores.write.mode("append").partitionBy("model", "seed").parquet(root)


def load_scores(spark: SparkSession, root: str, model: str, seed: int) -> DataFrame:
    return spark.read.parquet(root).where((F.col("model") == model) & (F.col("seed") == seed))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each model."""
    newest = Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")
