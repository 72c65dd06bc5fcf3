"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_kept: list[DataFrame | RDD] = []
#: Rows as Python left them, on disk where memory ends.
HELD = StorageLevel.MEMORY_AND_DISK_DESER


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="flowlens-ship-")) / "flowlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine, as in local
    tests, a folder is made up; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path below the shared folder."""
    return f"{scratch_root(spark)}/flowlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(rows: DataFrame | RDD) -> DataFrame | RDD:
    """``rows`` held by the executors, in the parts in which they are dealt."""
    _kept.append(rows.persist(HELD))
    return rows


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables written by :func:`materialize` and held by :func:`keep` (call after results are stored)."""
    while _kept:
        _kept.pop().unpersist()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/flowlens")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
