"""Durable intermediate tables that survive the loss of executors.

Intermediate results are written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``, so every executor and the driver can read
them again.  Without that setting a folder of this machine is chosen, but only
if the executors are threads of this process; on a cluster it is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "corpusmill-checkpoints")
    return f"{root.rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}"


def _path_and_files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder below the scratch folder that goes when the application ends."""
    base = scratch_dir(spark)
    path, files = _path_and_files(spark, base)
    files.deleteOnExit(path)
    return f"{base}/{name}"


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder inside one file system."""
    old, files = _path_and_files(spark, source)
    new, _ = _path_and_files(spark, target)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return the reread table.

    The lineage is cut, so a lost executor costs a reread and not a recomputation.
    The folder is removed when the application ends, or before by :func:`remove`.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.scratch_folder = folder
    return out


def remove(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize` that nothing will read again."""
    for table in tables:
        folder = getattr(table, "scratch_folder", None)
        if folder:
            path, files = _path_and_files(table.sparkSession, folder)
            files.delete(path, True)
