"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder that all executors share.

    Where that is unset, a temporary folder serves a local session; a cluster has no such folder, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: cuts the lineage and survives lost executors. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """What tells versions of files apart: the length and time of each path's files."""
    out = []
    for path in paths:
        fs, at = file_system(spark, path)
        out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]
    return tuple(out)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


#: Tables built in this session: (application, name, stamp of what they are built from) -> path.
_built: dict[tuple, str] = {}


def built_once(spark: SparkSession, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame], order: str | None = None) -> DataFrame:
    """A table that is written to shared storage the first time and read from there while its sources stay the same.

    ``order`` lays the rows out by that column, so that look-ups of a value read few row groups.
    """
    key = (spark.sparkContext.applicationId, name, stamp(spark, *sources))
    path = _built.get(key)
    if path is None or not exists(spark, f"{path}/_SUCCESS"):
        rows, path = build(), shared_path(spark, name)
        (rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows).write.parquet(path)
        fs, at = file_system(spark, path)
        fs.deleteOnExit(at)
        _built[key] = path
    return spark.read.parquet(path)
