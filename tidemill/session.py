"""Spark sessions with the settings that the library's semantics rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; keyword names use __ for dots. On a cluster leave master unset."""
    builder = SparkSession.builder.appName("tidemill")
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("TIDEMILL_DRIVER_MEMORY", "8g"))
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir, read by the cluster's own file system.

    Unset, it is a temporary folder of a local session, as in tests; on a cluster that raises.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


#: Paths that scratch_path has given, for callers that know when they are done with.
MADE: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    MADE.append(path)
    return path
