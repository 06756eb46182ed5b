"""Helpers that the training-data operators share: scratch tables and shared files."""

from __future__ import annotations

import contextlib

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither repeat its work nor depend on its executors."""
    spark = df.sparkSession
    ease(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow file system and path of a URI, for range reads and streams on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attempt() -> tuple[int, str]:
    """Partition number and a name that no other attempt of any task has."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return t.partitionId(), f"{t.partitionId():06d}-{t.taskAttemptId()}"


def trim() -> None:
    """Gives freed memory of a Python worker back, so that workers that wait between tasks hold little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ease(spark: SparkSession, most: float = 0.5) -> None:
    """Gives freed memory of the driver's JVM back, between jobs: of its heap, if that has grown past `most` of the limit,
    and what malloc keeps for its several hundred threads. A heap grows sooner than it collects, and broadcasts that no plan
    needs stay until it does."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > most * runtime.maxMemory():
        jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # JVMs before 17.0.9 and other C libraries have no such call
        trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """The JVM's command System.trim_native_heap; what it says."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class

    def array(kind, *values):
        out = new(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    kinds = array(of, *map(of.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    call = of.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not open
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))
