"""Saved tables of one run, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session whose executors are in the driver's own process may do without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables that this process has saved.
_SAVED: list[str] = []


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Of the driver. Spark removes shuffle files and broadcasts only when the plans that made them are collected."""
    spark.sparkContext._jvm.System.gc()
    release_native(spark)


def release_native(spark: SparkSession) -> str:
    """Give the driver's system what its JVM has freed outside the heap, which the C library keeps for each of some hundred threads else. Result: what the JVM says of it; empty if it has no such command (OpenJDK for Linux has, from 17.0.9 on)."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # Its class is not open to reflection, which py4j uses; the interface is.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(server, args)
    except Py4JError:
        return ""


class Work:
    """Tables of one run: each is written and read back, which cuts its lineage, so that lost executors do no harm. What no later table reads is dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """by: columns whose values have a directory each."""
        path = f"{self.at}/{name}"
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        self.names.add(name)
        _SAVED.append(path)
        release_native(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables, and what their plans have left."""
        for name in names:
            delete(self.spark, f"{self.at}/{name}")
            self.names.discard(name)
            _SAVED.remove(f"{self.at}/{name}")
        if names:
            collect_garbage(self.spark)

    def keep(self, *names: str) -> None:
        """Drop all but these."""
        self.drop(*(self.names - set(names)))


def save(df: DataFrame, name: str) -> DataFrame:
    """A table that stays until `clear`, or as long as the shared folder does."""
    return Work(df.sparkSession, name).save(df, "table")


def clear(spark: SparkSession) -> None:
    """Delete the saved tables; results that were not written anywhere are lost with them."""
    while _SAVED:
        delete(spark, _SAVED.pop())
