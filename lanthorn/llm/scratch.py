"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on one machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
    env["OMP_NUM_THREADS"] = env["OPENBLAS_NUM_THREADS"] = "1"
    # arrays above 4 MB go back to the system when they are freed
    env["ARROW_DEFAULT_MEMORY_POOL"] = "system"
    env["MALLOC_MMAP_THRESHOLD_"], env["MALLOC_TRIM_THRESHOLD_"], env["MALLOC_ARENA_MAX"] = "4194304", "16777216", "2"


def trim(spark: SparkSession) -> str:
    """Gives the system back what the allocators of the driver's Python and JVM hold free, some hundreds of MB after many queries.

    Returns what the JVM says of it, or nothing where it has no such command.
    """
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        of = jvm.java.lang.Class.forName
        kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]):
            kinds[i] = of(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values))  # the server's own class is not open
    except Exception:  # another JVM
        return ""


class Scratch:
    """Written tables of one operator. They outlive executors, and go when the driver ends or when :meth:`drop` is called."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ready(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._remove, self.base)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the session may be gone
            pass

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing reads any more."""
        self._remove(df._scratch_path)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of finished queries, which else stay until the driver happens to collect garbage, and trims the driver's memory."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim(self.spark)


def fixed_point(step: Callable[[DataFrame], tuple[DataFrame, bool]], start: DataFrame, most: int = 100) -> DataFrame:
    state = start
    for _ in range(most):
        state, done = step(state)
        if done:
            return state
    raise RuntimeError(f"no fixed point after {most} rounds")
