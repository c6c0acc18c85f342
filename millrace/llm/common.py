"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, as in tests, a folder of this machine is chosen.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    Unlike cached or locally checkpointed rows, the copy outlives any executor.
    Large tables may ask for a ``compression`` of their own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds after which what is no longer referred to is cleared away.
TIDY_SECONDS = 5
_tidied = [0.0]


def _tidy(spark: SparkSession) -> None:
    """Has Spark drop broadcast tables and shuffle files of jobs that are over.

    It does when the driver collects its garbage, which by itself may be half an
    hour apart, while each small table that was broadcast takes 16 MB of every executor.
    """
    if time.monotonic() - _tidied[0] > TIDY_SECONDS:
        spark.sparkContext._jvm.System.gc()
        give_back(spark)
        _tidied[0] = time.monotonic()


def give_back(spark: SparkSession) -> str:
    """Has the driver's JVM give memory outside its heap that it no longer uses back to the system; what it says.

    Compiling the code of many plans leaves hundreds of MB of it with the
    allocator.  A JVM that knows no such command says nothing and goes on.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.Object, 4)  # no arguments of its own
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(invoke.invoke(server, args))
    except Py4JError:
        return ""


#: Rows of a batch that texts are handed to Python in.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Hands rows to Python in shorter batches from now on, as ten thousand long texts are a lot to hold at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    """How many partitions the session deals a shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    The size is counted first; a larger side is left to a shuffled join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Buckets of a running sum: each is one task's share, so at 10^10 rows a task sorts 10^7.
BUCKET_BITS = 10


def running_sum(df: DataFrame, value: Column, order: Column, ties: list[str], keys: list[str], name: str, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each row of the same keys.

    ``order`` is a uniformly distributed 64-bit hash, taken as unsigned; rows of
    equal hash follow ``ties``.  The sum is taken in two levels, within buckets
    of the hash and over the buckets' totals, so that no key's rows meet in one
    task however many they are.
    """
    work = df.withColumn("_h", order).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits)).withColumn("_v", value.cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = work.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t")).withColumn("_r", F.lit(0))
    before = totals.withColumn("_off", F.sum("_t").over(across) - F.col("_t")).drop("_t", "_r")
    if not keys:
        before = F.broadcast(before)  # 2^bits rows at most
    before = before.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_b": "_kb"})
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = work.withColumn("_in", F.sum("_v").over(inside) - F.col("_v")).join(before, same)
    return out.withColumn(name, F.col("_in") + F.col("_off")).drop("_h", "_b", "_v", "_in", "_off", "_kb", *(f"_k{i}" for i in range(len(keys))))
