"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch between the JVM and Python, beyond which the next row begins another.
ARROW_BYTES = "8m"
#: Seconds between two returns of the driver's freed memory, at least.
RETURN_EVERY = 3.0
#: The JVM's command for it, as its management bean names it.
RETURN_COMMAND = "systemTrimNativeHeap"
_returned_at = float("-inf")


def return_freed(spark: SparkSession) -> str | None:
    """Give memory that the driver's JVM has freed outside of its heap back to the system; what the JVM says of it.

    Compiling a plan's code takes much memory for a moment. The C library keeps
    it in pools of many threads, so it adds up over the plans of a session. A
    JVM without the command System.trim_native_heap goes on as it is.
    """
    global _returned_at
    if time.monotonic() - _returned_at < RETURN_EVERY:
        return None
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        named = jvm.java.lang.Class.forName
        types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = named(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), RETURN_COMMAND
        # Through the interface: the class of the server is not open to callers.
        invoke = named("javax.management.MBeanServer").getMethod("invoke", types)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None
    finally:
        _returned_at = time.monotonic()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder of spark.checkpoint.dir, which all executors share.

    Where the session names no such folder a temporary one is set, but only if
    driver and executors are one process; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    done = df.checkpoint()
    return_freed(df.sparkSession)
    return done


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, with batches of at most ARROW_BYTES where the session sets no other limit: rows alone are no bound for texts."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(run, schema)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of bounded size from driver values, without an RDD."""
    parsed = F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{schema}>>"))
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def keyed_permutation(index: Column, size: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0 .. size-1: an alternating Feistel network over a rows by b columns, a * b >= size.

    Values that fall outside are walked along their cycle until they are
    inside. At most a * b - size < a of them exist, so a steps always suffice;
    for large sizes 64 steps fail with a probability below size ** -32.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
        rounds = F.array(*[F.lit(i).cast("long") for i in range(3)])

        def step(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(*key, i, F.lit(0), s["r"]), a), a)
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(*key, i, F.lit(1), left), b), b)
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])

    walk = F.sequence(F.lit(1).cast("long"), F.least(F.greatest(a, F.lit(1)), F.lit(64)))
    found = F.aggregate(walk, once(index.cast("long")), lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return F.pmod(found, size)
