"""Shared helpers: tables, durable checkpoints and shared folders."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Paths given out in this process, for clear().
_given: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path for a written table below the shared folder."""
    _given.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def clear(spark: SparkSession) -> int:
    """Delete the tables that operators of this process have written to the shared folder; how many there were.

    Results are read from them, so this is for after the results are used or written elsewhere.
    """
    sc, n = spark.sparkContext, 0
    for path in _given:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True))
    _given.clear()
    return n


def tables_since(k: int, *names: str) -> list[str]:
    """Paths of the tables of these names among those given out after the first k."""
    return [p for p in _given[k:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] in names]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        _given.remove(path)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and checkpoints of frames that are out of use; it does when the driver collects them, which may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Return what the driver's JVM has freed outside its heap to the system, as give_back does of a worker; whether it could.

    Threads of many short jobs and compilers leave some 200 MB there.  The command is HotSpot's, from 17.0.9 on, and glibc's.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    try:
        # The server's own class is not open to the gateway, its interface is.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def given() -> int:
    return len(_given)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which outlives the executors that wrote it."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; smaller on disk than a checkpoint."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 2_000) -> None:
    """From now on Arrow batches of this session are of at most so many bytes and rows, where they may be larger.

    A task holds a batch in the JVM, on its way and in Python at once, and texts may be long: the
    default of 64 MB takes several times that of an executor's memory for each task.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = spark.conf.get(key)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def numbered(df: DataFrame, order: list[Column], name: str, most: int = 1 << 62) -> DataFrame:
    """Add a column of dense numbers from 0 in the order given: ranges are sorted apart, and their sizes come to the driver."""
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts = dict(rows.groupBy(part.cast("int").alias("p")).count().collect())  # a row for each partition
    offsets, total = [0], 0
    for p in range(max(counts, default=-1) + 1):
        total += counts.get(p, 0)
        offsets.append(total)
    if total > most:
        raise ValueError(f"{total} rows; {most} can be numbered")
    offset = F.element_at(F.lit(offsets), part.cast("int") + 1)
    return rows.withColumn(name, offset + F.col(name).bitwiseAND((1 << 33) - 1))


#: Bits of a Bloom filter, at most; so many are 8 MB.  A full filter holds nothing back, and joins behind it are exact.
FILTER_BITS = 1 << 26


def filter_bits(n: int) -> int:
    """Bits for n values."""
    return min(FILTER_BITS, max(1 << 10, 1 << (n * 16).bit_length()))


def bit_filter(values: DataFrame, spots: list[Column], bits: int) -> np.ndarray:
    """The words of a Bloom filter with the bits `spots` of each row set; bits / 64 words come to the driver at most."""
    words = values.select(F.explode(F.array(*spots)).alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
    table = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[table.column("word").to_numpy()] = table.column("set").to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, *spots: np.ndarray) -> np.ndarray:
    hit = np.ones(len(spots[0]), dtype=bool)
    for x in spots:
        at = x.astype(np.uint64)
        hit &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def give_back() -> None:
    """Return what this process has freed to the system, where its C library can: a worker lives on after a large task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
