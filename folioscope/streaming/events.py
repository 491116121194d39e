"""Incremental reading: windows over event time, keyed dedup and new-key feeds.

Each function takes a batch or a streaming DataFrame.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """hour (the window's start), event_type, n and total."""
    g = timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    return timed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """One row for each key: in a stream, within the watermark's reach."""
    return timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str, buckets: int = 256):
    """A query that appends to the Parquet table at `path` the rows whose key it lacks, batch by batch; a key that has failed once stays known.

    Keys are kept apart, in `path` with `.keys` appended, by bucket of their hash: a batch reads
    those of its own keys' buckets only.  A batch that is tried again writes over what it wrote
    before, so nothing is doubled; the table's column `batch` tells where a row came from.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]

    def write(rows: DataFrame, number: int) -> None:
        spark, mark = rows.sparkSession, f"{run}-{number}"
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        fresh = rows.dropDuplicates([key])
        met = [r[0] for r in fresh.select(bucket).distinct().collect()]  # `buckets` at most
        try:
            known = spark.read.parquet(f"{path}.keys").where(F.col("_bucket").isin(met) & (F.col("batch") != mark)).select(key).distinct()
            fresh = fresh.join(known, key, "left_anti")
        except Exception as e:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={mark}")
        done = spark.read.parquet(f"{path}/batch={mark}").select(key, bucket.alias("_bucket"))
        done.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}.keys/batch={mark}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
