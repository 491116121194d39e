"""Parquet tables kept by key: patches that rewrite only the buckets they meet, and look-ups that remember.

A table's rows lie in folders by a hash of their key.  A patch reads and writes the folders of its
own keys, by dynamic partition overwrite: the new files are complete before old ones go.  The driver
sees bucket numbers only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paging import Busy

BUCKET = "_bucket"


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias(BUCKET)


def read(spark: SparkSession, path: str, met: Sequence[int] | None = None) -> DataFrame | None:
    """The table's rows, or those of some of its buckets; none where there is no table yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}=*")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return None
    d = spark.read.option("basePath", path).parquet(path)
    return (d if met is None else d.where(F.col(BUCKET).isin(list(met)))).drop(BUCKET)


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    rows.withColumn(BUCKET, bucket(key, buckets)).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def patch(rows: DataFrame, path: str, key: str, order: Sequence[str] = (), gone: Column | None = None, fill: bool = False, buckets: int = 256) -> list[int]:
    """Put rows in place of the table's rows of the same keys, which `gone` marks are deleted; the buckets that were rewritten.

    Of several rows of a key the one of the greatest `order` counts, and of equal ones the greatest
    row; null keys are left out.  With `fill`, nulls of a row and columns that the patch lacks take the
    value that the table has.  New columns are null in old rows.  The table is made by the first patch; a patch that is
    repeated changes nothing.  Rows are read twice, so they should be cheap or written.
    """
    spark = rows.sparkSession
    columns = rows.columns
    last = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*columns).alias("_row"))).alias("_m")).select("_m._row.*")
    met = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(bucket(key, buckets)).distinct().collect())
    if not met:
        return []
    old = read(spark, path, met)
    if old is not None:
        if fill:
            shared = [c for c in columns if c in old.columns and c != key]
            more = [c for c in old.columns if c not in columns]
            before = old.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_old_{c}") for c in shared + more))
            last = last.join(before, F.col(key) == F.col("_k"), "left").select(*(F.coalesce(c, f"_old_{c}").alias(c) if c in shared else F.col(c) for c in columns), *(F.col(f"_old_{c}").alias(c) for c in more))
        stay = old.join(rows.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
        new = last.where(~F.coalesce(gone, F.lit(False))) if gone is not None else last
        last = stay.unionByName(new, allowMissingColumns=True)
    elif gone is not None:
        last = last.where(~F.coalesce(gone, F.lit(False)))
    emptied = [] if gone is None or old is None else sorted(set(met) - {r[0] for r in last.select(bucket(key, buckets)).distinct().collect()})
    _write(last, path, key, buckets)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    for b in emptied:  # no file takes the place of theirs
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fs, f"{BUCKET}={b}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return met


def answers(fetch: Callable[[list[str]], Mapping[str, object]], keys: list[str], pauses: Sequence[float] = (10, 20, 40, 60)) -> tuple[dict[str, object], dict[str, str]]:
    """What fetch finds, and the error of each key that it could not be asked for.

    A busy service is asked again after each pause.  A batch that fails otherwise is halved, so
    only the keys at fault are left without an answer.
    """
    for pause in [*pauses, None]:
        try:
            return dict(fetch(keys)), {}
        except Busy as e:
            if pause is None:
                return {}, dict.fromkeys(keys, f"busy: {e}")
            time.sleep(pause)
        except Exception as e:  # whatever a service or its client does
            if len(keys) == 1:
                return {}, {keys[0]: f"{type(e).__name__}: {e}"}
            half = len(keys) // 2
            (a, x), (b, y) = answers(fetch, keys[:half], pauses), answers(fetch, keys[half:], pauses)
            return a | b, x | y
    raise AssertionError


def remembered(keys: DataFrame, key: str, path: str, fetch: Callable[[list[str]], Mapping[str, object]], fields: str, keep: float, keep_missed: float, now: float | None = None, batch: int = 50, tasks: int = 4, buckets: int = 64, pauses: Sequence[float] = (10, 20, 40, 60)) -> DataFrame:
    """key, found, the fields and error for each distinct key: from the memory at `path`, or asked for now and remembered there.

    An answer is good for `keep` seconds, that a key is unknown for `keep_missed`; older ones are
    asked for again.  Keys whose batch failed have found null and an error and are not remembered,
    so the next call asks for them.  Blank and null keys are no keys.  `fetch` gives a tuple of the
    fields for each key that it knows, for at most `batch` keys in each of at most `tasks` tasks.
    A task that is run again asks again; what was asked for is written before it is used.
    """
    spark, now = keys.sparkSession, time.time() if now is None else now
    wanted = keys.select(F.trim(F.col(key).cast("string")).alias("key")).where("key <> ''").distinct()
    met = [r[0] for r in wanted.select(bucket("key", buckets)).distinct().collect()]
    memory = read(spark, path, met)
    names = [f.split()[0] for f in fields.split(", ")]
    good = F.col("asked_at") > F.when(F.col("found"), now - keep).otherwise(now - keep_missed)
    missing = wanted if memory is None else wanted.join(memory.where(good).select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b["key"].iloc[s : s + batch].tolist()
                found, errors = answers(fetch, part, pauses)
                yield pd.DataFrame({"key": part, "found": [None if k in errors else k in found for k in part]} | {n: [found[k][i] if k in found else None for k in part] for i, n in enumerate(names)} | {"error": [errors.get(k) for k in part], "asked_at": now})

    asked = f"{path}.asked/{uuid.uuid4().hex}"
    missing.repartition(tasks).mapInPandas(run, f"key string, found boolean, {fields}, error string, asked_at double").write.parquet(asked)
    fresh = spark.read.parquet(asked)
    patch(fresh.where("found IS NOT NULL").drop("error"), path, "key", ["asked_at"], buckets=buckets)
    memory = read(spark, path, met)
    known = wanted.join(memory.where(good).drop("asked_at"), "key") if memory is not None else fresh.where("false").drop("error", "asked_at")
    return known.withColumn("error", F.lit(None).cast("string")).unionByName(fresh.where("found IS NULL").drop("asked_at"))
