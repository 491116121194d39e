"""Steps that remove records, counted while the records are written, and their reconciliation.

Each record carries the first step that removes it, so one pass both filters and counts: the counts
are observed metrics of the job that writes what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REMOVED = "_removed"


def removed(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Add _removed: the first of the steps that holds, kept from earlier calls; a null condition doesn't hold."""
    step = F.lit(None).cast("string")
    for name, holds in reversed(steps.items()):
        step = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(step)
    return df.withColumn(REMOVED, F.coalesce(REMOVED, step) if REMOVED in df.columns else step)


def repeated(df: DataFrame, step: str, key: Column, order: Sequence[Column], known: Column | None = None) -> DataFrame:
    """Mark as removed by the step all records of a key but the first in order, of those not yet removed and, where given, known.

    The first is a partial aggregate joined back, one row for each key, so a hot key needs no one task.
    Records that tie in the whole order all stay first, so it should end with something unique.
    """
    live = F.lit(True) if known is None else F.coalesce(known, F.lit(False))
    live = live & F.col(REMOVED).isNull() if REMOVED in df.columns else live
    d = df.withColumns({"_key": F.when(live, F.struct(key.alias("k"))), "_place": F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))})
    first = d.where("_key IS NOT NULL").groupBy(F.col("_key.k").alias("_k")).agg(F.min("_place").alias("_first"))
    d = d.join(first, F.col("_key").isNotNull() & F.col("_key.k").eqNullSafe(F.col("_k")), "left")
    return removed(d, {step: F.col("_place") > F.col("_first")}).drop("_key", "_place", "_k", "_first")


def observed(df: DataFrame, steps: Sequence[str], name: str) -> tuple[DataFrame, Observation]:
    """What no step removes, and the counts that whatever first runs it will leave: total, each step's and left."""
    seen = Observation(name)
    counts = [F.count("*").alias("total"), *(F.count_if(F.col(REMOVED) == s).alias(s) for s in steps), F.count_if(F.col(REMOVED).isNull()).alias("left")]
    return df.observe(seen, *counts).where(F.col(REMOVED).isNull()).drop(REMOVED), seen


def as_table(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """step (from 0, all records), label, n_removed by it and n_left after it, from observed counts in order of the steps."""
    left, rows = counts["total"], [(0, "identified", 0, counts["total"])]
    for k, (name, n) in enumerate(((s, n) for s, n in counts.items() if s not in ("total", "left")), 1):
        left -= n
        rows.append((k, name, n, left))
    return spark.createDataFrame(rows, "step int, label string, n_removed long, n_left long")


def reconciled(steps: DataFrame, kept: DataFrame, tolerance: int = 2) -> DataFrame:
    """steps (step, label, n_removed, n_left) as they are, if the last n_left is the number of kept rows within the tolerance and no step adds records; else the query fails with both numbers."""
    ends = steps.agg(F.max_by("n_left", "step").alias("_said"), F.min("n_removed").alias("_least"), F.min("n_left").alias("_low"))
    found = kept.agg(F.count("*").alias("_found")).crossJoin(F.broadcast(ends))
    wrong = (F.abs(F.col("_said") - F.col("_found")) > tolerance) | (F.col("_least") < 0) | (F.col("_low") < 0)
    said = F.concat(F.lit("the steps leave "), F.col("_said"), F.lit(" records, "), F.col("_found"), F.lit(" are there"))
    checked = found.select(F.when(wrong, F.raise_error(said)).otherwise(F.lit(True)).alias("_right"))
    return steps.crossJoin(F.broadcast(checked)).where("_right").drop("_right")
