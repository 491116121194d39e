"""Quantile bins, average ranks, shares, curves and keep strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import alike, by_value, grouped_quantiles, quantiles


def quantile_bins(df: DataFrame, value: str, q: int, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Add out: 1 to q by interpolated quantile edges, right-closed with the least included; null where the value is.

    Edges that coincide leave bins empty rather than failing.  Over all rows the edges are numbers,
    found by counts at once; within groups they are joined.
    """
    names = {f"_e{k}": k / q for k in range(1, q)}
    if within:
        edges = grouped_quantiles(df, value, names, within).select(*(F.col(c).alias(f"_w_{c}") for c in within), *names)
        joined = df.join(edges, alike(within, [f"_w_{c}" for c in within]), "left")
        edge = F.col
    else:
        found = dict(zip(names, quantiles(df, value, list(names.values())), strict=True))
        joined, edge = df, lambda name: F.lit(found[name])
    bins = F.lit(q)
    for k in range(q - 1, 0, -1):
        bins = F.when(F.col(value) <= edge(f"_e{k}"), k).otherwise(bins)
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), bins)).drop(*names, *(f"_w_{c}" for c in within))


def positions(df: DataFrame, value: str, tie: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Add _rn, the place from 1 in rising order of value and then of tie, _constant (one value has all rows of the group), and total, sum_before and sum_all as by_value has them."""
    by = by_value(df, value, within).select(*(F.col(c).alias(f"_w_{c}") for c in within), F.col(value).alias("_v"), "before", (F.col("n") == F.col("total")).alias("_constant"), "total", "sum_before", "sum_all")
    same = F.col(value).eqNullSafe(F.col("_v"))
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    place = F.row_number().over(Window.partitionBy(*within, value).orderBy(*tie))
    d = df.withColumn("_place", place).join(by, same)
    return d.withColumn("_rn", F.col("before") + F.col("_place")).drop("_v", "before", *(f"_w_{c}" for c in within))


def average_ranks(df: DataFrame, value: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Add out: the rank of the value from 1, ties at their mean; and total, the rows of the group."""
    by = by_value(df, value, within).select(*(F.col(c).alias(f"_w_{c}") for c in within), F.col(value).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out), "total")
    same = F.col(value).eqNullSafe(F.col("_v"))
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return df.join(by, same).select(*df.columns, out, "total")


def percentile_ranks(df: DataFrame, value: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Add out: the average rank of the value as a part of all rows of the group."""
    return average_ranks(df, value, out, within).withColumn(out, F.col(out) / F.col("total")).drop("total")


def position_bins(df: DataFrame, value: str, tie: Sequence[Column], q: int, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Add out: 1 to q of equal sizes by position in rising order of value and then of tie; all 1 where the group has one value."""
    d = positions(df, value, tie, within)
    return d.withColumn(out, F.when(F.col("_constant"), 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("_rn") - 1) * q / (F.col("total") - 1)).cast("int")))).select(*df.columns, out)


def rescaled(df: DataFrame, value: str, out: str, within: Sequence[str], low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Add out: from low to high by the extremes of the value in each group, which are aggregated and joined; the middle where all are equal."""
    ends = df.groupBy(*(F.col(c).alias(f"_w_{c}") for c in within)).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    same = F.lit(True)
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    scaled = F.when(F.col("_most") == F.col("_least"), F.lit((low + high) / 2)).otherwise(low + (high - low) * (F.col(value) - F.col("_least")) / (F.col("_most") - F.col("_least")))
    return df.join(ends, same).withColumn(out, scaled).select(*df.columns, out)


def top_parts(df: DataFrame, value: str, fractions: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """within and, for each named fraction of all rows (half to even, at least one), {name}_n and {name}_sum of the largest; n and sum of all.

    Rows of equal values can stand for each other, so no order among them is needed.
    """
    d = by_value(df, value, within, descending=True)
    out = [F.sum("n").alias("n"), F.max("sum_all").alias("sum")]
    for name, fraction in fractions.items():
        top = F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(fraction)).cast("long"))
        taken = F.greatest(F.lit(0), F.least(F.col("n"), top - F.col("before")))
        out += [F.sum(taken).alias(f"{name}_n"), F.sum(taken * F.coalesce(F.col(value), F.lit(0))).alias(f"{name}_sum")]
    return d.groupBy(*within).agg(*out)


def top_shares(df: DataFrame, value: str, fractions: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """For each named fraction the per cent of the sum that the largest rows hold."""
    d = top_parts(df, value, fractions, within)
    return d.select(*within, *(F.when(F.col("sum") > 0, 100.0 * F.col(f"{name}_sum") / F.col("sum")).otherwise(0.0).alias(name) for name in fractions))


def top_share(df: DataFrame, value: str, fraction: float, within: Sequence[str] = ()) -> DataFrame:
    """share: per cent of the sum that the largest rows hold, fraction of all rows half to even, at least one."""
    return top_shares(df, value, {"share": fraction}, within)


def lorenz(df: DataFrame, value: str, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """x and y, per cent of rows and of the sum, in rising order of the value."""
    d = positions(df, value, order, within)
    x = F.when(F.col("total") > 1, 100.0 * (F.col("_rn") - 1) / (F.col("total") - 1)).otherwise(0.0)
    y = F.when(F.col("sum_all") > 0, 100.0 * (F.col("sum_before") + F.col("_place") * F.coalesce(F.col(value), F.lit(0))) / F.col("sum_all")).otherwise(0.0)
    return d.withColumn("x", x).withColumn("y", y).select(*df.columns, "x", "y")


def keep_ranked(df: DataFrame, score: str, order: Sequence[Column], threshold: float, floor: int, cap: int) -> DataFrame:
    """Add rank and keep: scores over the threshold, but at least `floor` rows and at most `cap`.

    The rank needs one order over all rows, so only the first `cap` are ranked, by a top-k that
    each task cuts to size; others have none.  `order` begins with the score, largest first, so
    rows over the threshold are all among those, or fill them: nothing else need be counted.
    """
    top = df.orderBy(*order).limit(cap).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    passing = F.count_if(F.col(score) >= threshold).over(Window.partitionBy())
    return top.withColumn("keep", F.col("rank") <= F.greatest(F.lit(floor), passing))


def bands(value: Column, cuts: Sequence[tuple[float, float, str]]) -> Column:
    """The label of the band, open below and closed above, that holds the value; null outside all."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(cuts):
        out = F.when((value > low) & (value <= high), label).otherwise(out)
    return out


def zones(score: Column) -> Column:
    return F.when(score < -0.10, "strong_negative").when(score < 0, "negative").when(score < 0.10, "positive").when(score >= 0.10, "strong_positive")
