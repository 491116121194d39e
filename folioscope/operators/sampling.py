"""Quota allocation and reproducible samples; order is by a digest of the id and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import bands, quantile_bins


def draw_order(key: str, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)


def hamilton(strata: DataFrame, weight: str, n: int, *order: str) -> DataFrame:
    """Add quota: largest remainders of n by weight, ties by order; equal parts where nothing weighs, the first ones larger by one."""
    every = Window.partitionBy()
    total, groups = F.sum(weight).over(every), F.count("*").over(every)
    exact = F.when(total > 0, F.lit(float(n)) * F.col(weight) / total).otherwise(F.lit(float(n)) / groups)
    d = strata.withColumn("_q", exact).withColumn("_f", F.floor("_q")).withColumn("_r", F.when(total > 0, F.col("_q") - F.col("_f")).otherwise(0.0))
    rank = F.row_number().over(Window.orderBy(F.desc("_r"), *order))
    return d.withColumn("quota", (F.col("_f") + F.when(rank <= F.lit(n) - F.sum("_f").over(every), 1).otherwise(0)).cast("long")).drop("_q", "_f", "_r")


def stratified(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows (all, if fewer) in proportion to the strata; what small strata lack is drawn from the rest."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    quotas = hamilton(sizes, "_size", n, *strata)
    d = df.join(quotas.drop("_size"), list(strata)).withColumn("_o", draw_order(key, seed))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key)))
    first = d.withColumn("_in", F.when(F.col("_rn") <= F.col("quota"), 0).otherwise(1))
    return first.orderBy("_in", "_o", key).limit(n).drop("quota", "_o", "_rn", "_in")


def one_per_cell(df: DataFrame, cells: Sequence[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """One row of each cell first, then rows in proportion to the cells, n in all."""
    o = df.withColumn("_o", draw_order(key, seed))
    o = o.withColumn("_rn", F.row_number().over(Window.partitionBy(*cells).orderBy("_o", key)))
    quotas = hamilton(df.groupBy(*cells).agg(F.count("*").alias("_size")), "_size", n, *cells).drop("_size")
    d = o.join(quotas, list(cells)).withColumn("_in", F.when(F.col("_rn") == 1, 0).when(F.col("_rn") <= F.col("quota"), 1).otherwise(2))
    return d.orderBy("_in", "_o", key).limit(n).drop("_o", "_rn", "quota", "_in")


def disjoint(df: DataFrame, strata: Sequence[str], key: str, sizes: Sequence[int], seed: str = "42") -> list[DataFrame]:
    """Samples of the given sizes, each drawn from what the earlier ones left."""
    out: list[DataFrame] = []
    for k, n in enumerate(sizes):
        for taken in out:
            df = df.join(taken.select(key), key, "left_anti")
        out.append(stratified(df, strata, key, n, f"{seed}:{k}"))
    return out


def cell_sample(df: DataFrame, cells: Sequence[str], key: str, per_cell: int, cap: int, seed: str = "42") -> DataFrame:
    """At most per_cell rows of each cell and cap in all."""
    d = df.withColumn("_o", draw_order(key, seed))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*cells).orderBy("_o", key))).where(F.col("_rn") <= per_cell)
    return d.orderBy("_o", key).limit(cap).drop("_o", "_rn")


def cohort_sample(df: DataFrame, cohorts: Sequence[tuple[float, float, str, int]], year: str, scores: tuple[str, str], key: str, cap: int, seed: str = "42") -> DataFrame:
    """Add cohort to a sample of each cohort (above low, up to high; label, n): all of a small one, else equally many of each pair of terciles of two scores, topped up to n, and cap in all.

    Terciles are those of the cohort; rows without a year in a cohort take no part, nor those
    without a score where terciles are needed, but for the top-up.  Draws go by a digest of the key.
    No cell gives more than n rows to what is ordered by cohort, so a large cohort is no large task.
    """
    size = F.lit(None).cast("int")
    for low, high, label, n in cohorts:
        size = F.when((F.col(year) > low) & (F.col(year) <= high), n).otherwise(size)
    d = df.withColumn("cohort", bands(F.col(year), [c[:3] for c in cohorts])).where("cohort IS NOT NULL").withColumns({"_n": size, "_o": draw_order(key, seed)})
    counts = d.groupBy(F.col("cohort").alias("_c")).agg(F.count("*").alias("_size"))
    for k, score in enumerate(scores):
        d = quantile_bins(d, score, 3, f"_t{k}", ["cohort"])
    d = d.join(F.broadcast(counts), F.col("cohort") == F.col("_c")).drop("_c")
    known = F.col("_t0").isNotNull() & F.col("_t1").isNotNull()
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy("cohort", "_t0", "_t1").orderBy("_o", key))).where(F.col("_rn") <= max(n for *_, n in cohorts))
    first = (F.col("_size") <= F.col("_n")) | known & (F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 9)))
    d = d.withColumn("_in", F.when(first, 0).otherwise(1))
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("cohort").orderBy("_in", "_o", key))).where((F.col("_in") == 0) | (F.col("_rank") <= F.col("_n")))
    return d.orderBy("_o", key).limit(cap).select(*df.columns, "cohort")


def merge_small(sizes: list[tuple[str, int]], least: int) -> dict[str, str]:
    """Each stratum's name after merging those below `least` into the smaller neighbour, again and again; for a few strata in order."""
    groups = [([name], n) for name, n in sizes]
    while len(groups) > 1 and min(n for _, n in groups) < least:
        k = min(range(len(groups)), key=lambda i: groups[i][1])
        near = [i for i in (k - 1, k + 1) if 0 <= i < len(groups)]
        to = min(near, key=lambda i: groups[i][1])
        a, b = sorted((k, to))
        groups[a : b + 1] = [(groups[a][0] + groups[b][0], groups[a][1] + groups[b][1])]
    return {name: "+".join(names) for names, _ in groups for name in names}


def row_ids(df: DataFrame, key: str, prefix: str = "V", length: int = 8, seed: str = "123") -> DataFrame:
    """Add form_id, a short digest of the key that the seed makes unlike the key."""
    return df.withColumn("form_id", F.concat(F.lit(prefix), F.upper(F.substring(draw_order(key, seed), 1, length))))
