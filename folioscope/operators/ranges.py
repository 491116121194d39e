"""Ranks and exact quantiles of columns with any number of distinct values.

Nothing is ordered in one task.  Ranks: distinct values are counted, cut into ranges of about equal
numbers of rows, ordered within ranges, and moved up by what the ranges before hold.  A value's
range follows from the value alone, so ties never lie on both sides of an end, and a task that is
run again puts it in the same place.  Quantiles: counts by range narrow the intervals that hold the
wanted positions, until few values are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most: their ends and counts are a row of that many numbers for each group.
MOST_RANGES = 4096
#: Cuts of an interval in one round of counts, and the values that are few enough to be fetched with their counts.
CUTS, FEW = 255, 20_000


def ranges_of(df: DataFrame) -> int:
    """Twice the session's shuffle partitions, as a power of two."""
    return min(MOST_RANGES, 2 << (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def placed(df: DataFrame, value: Column, cuts: str, parts: int, out: str) -> DataFrame:
    """Add out: how many of the cuts, an array column of parts - 1 rising ones, are below the value, by halving; -1 for null."""
    d, half = df.withColumn(out, F.when(value.isNotNull(), 0)), parts // 2
    while half:
        d, half = d.withColumn(out, F.col(out) + F.when(value > F.element_at(cuts, F.col(out) + half), half).otherwise(0)), half // 2
    return d.withColumn(out, F.coalesce(out, F.lit(-1)))


def alike(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether the columns are equal pairwise, nulls to nulls."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same &= F.col(a).eqNullSafe(F.col(b))
    return same


def by_value(df: DataFrame, value: str, within: Sequence[str] = (), descending: bool = False, parts: int | None = None) -> DataFrame:
    """within, value, n (rows with it), before (rows ahead of them), total (rows) and, for sums, sum_before and sum_all.

    A row for each distinct value of each group; nulls come first in rising order and last in
    falling order, NaN is the largest.  The ends of ranges are a quantile sketch of the rows, one small
    row, so a range has no more distinct values than its even share of the rows; what ranges hold is added up in arrays of at most `parts` numbers.
    """
    parts = parts or ranges_of(df)
    part, total, add = ["_range"], list(within), F.coalesce("_s", F.lit(0))
    counts = df.groupBy(*within, value).agg(F.count("*").alias("n"), F.sum(value).alias("_s"))
    marks = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    ends = df.agg(F.coalesce(F.percentile_approx(F.col(value).cast("double"), marks, F.lit(max(10_000, 4 * parts))), F.array_repeat(F.lit(0.0), parts - 1)).alias("_ends"))
    cut = placed(counts.crossJoin(F.broadcast(ends)), F.col(value).cast("double"), "_ends", parts, "_range").drop("_ends")
    if descending:
        cut = cut.withColumn("_range", -F.col("_range"))
    held = cut.groupBy(*total, *part).agg(F.sum("n").alias("_n"), F.sum(add).alias("_t")).groupBy(*total).agg(F.array_sort(F.collect_list(F.struct("_range", "_n", "_t"))).alias("_a"))
    kind = {f.name: f.dataType.simpleString() for f in cut.select(add.alias("_t")).groupBy().agg(F.sum("_t").alias("_t")).schema.fields}["_t"]
    zero = F.expr(f"struct(0L AS n, CAST(0 AS {kind}) AS s, CAST(array() AS array<struct<r:int,n:bigint,s:{kind}>>) AS a)")
    step = lambda z, x: F.struct((z["n"] + x["_n"]).alias("n"), (z["s"] + x["_t"]).cast(kind).alias("s"), F.concat(z["a"], F.array(F.struct(x["_range"].alias("r"), z["n"].alias("n"), z["s"].alias("s")))).alias("a"))
    sums = held.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(total)), F.aggregate("_a", zero, step).alias("_z"))
    sums = sums.select(*(f"_w{i}" for i in range(len(total))), F.col("_z.n").alias("total"), F.col("_z.s").alias("sum_all"), F.explode("_z.a").alias("_o"))
    sums = sums.select("*", F.col("_o.r").alias("_r"), F.col("_o.n").alias("_n0"), F.col("_o.s").alias("_s0")).drop("_o")
    order = Window.partitionBy(*total, *part).orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({"_before": F.sum("n").over(order) - F.col("n"), "_sum": F.sum(add).over(order) - add})
    d = own.join(sums if within else F.broadcast(sums), alike([*total, "_range"], [*(f"_w{i}" for i in range(len(total))), "_r"]))
    return d.select(*total, value, "n", (F.col("_before") + F.col("_n0")).alias("before"), "total", (F.col("_sum") + F.col("_s0")).alias("sum_before"), "sum_all")


def grouped_quantiles(df: DataFrame, value: str, fractions: dict[str, float], within: Sequence[str]) -> DataFrame:
    """within and each named fraction's interpolated quantile of the group's values, nulls left out, from ranks by ranges; groups of nulls alone have no row."""
    d = by_value(df.where(F.col(value).isNotNull()).select(*within, value), value, within)
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
    at = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in fractions.items()}
    ends = [x for name, h in at.items() for x in (holds(F.floor(h)).alias(f"_{name}_lo"), holds(F.ceil(h)).alias(f"_{name}_hi"))]
    g = d.groupBy(*within).agg(F.max("total").alias("total"), *ends)
    lo, hi = lambda name: F.col(f"_{name}_lo").cast("double"), lambda name: F.col(f"_{name}_hi").cast("double")
    between = {name: F.when(lo(name) == hi(name), lo(name)).otherwise((F.ceil(h) - h) * lo(name) + (h - F.floor(h)) * hi(name)) for name, h in at.items()}
    return g.select(*within, *(c.alias(name) for name, c in between.items()))


def at_positions(df: DataFrame, value: str, positions: Sequence[int], total: int, least: float, most: float) -> dict[int, float]:
    """The values at positions, from 0, in the rising order of all `total` non-null values, which lie from least to most.

    In a round every interval that still holds a wanted position is cut at a sketch's quantiles and
    its values are counted between the cuts, and at them; the part that holds the position is the
    next interval.  A round leaves about one value in CUTS, and no value is taken for another: the
    sketch only says where to cut.  A few values that are left are fetched.
    """
    v = F.col(value).cast("double")
    spans: dict[tuple[float, float], tuple[int, int]] = {(least, most): (0, total)}  # to the values below and the values within
    found: dict[int, float] = {}
    todo = sorted(set(positions))
    marks = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    while todo := [k for k in todo if k not in found]:
        home = {k: next(s for s, (below, n) in spans.items() if below <= k < below + n) for k in todo}
        live = [s for s in spans if s in home.values()]
        inside = lambda s: (v >= F.lit(s[0])) & (v <= F.lit(s[1]))
        if sum(spans[s][1] for s in live) <= FEW:
            seen = [df.where(inside(s)).groupBy(v.alias("v")).count().withColumn("i", F.lit(i)) for i, s in enumerate(live)]
            counts: dict[int, list[tuple[float, int]]] = {}
            for part in seen:
                for x, n, i in part.collect():
                    counts.setdefault(i, []).append((x, n))
            for i, s in enumerate(live):
                upto = spans[s][0]
                for x, n in sorted(counts[i]):
                    found.update({k: x for k in todo if upto <= k < upto + n})
                    upto += n
            continue
        sketch = df.agg(*(F.percentile_approx(F.when(inside(s), v), marks, 10_000) for s in live)).first()
        spans_next: dict[tuple[float, float], tuple[int, int]] = {}
        for s, cuts in zip(live, sketch, strict=True):
            edges = [*cuts, *[cuts[-1]] * (CUTS - len(cuts))]
            d = placed(df.where(inside(s)).select(v.alias("v")).withColumn("_cuts", F.lit(edges)), F.col("v"), "_cuts", CUTS + 1, "_p")
            below = spans[s][0]
            # a value that is a cut counts on its own
            d = d.withColumn("_cut", (F.col("_p") < CUTS) & (F.col("v") == F.element_at("_cuts", F.least(F.col("_p") + 1, F.lit(CUTS)))))
            for _, _, n, lo, hi in sorted(d.groupBy("_p", "_cut").agg(F.count("*"), F.min("v"), F.max("v")).collect()):
                if lo == hi:
                    found.update({k: lo for k in todo if below <= k < below + n})
                else:
                    spans_next[lo, hi] = (below, n)
                below += n
        spans = spans_next
    return found


def quantiles(df: DataFrame, value: str, fractions: Sequence[float]) -> list[float | None]:
    """The interpolated quantiles of all non-null values, exactly; nulls of a column without values.  NaN counts as the largest value."""
    d = df.select(F.col(value).alias("x")).where("x IS NOT NULL")
    v = F.col("x").cast("double")
    total, least, most, broken = d.agg(F.count("*"), F.min(v), F.max(v), F.count_if(F.isnan(v))).first()
    if not total:
        return [None] * len(fractions)
    if broken:  # they lie at the end, whatever is asked for
        d = d.where(~F.isnan(v))
        most = d.agg(F.max(v)).first()[0]
    places = [(total - 1) * p for p in fractions]
    whole = total - broken
    wanted = {k for h in places for k in (int(h), -int(-h // 1)) if k < whole}
    found = at_positions(d, "x", sorted(wanted), whole, least, most) if wanted else {}
    nan = float("nan")
    out = []
    for h in places:
        a, b = int(h), -int(-h // 1)
        x, y = found.get(a, nan), found.get(b, nan)
        out.append(x if a == b or x == y else (b - h) * x + (h - a) * y)
    return out
