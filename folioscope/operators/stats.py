"""Statistics from one-pass sufficient sums; p-values are arithmetic on the few scalars that result.

Functions that return a DataFrame stay lazy; those that return numbers run one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import by_value


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def correlation_p(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) if n > 2 else float("nan")


def pearson(df: DataFrame, x: str, y: str) -> tuple[float, float, int]:
    """r, two-sided p and n of the rows that have both."""
    r, n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y), F.count("*")).first()
    return (0.0, 1.0, n) if r is None or math.isnan(r) else (r, correlation_p(r, n), n)


def ranked(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all the columns, with those as average ranks, which come from distinct values by ranges."""
    df = rows = df.dropna(subset=list(columns))
    for c in columns:
        ranks = by_value(rows.select(c), c).select(F.col(c).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias("_r"))
        df = df.join(ranks, F.col(c) == F.col("_v")).drop(c, "_v").withColumnRenamed("_r", c)
    return df


def spearman(df: DataFrame, x: str, y: str) -> tuple[float, float, int]:
    return pearson(ranked(df.select(F.col(x).alias("x"), F.col(y).alias("y")), "x", "y"), "x", "y")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b and r of each pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.corr(a, b).alias(f"_{n}") for n, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{n}").alias("r")) for n, (a, b) in enumerate(pairs)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def partial_correlation(ab: Column, ac: Column, bc: Column) -> Column:
    return (ab - ac * bc) / F.sqrt((1 - ac * ac) * (1 - bc * bc))


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> dict[str, float]:
    """Coefficients, r2 and n of least squares with an intercept, from one aggregate of centred sums."""
    names = [*xs, y]
    clean = df.dropna(subset=names)
    cov = clean.agg(F.count("*"), *(F.avg(c) for c in names), *(F.covar_pop(a, b) for a in names for b in names)).first()
    n, k = cov[0], len(names)
    if n < len(names):
        return {"n": n, "r2": float("nan")}
    mean = np.array(cov[1 : 1 + k], dtype=float)
    c = np.array(cov[1 + k :], dtype=float).reshape(k, k)
    beta = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
    r2 = float(beta @ c[:-1, -1] / c[-1, -1]) if c[-1, -1] > 0 else 0.0
    return {"n": n, "intercept": float(mean[-1] - beta @ mean[:-1]), **dict(zip(xs, map(float, beta), strict=True)), "r2": r2}


def ols_inference(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """term (intercept first), coefficient, standard error, t and two-sided p of each, and r2, f2, n and degrees of freedom of the fit.

    All come from one aggregate of centred sums: the inverse of the normal matrix has the variances.
    Rows with a null take no part.  With too few rows for an error everything but n is NaN; a
    predictor that others make up has no inverse and raises.
    """
    names = [*xs, y]
    clean = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    row = clean.agg(F.count("*"), *(F.avg(c) for c in names), *(F.covar_pop(a, b) for a in names for b in names)).first()
    n, k = row[0], len(names)
    free, nan = n - k, float("nan")
    schema = "term string, coefficient double, se double, t double, p double, r2 double, f2 double, n long, df long"
    terms = ["intercept", *xs]
    if free < 1:
        return df.sparkSession.createDataFrame([(t, nan, nan, nan, nan, nan, nan, n, free) for t in terms], schema)
    mean, c = np.array(row[1 : 1 + k], dtype=float), np.array(row[1 + k :], dtype=float).reshape(k, k)
    scale = np.sqrt(np.diag(c)[:-1])
    within = c[:-1, :-1] / np.outer(scale, scale) if (scale > 0).all() else None
    if within is None or np.linalg.cond(within) > 1e12:
        raise ValueError("predictors that are constant or made up of others")
    inverse = np.linalg.inv(within) / np.outer(scale, scale)
    beta = inverse @ c[:-1, -1]
    left = max(0.0, float(c[-1, -1] - beta @ c[:-1, -1]))
    r2 = 1 - left / float(c[-1, -1]) if c[-1, -1] > 0 else 0.0
    var = left * n / free
    coefficients = [float(mean[-1] - beta @ mean[:-1]), *map(float, beta)]
    errors = [math.sqrt(var * (1 + mean[:-1] @ inverse @ mean[:-1]) / n), *(math.sqrt(var * inverse[i, i] / n) for i in range(len(xs)))]
    ts = [b / e if e > 0 else math.copysign(float("inf"), b) for b, e in zip(coefficients, errors, strict=True)]
    rows = [(t, b, e, x, t_tail(x, free) if math.isfinite(x) else 0.0, r2, cohens_f2(r2), n, free) for t, b, e, x in zip(terms, coefficients, errors, ts, strict=True)]
    return df.sparkSession.createDataFrame(rows, schema)


def cohens_f2(r2: float) -> float:
    return r2 / (1 - r2) if r2 < 1 else float("inf")


def effect_label(f2: Column) -> Column:
    return F.when(f2 >= 0.35, "large").when(f2 >= 0.15, "medium").when(f2 >= 0.02, "small").otherwise("negligible")


def welch(mean_a: float, var_a: float, n_a: int, mean_b: float, var_b: float, n_b: int) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p."""
    a, b = var_a / n_a, var_b / n_b
    t = (mean_a - mean_b) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n_a - 1) + b * b / (n_b - 1))
    return t, df, t_tail(t, df)


def mann_whitney(df: DataFrame, value: str, group: Column) -> tuple[float, float]:
    """U of the rows in the group and p of the alternative that they are greater; ties and continuity corrected."""
    r = ranked(df.select(F.col(value).alias("v"), F.col(value).alias("raw"), group.alias("g")), "v")
    row = r.agg(F.count_if("g"), F.count_if(~F.col("g")), F.sum(F.when(F.col("g"), F.col("v")))).first()
    ties = r.groupBy("raw").count().agg(F.sum(F.expr("power(count, 3) - count"))).first()[0] or 0.0
    n1, n0, ranks = row[0], row[1], row[2] or 0.0
    u = ranks - n1 * (n1 + 1) / 2
    n = n1 + n0
    if not n1 or not n0:
        return u, float("nan")
    sd = math.sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1))))
    return u, normal_tail((u - n1 * n0 / 2 - 0.5) / sd) if sd > 0 else 1.0


def auc(df: DataFrame, score: str, positive: Column, least: int = 6) -> float | None:
    """Area under the ROC curve by ranks; none with fewer than `least` rows or one class."""
    r = ranked(df.select(F.col(score).alias("v"), positive.alias("g")), "v").agg(F.count_if("g"), F.count_if(~F.col("g")), F.sum(F.when(F.col("g"), F.col("v")))).first()
    if r[0] + r[1] < least or not r[0] or not r[1]:
        return None
    return (r[2] - r[0] * (r[0] + 1) / 2) / (r[0] * r[1])


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """kappa with quadratic weights: one minus the mean squared gap over the mean that margins alone would give."""
    d = df.dropna(subset=[a, b])
    sums = d.agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("o"), (F.avg(F.col(a) * F.col(a)) + F.avg(F.col(b) * F.col(b)) - 2 * F.avg(a) * F.avg(b)).alias("e"))
    return sums.select(F.when(F.col("e") == 0, 1.0).otherwise(1 - F.col("o") / F.col("e")).alias("kappa"))


def krippendorff(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """alpha with squared gaps over items that all raters rated; the expected gap has a closed form."""
    d = df.dropna(subset=list(raters))
    pairs = [(a, b) for i, a in enumerate(raters) for b in raters[i + 1 :]]
    square = lambda c: F.avg(F.col(c).cast("double") * F.col(c))
    observed = sum((F.avg(F.pow(F.col(a) - F.col(b), 2)) for a, b in pairs), F.lit(0.0)) / len(pairs)
    expected = sum((square(a) + square(b) - 2 * F.avg(a) * F.avg(b) for a, b in pairs), F.lit(0.0)) / len(pairs)
    both = d.agg(observed.alias("observed"), expected.alias("expected"))
    alpha = F.when(F.col("expected") < 1e-9, F.when(F.col("observed") < 1e-9, 1.0).otherwise(0.0)).otherwise(1 - F.col("observed") / F.col("expected"))
    return both.withColumn("alpha", alpha)


def calibration(df: DataFrame, bins: str, score: str, human: str) -> DataFrame:
    return df.where(F.col(bins).isNotNull()).groupBy(bins).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(human).alias("human_mean"), F.stddev_pop(human).alias("human_sd"))


def bootstrap(df: DataFrame, columns: Sequence[str], statistic: Callable[[pd.DataFrame], float], rounds: int = 2000, seed: int = 42, limit: int = 100_000) -> DataFrame:
    """mean, low and high (2.5 and 97.5 per cent) of a statistic over resamples, for samples of at most `limit` rows.

    The rows are sent to the tasks, so their number is checked; replicates are shared out.
    """
    spark = df.sparkSession
    rows = df.select(*columns).dropna().limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows; resample an aggregate instead")
    rows = rows.sort_values(list(columns)).reset_index(drop=True)
    sent = spark.sparkContext.broadcast(rows)

    def run(batches):
        for batch in batches:
            base = sent.value
            out = []
            for b in batch["id"]:
                pick = np.random.default_rng([seed, int(b)]).integers(0, len(base), len(base)) if len(base) else []
                out.append(float(statistic(base.iloc[pick])) if len(base) else float("nan"))
            yield pd.DataFrame({"value": out})

    values = spark.range(rounds).mapInPandas(run, "value double").where(~F.isnan("value"))
    return values.agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.025)").alias("low"), F.expr("percentile(value, 0.975)").alias("high"))


#: The distribution function of Poisson(1); what lies above its last step has a chance of 1e-17.
POISSON_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_weights(tags: np.ndarray, rounds: int) -> np.ndarray:
    """How often each row, by its 64-bit tag, is drawn in each round: Poisson(1) from a mix of tag and round."""
    with np.errstate(over="ignore"):
        x = tags.astype(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON_STEPS, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def poisson_bootstrap(df: DataFrame, key: Sequence[str], sums: dict[str, Column], statistic: Column, rounds: int = 500, seed: int = 42) -> DataFrame:
    """mean, low and high (2.5 and 97.5 per cent) of a statistic of weighted sums over resamples of any number of rows, and rounds.

    Each row is drawn Poisson(1) times in each round, by a hash of its key, so a resample needs no
    row but its own and is the same however the rows are dealt.  `statistic` is an expression over
    the names of `sums` and n, the weighted number of rows.  One pass: a task returns its sums for
    each round.  Rows with a null among the sums take no part; rows of one key are drawn together;
    without rows there is one row of nulls.
    """
    names = ["n", *sums]
    rows = df.select(F.xxhash64(F.lit(seed), *(F.col(k) for k in key)).alias("_tag"), *(c.cast("double").alias(n) for n, c in sums.items())).dropna(subset=list(sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rounds, len(names)))
        for b in batches:
            tags = b.column(0).to_numpy()
            x = np.column_stack([np.ones(b.num_rows), *(b.column(i).to_numpy() for i in range(1, b.num_columns))])
            for s in range(0, len(tags), 2048):
                total += poisson_weights(tags[s : s + 2048], rounds).T @ x[s : s + 2048]
        if total[:, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), *(pa.array(total[:, i]) for i in range(len(names)))], names=["round", *names])

    parts = rows.mapInArrow(run, ", ".join(["round int", *(f"{n} double" for n in names)]))
    values = parts.groupBy("round").agg(*(F.sum(n).alias(n) for n in names)).select(statistic.alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    return values.agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.count("*").alias("rounds"))
