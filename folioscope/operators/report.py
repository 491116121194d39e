"""The tests of the report: trends, association and citations of two axes, and what human ratings say of an axis.

Each test is a few aggregates over the whole table; what comes back are long tables of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

Row = tuple[str, str, float | None]
#: Ratings that an axis needs, binary ratings for an AUC, papers for the citation model, and what makes an axis valid.
LEAST_RATINGS, LEAST_BINARY, LEAST_CITED, VALID_RHO, VALID_ALPHA = 10, 6, 30, 0.5, 0.6


def trend(df: DataFrame, name: str, axis: str, year: str, cut: int) -> list[Row]:
    """An axis on the year: correlation, line, effect, and the years from `cut` on against those before (Welch, Cohen's d)."""
    r, p, n = stats.pearson(df, year, axis)
    line = {x["term"]: x for x in stats.ols_inference(df, axis, [year]).collect()}
    old, new = F.when(F.col(year) < cut, F.col(axis)), F.when(F.col(year) >= cut, F.col(axis))
    a, va, na, b, vb, nb = df.agg(F.avg(old), F.var_samp(old), F.count(old), F.avg(new), F.var_samp(new), F.count(new)).first()
    out: list[tuple[str, float | None]] = [("n", n), ("pearson_r", r), ("pearson_p", p), ("intercept", line["intercept"]["coefficient"]), ("slope", line[year]["coefficient"]), ("slope_se", line[year]["se"]), ("r2", line[year]["r2"]), ("f2", line[year]["f2"]), ("n_before", na), ("n_after", nb), ("mean_before", a), ("mean_after", b)]
    if na > 1 and nb > 1 and va + vb > 0:
        t, _, p = stats.welch(b, vb, nb, a, va, na)
        out += [("welch_t", t), ("welch_p", p), ("cohens_d", (b - a) / math.sqrt((va + vb) / 2))]
    return [(name, measure, None if x is None else float(x)) for measure, x in out]


def association(df: DataFrame, name: str, axis: str, other: str, year: str) -> list[Row]:
    """An axis on another one and the year: coefficients, what the other adds to the year, and the partial correlation."""
    both = {x["term"]: x for x in stats.ols_inference(df, axis, [other, year]).collect()}
    ab, ac, bc, r2, n = df.agg(F.corr(axis, other), F.corr(axis, year), F.corr(other, year), F.regr_r2(axis, F.col(year).cast("double")), F.count("*")).first()
    partial = (ab - ac * bc) / math.sqrt((1 - ac * ac) * (1 - bc * bc))
    full = both[other]["r2"]
    out = [("n", n), ("r2", full), ("r2_year_only", r2), ("intercept", both["intercept"]["coefficient"]), ("beta_other", both[other]["coefficient"]), ("beta_year", both[year]["coefficient"]), ("se_other", both[other]["se"]), ("p_other", both[other]["p"]), ("partial_r", partial), ("partial_p", stats.correlation_p(partial, n)), ("f2_other", (full - r2) / (1 - full) if full < 1 else float("inf"))]
    return [(name, measure, float(x)) for measure, x in out]


def cited(df: DataFrame, name: str, axes: Iterable[str], year: str, citations: str) -> list[Row]:
    """The logarithm of citations on the axes and the year, and Spearman's rho with each axis; the number of papers alone where it is small."""
    axes = list(axes)
    d = df.where(F.col(citations).cast("double") >= 0).withColumn("_log", F.log1p(F.col(citations).cast("double")))
    n = d.count()
    if n < LEAST_CITED:
        return [(name, "n", float(n))]
    out = [(name, "n", float(n))]
    for x in stats.ols_inference(d, "_log", [*axes, year]).collect():
        out += [(name, f"{m}_{x['term']}", x[c]) for m, c in (("beta", "coefficient"), ("se", "se"), ("p", "p"))]
        r2 = x["r2"]
    out.append((name, "r2", r2))
    for a in axes:
        rho, p, _ = stats.spearman(d, citations, a)
        out += [(name, f"rho_{a}", rho), (name, f"rho_p_{a}", p)]
    return out


def hypotheses(df: DataFrame, t: str, g: str, year: str, citations: str | None, cut: int = 2023) -> DataFrame:
    """hypothesis, measure and value of H1 and H2 (trends of t and g), H3 (g on t and the year) and, with citations, H4; rows without year, t or g take no part."""
    d = df.select(F.col(year).cast("double").alias("year"), F.col(t).cast("double").alias("t"), F.col(g).cast("double").alias("g"), *([F.col(citations).alias("citations")] if citations else [])).dropna(subset=["year", "t", "g"])
    rows = trend(d, "H1", "t", "year", cut) + trend(d, "H2", "g", "year", cut) + association(d, "H3", "g", "t", "year")
    rows += cited(d, "H4", ["t", "g"], "year", "citations") if citations else []
    return df.sparkSession.createDataFrame(rows, "hypothesis string, measure string, value double")


def ratings(form: DataFrame, axis: str, auto: str, raters: tuple[str, str], unsure: tuple[str, str] | None = None) -> DataFrame:
    """axis, measure and value of an axis' scores against two raters: agreement, rank correlation, error after rescaling to 1 to 5, AUC and decision (2 valid, 1 partly, 0 not).

    Items that a rater has no information on, or without a score or rating, take no part; fewer
    than ten give their number alone, and too few ratings at the ends no AUC.
    """
    d = form if unsure is None else form.where(~F.coalesce(F.col(unsure[0]), F.lit(False)) & ~F.coalesce(F.col(unsure[1]), F.lit(False)))
    d = d.select(*(F.expr(f"try_cast(`{c}` AS double)").alias(n) for c, n in ((auto, "auto"), (raters[0], "r1"), (raters[1], "r2")))).dropna().withColumn("human", (F.col("r1") + F.col("r2")) / 2)
    n, low, high = d.agg(F.count("*"), F.min("auto"), F.max("auto")).first()
    if n < LEAST_RATINGS:
        return form.sparkSession.createDataFrame([(axis, "n", float(n))], "axis string, measure string, value double")
    scaled = F.lit(3.0) if high == low else 1 + 4 * (F.col("auto") - low) / (high - low)
    kappa, alpha = stats.weighted_kappa(d, "r1", "r2").first()[0], stats.krippendorff(d, ["r1", "r2"]).first()["alpha"]
    rho, p, _ = stats.spearman(d, "auto", "human")
    mae = d.agg(F.avg(F.abs(scaled - F.col("human")))).first()[0]
    ends = stats.auc(d.where("human <= 2 OR human >= 4"), "auto", F.col("human") >= 4, LEAST_BINARY)
    decision = (rho >= VALID_RHO) + (alpha >= VALID_ALPHA)
    out = [("n", n), ("weighted_kappa", kappa), ("alpha", alpha), ("spearman_r", rho), ("spearman_p", p), ("mae", mae), ("auc", ends), ("decision", decision)]
    return form.sparkSession.createDataFrame([(axis, m, None if x is None else float(x)) for m, x in out], "axis string, measure string, value double")
