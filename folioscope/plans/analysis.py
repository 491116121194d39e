"""Statistics, vectors, topics and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rank as R
from ..operators import report
from ..operators import sampling as S
from ..operators import stats
from ..operators import topics as TP
from ..operators import vectors as V
from .registry import PAPERS, Tables, query, r6

LINES = "l_orderkey, l_linenumber"


@query(f"SELECT {LINES}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS z FROM lineitem")
def zscore(t: Tables) -> DataFrame:
    m = t.lineitem.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return t.lineitem.crossJoin(F.broadcast(m)).select("l_orderkey", "l_linenumber", r6((F.col("l_quantity") - F.col("m")) / F.col("s")).alias("z"))


@query(f"SELECT {LINES}, round(1 + 4 * (l_tax - min(l_tax) OVER p) / (max(l_tax) OVER p - min(l_tax) OVER p), 6) AS likert FROM lineitem WINDOW p AS (PARTITION BY l_returnflag)")
def rescale_likert(t: Tables) -> DataFrame:
    return R.rescaled(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag"), "l_tax", "likert", ["l_returnflag"]).select("l_orderkey", "l_linenumber", r6("likert").alias("likert"))


AXES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(AXES) for b in AXES[i:]))
def pearson_matrix(t: Tables) -> DataFrame:
    return stats.correlation_matrix(t.lineitem, AXES).withColumn("r", r6("r"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
    SELECT round(corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)), 6) AS rho, count(*) AS n FROM r""")
def spearman(t: Tables) -> DataFrame:
    return stats.ranked(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("rho"), F.count("*").alias("n"))


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_extendedprice, l_tax) AS bc FROM lineitem) SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS partial FROM c")
def partial_corr(t: Tables) -> DataFrame:
    c = t.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("ab"), F.corr("l_quantity", "l_tax").alias("ac"), F.corr("l_extendedprice", "l_tax").alias("bc"))
    return c.select(r6(stats.partial_correlation(F.col("ab"), F.col("ac"), F.col("bc"))).alias("partial"))


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t, by Simpson's rule over the angle whose tangent is t / sqrt(df), up to where the density is nothing."""
    low, high = f"atan(abs({t}) / sqrt({df}))", f"least(pi() / 2, atan(abs({t}) / sqrt({df})) + 45 / sqrt({df}))"
    y = f"pow(cos({low} + ({high} - {low}) * i / 4000), {df} - 1)"
    return f"(SELECT 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * ({high} - {low}) / 12000 * sum({y} * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) FROM range(4001) s(i))"


def normal_tail_sql(z: str) -> str:
    """The upper tail of the normal distribution by Simpson's rule over 14 deviations from z."""
    return f"(SELECT 14.0 / 12000 * sum(exp(-({z} + 14.0 * i / 4000) * ({z} + 14.0 * i / 4000) / 2) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / sqrt(2 * pi()) FROM range(4001) s(i))"


@query(f"WITH c AS (SELECT corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem), t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c) SELECT round(r, 6) AS r, n, round({t_tail_sql('t', 'df')}, 6) AS p FROM t")
def pearson_p(t: Tables) -> DataFrame:
    r, p, n = stats.pearson(t.lineitem, "l_quantity", "l_discount")
    return t.spark.createDataFrame([(r, n, p)], "r double, n long, p double").select(r6("r").alias("r"), "n", r6("p").alias("p"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_one(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), r6(F.regr_r2("l_extendedprice", "l_quantity")).alias("r2"))


NORMAL = "c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, avg(a) AS m1, avg(b) AS m2, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM x)"


@query(f"""WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_tax AS DOUBLE) AS b FROM lineitem), {NORMAL}, s AS (SELECT *, aa * bb - ab * ab AS det FROM c),
    f AS (SELECT *, (ay * bb - by_ * ab) / det AS b1, (by_ * aa - ay * ab) / det AS b2, n - 3 AS df FROM s), g AS (SELECT *, (b1 * ay + b2 * by_) / yy AS r2, n * (yy - b1 * ay - b2 * by_) / df AS v FROM f),
    e AS (SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS k, sqrt(v * (1 + (m1 * m1 * bb - 2 * m1 * m2 * ab + m2 * m2 * aa) / det) / n) AS se, * FROM g UNION ALL SELECT 'l_quantity', b1, sqrt(v * bb / det / n), * FROM g UNION ALL SELECT 'l_tax', b2, sqrt(v * aa / det / n), * FROM g), t AS (SELECT *, k / se AS t FROM e)
    SELECT term, round(k, 3) AS coefficient, round(se, 5) AS se, round(t, 3) AS t, round({t_tail_sql('t', 'df')}, 6) AS p, round(r2, 6) AS r2, CAST(n AS BIGINT) AS n, CAST(df AS BIGINT) AS df FROM t""")
def ols_coefficients(t: Tables) -> DataFrame:
    d = stats.ols_inference(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return d.select("term", F.round("coefficient", 3).alias("coefficient"), F.round("se", 5).alias("se"), F.round("t", 3).alias("t"), r6("p").alias("p"), r6("r2").alias("r2"), "n", "df")


@query("""WITH c AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, covar_pop(l_tax, l_tax) AS d, covar_pop(l_quantity, l_extendedprice) AS e, covar_pop(l_tax, l_extendedprice) AS f, var_pop(l_extendedprice) AS v FROM lineitem),
    s AS (SELECT *, (e * d - f * b) / (a * d - b * b) AS b1, (f * a - e * b) / (a * d - b * b) AS b2 FROM c) SELECT round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 3) AS b1, round(b2, 3) AS b2, round((b1 * e + b2 * f) / v, 6) AS r2 FROM s""")
def ols_two(t: Tables) -> DataFrame:
    m = stats.ols(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    row = [(m["intercept"], m["l_quantity"], m["l_tax"], m["r2"])]
    return t.spark.createDataFrame(row, "intercept double, b1 double, b2 double, r2 double").select(*(F.round(c, 3).alias(c) for c in ("intercept", "b1", "b2")), r6("r2").alias("r2"))


@query(f"WITH {PAPERS} SELECT round(regr_r2(ln(1 + cit), year), 6) AS r2, round(regr_r2(ln(1 + cit), year) / (1 - regr_r2(ln(1 + cit), year)), 6) AS f2, 'negligible' AS label FROM papers")
def effect_sizes(t: Tables) -> DataFrame:
    fit = t.papers().agg(F.regr_r2(F.log1p("cit"), F.col("year").cast("double")).alias("r2"))
    f2 = F.col("r2") / (1 - F.col("r2"))
    return fit.select(r6("r2").alias("r2"), r6(f2).alias("f2"), stats.effect_label(f2).alias("label"))


@query(f"WITH {PAPERS} SELECT round(regr_slope(ln(1 + cit), year), 6) AS slope, median(cit) AS median_cit, round(avg(cit), 6) AS mean_cit, max(cit) AS max_cit, count(*) >= 30 AS enough FROM papers")
def log_ols(t: Tables) -> DataFrame:
    return t.papers().agg(r6(F.regr_slope(F.log1p("cit"), F.col("year").cast("double"))).alias("slope"), F.median("cit").alias("median_cit"), r6(F.avg("cit")).alias("mean_cit"), F.max("cit").alias("max_cit"), (F.count("*") >= 30).alias("enough"))


@query(f"""WITH {PAPERS}, s AS (SELECT avg(cit) FILTER (year < 1998) AS ma, var_samp(cit) FILTER (year < 1998) AS va, count(*) FILTER (year < 1998) AS na, avg(cit) FILTER (year >= 1998) AS mb, var_samp(cit) FILTER (year >= 1998) AS vb, count(*) FILTER (year >= 1998) AS nb FROM papers)
    SELECT round(t, 6) AS t, round(df, 3) AS df, round({t_tail_sql('t', 'df')}, 6) AS p, round(d, 6) AS d
    FROM (SELECT (ma - mb) / sqrt(va / na + vb / nb) AS t, (ma - mb) / sqrt((va + vb) / 2) AS d, (va / na + vb / nb) * (va / na + vb / nb) / (va / na * va / na / (na - 1) + vb / nb * vb / nb / (nb - 1)) AS df FROM s)""")
def welch_cohens_d(t: Tables) -> DataFrame:
    early = F.when(F.col("year") < 1998, F.col("cit"))
    late = F.when(F.col("year") >= 1998, F.col("cit"))
    a, va, na, b, vb, nb = t.papers().agg(F.avg(early), F.var_samp(early), F.count(early), F.avg(late), F.var_samp(late), F.count(late)).first()
    x, free, p = stats.welch(a, va, na, b, vb, nb)
    row = t.spark.createDataFrame([(x, free, p, (a - b) / ((va + vb) / 2) ** 0.5)], "t double, df double, p double, d double")
    return row.select(r6("t").alias("t"), F.round("df", 3).alias("df"), r6("p").alias("p"), r6("d").alias("d"))


RANKS = "r AS (SELECT year >= 1998 AS g, rank() OVER (ORDER BY cit) + (count(*) OVER (PARTITION BY cit) - 1) / 2.0 AS v FROM papers)"


@query(f"""WITH {PAPERS}, {RANKS}, s AS (SELECT CAST(sum(v) FILTER (g) AS DOUBLE) AS rs, CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n0 FROM r), ties AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT CAST(count(*) AS HUGEINT) AS c FROM papers GROUP BY cit)),
    u AS (SELECT rs - n1 * (n1 + 1) / 2 AS u, n1 * n0 AS pairs, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s, ties), z AS (SELECT *, (u - pairs / 2 - 0.5) / sd AS z FROM u)
    SELECT u, round(u / pairs, 6) AS auc, round({normal_tail_sql('z')}, 6) AS p FROM z""")
def mann_whitney_u(t: Tables) -> DataFrame:
    late = F.col("year") >= 1998
    p = t.papers().select(F.col("cit").cast("double").alias("cit"), "year")
    u, tail = stats.mann_whitney(p, "cit", late)
    sizes = p.agg(F.count_if(late).cast("double").alias("n1"), F.count_if(~late).cast("double").alias("n0"))
    return sizes.select(F.lit(float(u)).alias("u"), r6(F.lit(float(u)) / (F.col("n1") * F.col("n0"))).alias("auc"), r6(F.lit(tail)).alias("p"))


@query("WITH x AS (SELECT quality AS g, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS v FROM documents JOIN labels USING (doc_id)), s AS (SELECT CAST(sum(v) FILTER (g = 1) AS DOUBLE) AS rs, CAST(count(*) FILTER (g = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 0) AS DOUBLE) AS n0 FROM x) SELECT round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s")
def auc(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("v")).join(t.labels, "doc_id")
    s = stats.ranked(d.select("v", (F.col("quality") == 1).alias("g")), "v").agg(F.sum(F.when(F.col("g"), F.col("v"))).alias("rs"), F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n0"))
    return s.select(r6((F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


RATERS = "x AS (SELECT CAST(1 + quality * 2 + doc_id % 3 AS DOUBLE) AS a, CAST(1 + quality * 2 + doc_id % 2 + toxic AS DOUBLE) AS b FROM labels)"


def raters(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", (1 + F.col("quality") * 2 + F.col("doc_id") % 3).cast("double").alias("a"), (1 + F.col("quality") * 2 + F.col("doc_id") % 2 + F.col("toxic")).cast("double").alias("b"))


@query(f"WITH {RATERS}, o AS (SELECT avg((a - b) * (a - b)) AS o FROM x), e AS (SELECT avg((p.a - q.b) * (p.a - q.b)) AS e FROM x p, x q) SELECT round(1 - o / e, 6) AS kappa FROM o, e")
def weighted_kappa(t: Tables) -> DataFrame:
    return stats.weighted_kappa(raters(t), "a", "b").select(r6("kappa").alias("kappa"))


@query(f"WITH {RATERS}, o AS (SELECT avg((a - b) * (a - b)) AS o FROM x), e AS (SELECT avg((p.a - q.b) * (p.a - q.b)) AS e FROM x p, x q) SELECT round(o, 6) AS observed, round(e, 6) AS expected, round(1 - o / e, 6) AS alpha FROM o, e")
def krippendorff(t: Tables) -> DataFrame:
    """The SQL pairs all items; the query has the expected disagreement in closed form."""
    return stats.krippendorff(raters(t), ["a", "b"]).select(r6("observed").alias("observed"), r6("expected").alias("expected"), r6("alpha").alias("alpha"))


@query(f"WITH {RATERS} SELECT round(avg((p.a - q.b) * (p.a - q.b)), 6) AS expected FROM x p, x q")
def expected_disagreement(t: Tables) -> DataFrame:
    return stats.krippendorff(raters(t), ["a", "b"]).select(r6("expected").alias("expected"))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS s, CAST(1 + quality * 2 + doc_id % 3 AS DOUBLE) AS h FROM documents JOIN labels USING (doc_id)), e AS (SELECT quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS e FROM d),
    q AS (SELECT *, CAST(CASE WHEN s <= e[1] THEN 1 WHEN s <= e[2] THEN 2 WHEN s <= e[3] THEN 3 WHEN s <= e[4] THEN 4 ELSE 5 END AS INTEGER) AS bin FROM d, e)
    SELECT bin, count(*) AS n, round(avg(s), 6) AS mean_score, min(s) AS min_score, max(s) AS max_score, round(avg(h), 6) AS human_mean, round(stddev_pop(h), 6) AS human_sd FROM q GROUP BY 1""")
def calibration_table(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("s")).join(raters(t), "doc_id")
    c = stats.calibration(R.quantile_bins(d, "s", 5, "bin"), "bin", "s", "a")
    return c.select("bin", "n", r6("mean_score").alias("mean_score"), "min_score", "max_score", r6("human_mean").alias("human_mean"), r6("human_sd").alias("human_sd"))


@query(f"WITH {RATERS}, s AS (SELECT 1 + 4 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, b FROM x) SELECT round(avg(abs(a - b)), 6) AS mae FROM s")
def mae_rescaled(t: Tables) -> DataFrame:
    x = raters(t)
    e = x.agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    a = F.when(F.col("hi") == F.col("lo"), 3.0).otherwise(1 + 4 * (F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return x.crossJoin(F.broadcast(e)).agg(r6(F.avg(F.abs(a - F.col("b")))).alias("mae"))


@query(f"WITH {RATERS}, o AS (SELECT avg((a - b) * (a - b)) AS o, corr(a, b) AS r FROM x), e AS (SELECT avg((p.a - q.b) * (p.a - q.b)) AS e FROM x p, x q) SELECT CASE WHEN r >= 0.5 AND 1 - o / e >= 0.6 THEN 'valid' WHEN r >= 0.5 OR 1 - o / e >= 0.6 THEN 'partial' ELSE 'invalid' END AS verdict FROM o, e")
def decision_rule(t: Tables) -> DataFrame:
    alpha = stats.krippendorff(raters(t), ["a", "b"]).select("alpha").crossJoin(raters(t).agg(F.corr("a", "b").alias("r")))
    x, y = F.col("r") >= 0.5, F.col("alpha") >= 0.6
    return alpha.select(F.when(x & y, "valid").when(x | y, "partial").otherwise("invalid").alias("verdict"))


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    years = t.papers().groupBy("year").agg(F.avg("cit").alias("m"))
    return stats.bootstrap(years, ["m"], lambda d: d["m"].mean(), rounds=500)


@query()
def bootstrap_ols(t: Tables) -> DataFrame:
    months = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.avg("o_totalprice").alias("y")).withColumn("x", F.datediff("m", F.lit("1995-01-01")).cast("double")).select("x", "y")
    return stats.bootstrap(months, ["x", "y"], lambda d: float(((d.x - d.x.mean()) * (d.y - d.y.mean())).sum() / max(((d.x - d.x.mean()) ** 2).sum(), 1e-12)), rounds=500)


@query()
def bootstrap_mean_of_rows(t: Tables) -> DataFrame:
    """The mean price of all line items, resampled row by row."""
    d = stats.poisson_bootstrap(t.lineitem, ["l_orderkey", "l_linenumber"], {"x": F.col("l_extendedprice")}, F.col("x") / F.col("n"), rounds=400)
    return d.select(*(F.round(c, 3).alias(c) for c in ("mean", "low", "high")), "rounds")


@query()
def bootstrap_slope_of_rows(t: Tables) -> DataFrame:
    """The slope of price on quantity over all line items, resampled row by row."""
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("n"))
    d = stats.poisson_bootstrap(t.lineitem, ["l_orderkey", "l_linenumber"], {"x": x, "y": y, "xx": x * x, "xy": x * y}, slope, rounds=400)
    return d.select(*(F.round(c, 3).alias(c) for c in ("mean", "low", "high")), "rounds")


H = "h AS (SELECT CAST(year(o_orderdate) AS DOUBLE) AS year, CAST(o_totalprice AS DOUBLE) / 100000 AS t, CAST(o_custkey % 1000 AS DOUBLE) / 100 + CAST(o_totalprice AS DOUBLE) / 300000 AS g, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cit FROM orders)"


def _trend_sql(name: str, axis: str) -> str:
    return f"""SELECT '{name}' AS hypothesis, unnest(['n', 'pearson_r', 'pearson_p', 'intercept', 'slope', 'slope_se', 'r2', 'f2', 'n_before', 'n_after', 'mean_before', 'mean_after', 'welch_t', 'welch_p', 'cohens_d']) AS measure,
        unnest([n, r, {t_tail_sql('tr', 'df')}, i, k, se, r2, r2 / (1 - r2), na, nb, ma, mb, tw, {t_tail_sql('tw', 'dw')}, d]) AS value
        FROM (SELECT *, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS tr, sqrt((1 - r2) * vy / vx / (n - 2)) AS se, (mb - ma) / sqrt(va / na + vb / nb) AS tw, (va / na + vb / nb) * (va / na + vb / nb) / (va / na * va / na / (na - 1) + vb / nb * vb / nb / (nb - 1)) AS dw, (mb - ma) / sqrt((va + vb) / 2) AS d
        FROM (SELECT CAST(count(*) AS DOUBLE) AS n, corr(year, {axis}) AS r, regr_intercept({axis}, year) AS i, regr_slope({axis}, year) AS k, regr_r2({axis}, year) AS r2, var_pop({axis}) AS vy, var_pop(year) AS vx,
        CAST(count(*) FILTER (year < 1998) AS DOUBLE) AS na, CAST(count(*) FILTER (year >= 1998) AS DOUBLE) AS nb, avg({axis}) FILTER (year < 1998) AS ma, avg({axis}) FILTER (year >= 1998) AS mb, var_samp({axis}) FILTER (year < 1998) AS va, var_samp({axis}) FILTER (year >= 1998) AS vb FROM h))"""


@query(f"""WITH {H}, x AS (SELECT g AS y, t AS a, year AS b FROM h), {NORMAL}, s AS (SELECT *, aa * bb - ab * ab AS det FROM c), f AS (SELECT *, (ay * bb - by_ * ab) / det AS b1, (by_ * aa - ay * ab) / det AS b2, ay / sqrt(aa * yy) AS r1, by_ / sqrt(bb * yy) AS r2_, ab / sqrt(aa * bb) AS r3, n - 3 AS df FROM s),
    e AS (SELECT *, (b1 * ay + b2 * by_) / yy AS r2, (r1 - r2_ * r3) / sqrt((1 - r2_ * r2_) * (1 - r3 * r3)) AS partial FROM f), v AS (SELECT *, sqrt((1 - r2) * yy / df * bb / det) AS se, b1 / sqrt((1 - r2) * yy / df * bb / det) AS tb, n - 2 AS dp, partial * sqrt((n - 2) / (1 - partial * partial)) AS tp FROM e),
    h3 AS (SELECT 'H3' AS hypothesis, unnest(['n', 'r2', 'r2_year_only', 'intercept', 'beta_other', 'beta_year', 'se_other', 'p_other', 'partial_r', 'partial_p', 'f2_other']) AS measure, unnest([n, r2, r2_ * r2_, my - b1 * m1 - b2 * m2, b1, b2, se, {t_tail_sql('tb', 'df')}, partial, {t_tail_sql('tp', 'dp')}, (r2 - r2_ * r2_) / (1 - r2)]) AS value FROM v)
    SELECT hypothesis, measure, round(value, 5) AS value FROM ({_trend_sql('H1', 't')} UNION ALL {_trend_sql('H2', 'g')} UNION ALL SELECT * FROM h3)""")
def hypotheses(t: Tables) -> DataFrame:
    """Trends and association of two axes over orders as papers; years from 1998 on against those before."""
    price = F.col("o_totalprice").cast("double")
    d = t.orders.select(F.year("o_orderdate").alias("year"), (price / 100000).alias("a"), ((F.col("o_custkey") % 1000).cast("double") / 100 + price / 300000).alias("b"))
    return report.hypotheses(d, "a", "b", "year", None, 1998).withColumn("value", F.round("value", 5))


@query(f"""WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS auto, CAST(1 + quality * 2 + doc_id % 3 AS DOUBLE) AS a, CAST(1 + quality * 2 + doc_id % 2 + toxic AS DOUBLE) AS b FROM documents JOIN labels USING (doc_id)), y AS (SELECT *, (a + b) / 2 AS human FROM x),
    o AS (SELECT avg((a - b) * (a - b)) AS o, CAST(count(*) AS DOUBLE) AS n FROM y), e AS (SELECT avg((p.a - q.b) * (p.a - q.b)) AS e FROM y p, y q),
    k AS (SELECT CAST(rank() OVER (ORDER BY auto) + (count(*) OVER (PARTITION BY auto) - 1) / 2.0 AS DOUBLE) AS u, CAST(rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2.0 AS DOUBLE) AS v FROM y), c AS (SELECT corr(u, v) AS rho FROM k),
    m AS (SELECT avg(abs(1 + 4 * (auto - lo) / (hi - lo) - human)) AS mae FROM (SELECT *, min(auto) OVER () AS lo, max(auto) OVER () AS hi FROM y)),
    b AS (SELECT human >= 4 AS g, rank() OVER (ORDER BY auto) + (count(*) OVER (PARTITION BY auto) - 1) / 2.0 AS v FROM y WHERE human <= 2 OR human >= 4), s AS (SELECT CAST(sum(v) FILTER (g) AS DOUBLE) AS rs, CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n0 FROM b),
    z AS (SELECT *, n - 2 AS df, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM o, e, c, m, s)
    SELECT 'length' AS axis, unnest(['n', 'weighted_kappa', 'alpha', 'spearman_r', 'spearman_p', 'mae', 'auc', 'decision']) AS measure, unnest([n, round(1 - o / e, 6), round(1 - o / e, 6), round(rho, 6), round({t_tail_sql('t', 'df')}, 6), round(mae, 6), round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6), CAST(CAST(rho >= 0.5 AS INTEGER) + CAST(1 - o / e >= 0.6 AS INTEGER) AS DOUBLE)]) AS value FROM z""")
def validation_metrics(t: Tables) -> DataFrame:
    """The lengths of documents as scores of an axis, against two ratings of each labelled document."""
    form = t.documents.select("doc_id", "n_chars").join(raters(t), "doc_id")
    return report.ratings(form, "length", "n_chars", ("a", "b")).withColumn("value", r6("value"))


COHORTS = [(1994.0, 1995.0, "1995", 10), (1995.0, 1996.0, "1996", 25), (1996.0, 1998.0, "1997-98", 40), (1998.0, 2001.0, "1999-01", 55)]


@query(f"""WITH {PAPERS}, d AS (SELECT id, year, cit, o_custkey AS w, sha256('42:' || id) AS o, CASE WHEN year <= 1995 THEN '1995' WHEN year <= 1996 THEN '1996' WHEN year <= 1998 THEN '1997-98' ELSE '1999-01' END AS cohort, CASE WHEN year <= 1995 THEN 10 WHEN year <= 1996 THEN 25 WHEN year <= 1998 THEN 40 ELSE 55 END AS n FROM papers WHERE year > 1994 AND year <= 2001),
    e AS (SELECT cohort, quantile_cont(cit, [1.0 / 3, 2.0 / 3]) AS a, quantile_cont(w, [1.0 / 3, 2.0 / 3]) AS b, count(*) AS size FROM d GROUP BY 1), c AS (SELECT d.*, size, CASE WHEN cit <= a[1] THEN 1 WHEN cit <= a[2] THEN 2 ELSE 3 END AS x, CASE WHEN w <= b[1] THEN 1 WHEN w <= b[2] THEN 2 ELSE 3 END AS y FROM d JOIN e USING (cohort)),
    r AS (SELECT *, CASE WHEN size <= n OR row_number() OVER (PARTITION BY cohort, x, y ORDER BY o, id) <= greatest(1, n // 9) THEN 0 ELSE 1 END AS i FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY i, o, id) AS rank FROM r)
    SELECT id, cohort FROM k WHERE i = 0 OR rank <= n ORDER BY o, id LIMIT 130""")
def cohort_sample(t: Tables) -> DataFrame:
    return S.cohort_sample(t.papers(), COHORTS, "year", ("cit", "o_custkey"), "id", 130).select("id", "cohort")


def poles(t: Tables, low: int = 0, high: int = 1, each: int = 5) -> DataFrame:
    """The first vectors of two labels as the poles' prototypes."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    d = t.embeddings.where(F.col("label").isin(low, high)).withColumn("r", rank).where(F.col("r") <= each)
    return d.select(F.when(F.col("label") == high, "high").otherwise("low").alias("pole"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))


POLES = "p AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE label IN (0, 1)), q AS (SELECT * FROM p WHERE r <= 5), m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM q, range(1, 65) t(i) GROUP BY 1, 2)"
AXIS = f"{POLES}, g AS (SELECT i, sum(CASE WHEN label = 1 THEN x ELSE -x END) AS d, sum(x) / 2 AS mid FROM m GROUP BY 1), u AS (SELECT i, d / sqrt(sum(d * d) OVER ()) AS a, mid FROM g), c AS (SELECT sum(a * mid) AS center FROM u)"
PROJECTION = f"{AXIS}, e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), s AS (SELECT vec_id, any_value(label) AS label, sum(v * a) AS score FROM e JOIN u USING (i) GROUP BY 1)"


@query(f"WITH {PROJECTION} SELECT vec_id, round(score, 6) AS score, round(score - center, 6) AS centered FROM s, c")
def axis_projection(t: Tables) -> DataFrame:
    a = V.axis(poles(t))
    d = V.project(V.project(t.embeddings.select("vec_id", "embedding"), "embedding", a, "score"), "embedding", a, "centered", True)
    return d.select("vec_id", r6("score").alias("score"), r6("centered").alias("centered"))


@query(f"WITH {PROJECTION}, r AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS a, row_number() OVER (ORDER BY score, vec_id) AS b FROM s) SELECT vec_id, round(score, 6) AS score, CASE WHEN a <= 5 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE a <= 5 OR b <= 5")
def extremes_both_ends(t: Tables) -> DataFrame:
    d = V.project(t.embeddings.select("vec_id", "embedding"), "embedding", V.axis(poles(t)), "score")
    top, bottom = d.orderBy(F.desc("score"), "vec_id").limit(5), d.orderBy("score", "vec_id").limit(5)
    return top.select("vec_id", r6("score").alias("score"), F.lit("top").alias("side")).union(bottom.select("vec_id", r6("score"), F.lit("bottom")))


@query(f"WITH {PROJECTION} SELECT label AS cluster, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(max(score) - min(score), 6) AS range FROM s GROUP BY 1")
def axis_tournament(t: Tables) -> DataFrame:
    d = V.project(t.embeddings, "embedding", V.axis(poles(t)), "score")
    return d.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"), r6(F.stddev_pop("score")).alias("std"), r6(F.max("score") - F.min("score")).alias("range"))


PAIR = "f AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, embedding FROM embeddings), pos AS (SELECT vec_id AS name, embedding FROM f WHERE label < 4 AND r = 1), neg AS (SELECT vec_id AS name, embedding FROM f WHERE label >= 4 AND r = 1)"
DOT = "list_sum(list_transform(list_zip(d.embedding, p.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"""WITH {PAIR}, a AS (SELECT d.vec_id, {DOT} AS s FROM embeddings d, pos p), b AS (SELECT d.vec_id, {DOT} AS s FROM embeddings d, neg p),
    x AS (SELECT vec_id, list_avg(list_slice(list_reverse_sort(list(s)), 1, 2)) AS positive FROM a GROUP BY 1), y AS (SELECT vec_id, max(s) AS negative FROM b GROUP BY 1)
    SELECT vec_id, round(positive, 6) AS positive, round(negative, 6) AS negative, round(positive - negative, 6) AS margin FROM x JOIN y USING (vec_id)""")
def prototype_similarity(t: Tables) -> DataFrame:
    first = t.embeddings.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("name"), F.col("embedding").alias("vector")), "vec_id").alias("s")).select("label", "s.*")
    d = V.prototype_scores(t.embeddings.select("vec_id", "embedding"), "embedding", first.where("label < 4").drop("label"), first.where("label >= 4").drop("label"))
    return d.select("vec_id", *(r6(c).alias(c) for c in ("positive", "negative", "margin")))


@query(f"WITH {PAIR} SELECT d.vec_id, p.name, round({DOT}, 6) AS sim FROM embeddings d, pos p")
def prototype_cross_dot(t: Tables) -> DataFrame:
    first = t.embeddings.where("label < 4").groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("name"), F.col("embedding").alias("vector")), "vec_id").alias("s")).select("s.*")
    names = first.agg(F.array_sort(F.collect_list("name")).alias("names"))
    d = V.similarities(t.embeddings.select("vec_id", "embedding"), "embedding", first).crossJoin(F.broadcast(names))
    return d.select("vec_id", F.explode(F.arrays_zip("names", "sims")).alias("z")).select("vec_id", F.col("z.names").alias("name"), r6("z.sims").alias("sim"))


@query(f"""WITH {PROJECTION}, qx AS (SELECT vec_id AS name, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM q, range(1, 65) t(i)), w AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM qx GROUP BY 1, 2),
    v AS (SELECT o.name, o.i, sum(CASE WHEN w.label = 1 THEN 1 ELSE -1 END * CASE WHEN w.label = o.label THEN (w.s - o.x) / (w.n - 1) ELSE w.s / w.n END) AS d FROM qx o JOIN w USING (i) GROUP BY 1, 2),
    va AS (SELECT name, i, d / sqrt(sum(d * d) OVER (PARTITION BY name)) AS a FROM v), sc AS (SELECT name, vec_id, sum(e.v * va.a) AS score FROM e JOIN va USING (i) GROUP BY 1, 2),
    r AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY s.score) + (count(*) OVER (PARTITION BY name, s.score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY name ORDER BY sc.score) + (count(*) OVER (PARTITION BY name, sc.score) - 1) / 2.0 AS b FROM sc JOIN s USING (vec_id)),
    rho AS (SELECT name, corr(a, b) AS rho FROM r GROUP BY 1)
    SELECT CAST(name AS VARCHAR) AS left_out, round(rho, 6) AS rho, CASE WHEN rho > 0.70 THEN 'PASS' WHEN rho > 0.60 THEN 'MARGINAL' ELSE 'FAIL' END AS band FROM rho""")
def loo_stability(t: Tables) -> DataFrame:
    variants = V.leave_one_out(poles(t)).withColumn("center", F.lit(0.0))
    base = V.axis(poles(t))
    d = V.project(t.embeddings.select("vec_id", "embedding"), "embedding", base, "primary")
    whole = R.average_ranks(d.select("vec_id", "primary"), "primary", "a").select("vec_id", "a")  # the same whichever is left out
    each = d.crossJoin(F.broadcast(variants)).select("left_out", "vec_id", V.dot(F.col("embedding"), F.col("axis")).alias("score"))
    ranks = R.average_ranks(each, "score", "b", ["left_out"]).join(whole, "vec_id")
    rho = ranks.groupBy("left_out").agg(F.corr("a", "b").alias("rho"))
    return rho.select("left_out", r6("rho").alias("rho"), V.stability_band(F.col("rho")).alias("band"))


@query("WITH x AS (SELECT label AS grp, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), v AS (SELECT grp, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM x GROUP BY 1) SELECT grp, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt((a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + c * c)), 6) AS major, round(sqrt(greatest((a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + c * c), 0)), 6) AS minor FROM v")
def ellipse(t: Tables) -> DataFrame:
    d = t.embeddings.select(F.col("label").alias("grp"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return V.ellipse(d, "x", "y", "grp").select("grp", *(r6(c).alias(c) for c in ("cx", "cy", "major", "minor")))


@query("SELECT label AS grp, CAST(i - 1 AS INTEGER) AS component, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def centroids(t: Tables) -> DataFrame:
    return V.mean_vectors(t.embeddings, "embedding", "label").select(F.col("label").alias("grp"), F.posexplode("mean").alias("component", "m")).select("grp", "component", r6("m").alias("mean"))


@query("WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) SELECT a.label AS grp, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS drift FROM m a JOIN m b ON a.i = b.i AND b.label = 0 GROUP BY 1")
def centroid_drift(t: Tables) -> DataFrame:
    m = V.mean_vectors(t.embeddings, "embedding", "label")
    base = m.where("label = 0").select(F.col("mean").alias("b"))
    return m.crossJoin(F.broadcast(base)).select(F.col("label").alias("grp"), r6(V.norm(V.minus(F.col("mean"), F.col("b")))).alias("drift"))


@query()
def kmeans_silhouette(t: Tables) -> DataFrame:
    found, k, score = V.kmeans(t.embeddings, "embedding", 5)
    return found.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("k", F.lit(k)).withColumn("silhouette", r6(F.lit(score)))


@query()
def pca_projection(t: Tables) -> DataFrame:
    return V.pca2(t.embeddings, "embedding").select("vec_id", r6("x").alias("x"), r6("y").alias("y"))


_WORDS = "list_filter(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z\\-]{2,}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in TP.STOPWORDS) + "], w))"
_GRAMS = "list_concat(" + ", ".join(f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))" for n in (2, 3)) + ")"


@query(f"""WITH d AS (SELECT source AS grp, {_WORDS} AS w FROM documents), p AS (SELECT grp, unnest({_GRAMS}) AS phrase FROM d), tf AS (SELECT grp, phrase, count(*) AS tf FROM p GROUP BY 1, 2), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT grp, phrase, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS score FROM tf JOIN df USING (phrase), (SELECT count(DISTINCT source) AS n FROM documents) WHERE df <= n * 0.8),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, phrase) AS k FROM s) SELECT grp, phrase, tf, df, round(score, 6) AS score FROM r WHERE k <= 10""")
def ctfidf_topics(t: Tables) -> DataFrame:
    s = TP.class_tfidf(t.documents, "text", "source").withColumnRenamed("group", "grp")
    k = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("score", 9)), "phrase"))
    return s.withColumn("k", k).where("k <= 10").select("grp", "phrase", "tf", "df", r6("score").alias("score"))


_TITLE = "array_to_string(list_transform(string_split(p, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: CASE WHEN v = '' THEN '' ELSE upper(v[1]) || v[2:] END), '-')), ' ')"
for _a, _b in T.PHRASE_ACRONYMS.items():
    _TITLE = f"regexp_replace({_TITLE}, '\\b{_a}\\b', '{_b}', 'g')"
_LABEL = "CASE " + " ".join(f"WHEN p = '{a}' THEN '{b}'" for a, b in T.PHRASES.items()) + f" ELSE {_TITLE} END"


@query(f"""WITH RECURSIVE d AS (SELECT source AS grp, {_WORDS} AS w FROM documents), p AS (SELECT grp, unnest({_GRAMS}) AS phrase FROM d), tf AS (SELECT grp, phrase, count(*) AS tf FROM p GROUP BY 1, 2), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT grp, phrase, tf * (ln((1 + n) / (1 + df)) + 1) AS score FROM tf JOIN df USING (phrase), (SELECT count(DISTINCT source) AS n FROM documents) WHERE df <= n * 0.8 AND length(phrase) >= 4 AND NOT regexp_matches(phrase, ' using | based on | et al|this ')),
    r AS (SELECT grp, phrase, row_number() OVER (PARTITION BY grp ORDER BY score DESC, phrase) AS k FROM s QUALIFY k <= 30),
    g(grp, k, kept, seen) AS (SELECT DISTINCT grp, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM r UNION ALL
        SELECT g.grp, r.k, CASE WHEN skip THEN kept ELSE list_append(kept, phrase) END, CASE WHEN skip THEN seen ELSE list_distinct(list_concat(seen, tokens)) END
        FROM g JOIN (SELECT *, list_distinct(string_split(phrase, ' ')) AS tokens FROM r) r ON r.grp = g.grp AND r.k = g.k + 1,
        LATERAL (SELECT len(list_intersect(tokens, seen)) AS shared), LATERAL (SELECT list_contains(kept, phrase) OR len(kept) >= 5 OR (len(kept) > 0 AND (shared = len(tokens) OR shared >= greatest(2, len(tokens) - 1))) AS skip)),
    l AS (SELECT grp, arg_max(kept, k) AS kept FROM g GROUP BY 1)
    SELECT grp, array_to_string(list_transform(kept, lambda p: {_LABEL}), ' | ') AS phrases FROM l""")
def topic_phrases(t: Tables) -> DataFrame:
    return TP.topics(t.documents, "text", "source").select(F.col("group").alias("grp"), F.array_join("phrases", " | ").alias("phrases"))


@query(f"""WITH d AS (SELECT lang AS grp, list_filter(regexp_extract_all(lower(text), '\\b[a-z]{{4,}}\\b'), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in TP.STOPWORDS)}], w)) AS w FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')),
    c AS (SELECT grp, token, count(*) AS n FROM (SELECT grp, unnest(w) AS token FROM d) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, token) AS rank FROM c) SELECT grp, token, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def token_counts(t: Tables) -> DataFrame:
    d = t.documents.where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return TP.token_counts(d, "text", "lang").withColumnRenamed("group", "grp")


@query(f"""WITH d AS (SELECT lang AS grp, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains([{", ".join(f"'{w}'" for w in TP.STOPWORDS)}], w)) AS w FROM documents),
    c AS (SELECT grp, token, count(*) AS n FROM (SELECT grp, unnest(w) AS token FROM d) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, token) AS rank FROM c) SELECT grp, token, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def token_counts_all(t: Tables) -> DataFrame:
    """As token_counts, over all documents; word ends are Unicode's, so that no token is cut at an accent."""
    return TP.token_counts(t.documents, "text", "lang", pattern=r"(?U)\b[a-z]{4,}\b").withColumnRenamed("group", "grp")


@query("WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT *, 130.0 * size / sum(size) OVER () AS q FROM s), r AS (SELECT *, row_number() OVER (ORDER BY CAST(q AS DOUBLE) - floor(CAST(q AS DOUBLE)) DESC, source) AS k, 130 - sum(floor(CAST(q AS DOUBLE))) OVER () AS rest FROM q) SELECT source, size, CAST(floor(CAST(q AS DOUBLE)) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def hamilton_allocation(t: Tables) -> DataFrame:
    return S.hamilton(t.documents.groupBy("source").agg(F.count("*").alias("size")), "size", 130, "source")


def sample_sql(n: int, seed: str, table: str = "documents") -> str:
    return f"""s AS (SELECT lang, count(*) AS size FROM {table} GROUP BY 1), q AS (SELECT *, CAST({n}.0 AS DOUBLE) * size / sum(size) OVER () AS q FROM s), h AS (SELECT lang, floor(q) + CASE WHEN row_number() OVER (ORDER BY q - floor(q) DESC, lang) <= {n} - sum(floor(q)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
        o AS (SELECT doc_id, lang, sha256('{seed}:' || doc_id) AS o FROM {table}), r AS (SELECT o.*, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS rn FROM o) SELECT doc_id, r.lang FROM r JOIN h USING (lang) ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, o, doc_id LIMIT {n}"""


@query(f"WITH {sample_sql(100, '42')}")
def stratified_sample(t: Tables) -> DataFrame:
    return S.stratified(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 100)


@query(f"WITH a AS (WITH {sample_sql(20, '42:0')}), rest AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)), b AS (WITH {sample_sql(100, '42:1', 'rest')}) SELECT 'pilot' AS part, doc_id FROM a UNION ALL SELECT 'main', doc_id FROM b")
def disjoint_samples(t: Tables) -> DataFrame:
    pilot, main = S.disjoint(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", [20, 100])
    return pilot.select(F.lit("pilot").alias("part"), "doc_id").union(main.select(F.lit("main"), "doc_id"))


@query("""WITH e AS (SELECT quantile_cont(n_chars, 1.0 / 3) AS a, quantile_cont(n_chars, 2.0 / 3) AS b FROM documents), d AS (SELECT doc_id, lang, CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= b THEN 2 ELSE 3 END AS tercile, sha256('42:' || doc_id) AS o FROM documents, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, tercile ORDER BY o, doc_id) AS rn FROM d) SELECT doc_id, CAST(tercile AS INTEGER) AS tercile FROM r WHERE rn <= 12 ORDER BY o, doc_id LIMIT 130""")
def tercile_sample(t: Tables) -> DataFrame:
    d = R.quantile_bins(t.documents.select("doc_id", "lang", "n_chars"), "n_chars", 3, "tercile")
    return S.cell_sample(d, ["lang", "tercile"], "doc_id", 12, 130).select("doc_id", "tercile")


@query("""WITH s AS (SELECT lang, source, count(*) AS size FROM documents GROUP BY 1, 2), q AS (SELECT *, CAST(120.0 AS DOUBLE) * size / sum(size) OVER () AS q FROM s),
    h AS (SELECT lang, source, floor(q) + CASE WHEN row_number() OVER (ORDER BY q - floor(q) DESC, lang, source) <= 120 - sum(floor(q)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
    r AS (SELECT doc_id, lang, source, sha256('42:' || doc_id) AS o, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents)
    SELECT doc_id, lang, source FROM r JOIN h USING (lang, source) ORDER BY CASE WHEN rn = 1 THEN 0 WHEN rn <= quota THEN 1 ELSE 2 END, o, doc_id LIMIT 120""")
def one_per_cell_sample(t: Tables) -> DataFrame:
    return S.one_per_cell(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 120)


@query("SELECT doc_id, 'V' || upper(left(sha256('123:' || doc_id), 8)) AS form_id FROM documents")
def row_ids(t: Tables) -> DataFrame:
    return S.row_ids(t.documents.select("doc_id"), "doc_id")


@query(f"""WITH RECURSIVE {PAPERS}, y AS (SELECT year, count(*) AS n FROM papers GROUP BY 1), months AS (SELECT CAST(year AS VARCHAR) AS name, n FROM y),
    g(l, least, step) AS (SELECT list({{'name': CAST(year AS VARCHAR), 'n': n}} ORDER BY year), max(n) * 9 // 10, 0 FROM y UNION ALL
        SELECT list_concat(list_concat(l[1:a - 1], [{{'name': l[a].name || '+' || l[a + 1].name, 'n': l[a].n + l[a + 1].n}}]), l[a + 2:]), least, step + 1
        FROM g, LATERAL (SELECT list_transform(l, lambda x: x.n) AS ns), LATERAL (SELECT list_position(ns, list_min(ns)) AS k),
        LATERAL (SELECT CASE WHEN k = 1 THEN 1 WHEN k = len(l) THEN k - 1 WHEN ns[k - 1] <= ns[k + 1] THEN k - 1 ELSE k END AS a) WHERE len(l) > 1 AND list_min(ns) < least),
    e AS (SELECT unnest(arg_max(l, step)) AS x FROM g)
    SELECT CAST(unnest(string_split(x.name, '+')) AS VARCHAR) AS stratum, x.name AS merged FROM e""")
def merged_strata(t: Tables) -> DataFrame:
    sizes = [tuple(r) for r in t.papers().groupBy("year").count().orderBy("year").collect()]  # a row for each year
    names = S.merge_small([(str(y), n) for y, n in sizes], max(n for _, n in sizes) * 9 // 10 if sizes else 0)
    return t.spark.createDataFrame(sorted(names.items()) or [], "stratum string, merged string")
