"""Citation impact, cohorts, concentration and pivots over papers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import biblio as B
from ..operators import funnel
from ..operators import rank as R
from ..session import shared_folder
from .registry import PAPERS, Tables, query, r6

#: The order years run from 1995 to 2001; cohorts part before 1998.
BANDS = [(1994, 1996, "1995-96"), (1996, 1998, "1997-98"), (1998, 2001, "1999-01")]
BAND_SQL = "CASE WHEN year <= 1994 THEN NULL WHEN year <= 1996 THEN '1995-96' WHEN year <= 1998 THEN '1997-98' WHEN year <= 2001 THEN '1999-01' END"


def profile():
    return [F.count("*").alias("n"), r6(100.0 * F.count_if(F.col("cit") > 200) / F.count("*")).alias("pct_cited"), F.median("cit").alias("median_cit"), r6(F.avg("cit")).alias("mean_cit")]


PROFILE = "count(*) AS n, round(100.0 * count(*) FILTER (cit > 200) / count(*), 6) AS pct_cited, median(cit) AS median_cit, round(avg(cit), 6) AS mean_cit"


@query(f"""WITH {PAPERS} SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(l_orderkey) AS n, round(100.0 * avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS pct_pos,
    round(avg(l_discount), 6) AS mean_e, round(avg(l_tax), 6) AS mean_g FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1""")
def temporal_profile(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("year", F.year("l_shipdate")).where(F.col("year").between(1995, 2001))
    return d.groupBy("year").agg(F.count("l_orderkey").alias("n"), r6(100.0 * F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0))).alias("pct_pos"), r6(F.avg("l_discount")).alias("mean_e"), r6(F.avg("l_tax")).alias("mean_g"))


STATUSES = ["F", "O", "P"]


def pivot(t: Tables, column: str, values: list[str], percent: bool) -> DataFrame:
    wide = t.papers().groupBy("year").pivot(column, values).count().fillna(0)
    total = reduce(lambda a, b: a + b, (F.col(f"`{v}`") for v in values))
    return wide.select("year", *((F.bround(100.0 * F.col(f"`{v}`") / total, 2) if percent else F.col(f"`{v}`")).alias(v.split("-")[-1].replace(" ", "_")) for v in values))


@query(f"WITH {PAPERS} SELECT year, " + ", ".join(f"round_even(100.0 * count(*) FILTER (o_orderstatus = '{s}') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 2) AS \"{s}\"" for s in STATUSES) + " FROM papers GROUP BY 1")
def pivot_share_by_year(t: Tables) -> DataFrame:
    return pivot(t, "o_orderstatus", STATUSES, True)


@query(f"WITH {PAPERS} SELECT year, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in STATUSES) + " FROM papers GROUP BY 1")
def category_by_year(t: Tables) -> DataFrame:
    return pivot(t, "o_orderstatus", STATUSES, False)


@query(f"WITH {PAPERS} SELECT year, o_orderpriority AS kind, count(*) AS n FROM papers GROUP BY 1, 2")
def crosstab(t: Tables) -> DataFrame:
    kinds = [r[0] for r in t.papers().select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(1001).collect()]  # columns of the table
    if len(kinds) > 1000:
        raise ValueError("over 1000 kinds, which would be columns of the table")
    wide = t.papers().groupBy("year").pivot("o_orderpriority", kinds).count()
    return wide.unpivot(["year"], kinds, "kind", "n").where("n is not null")


@query(f"WITH {PAPERS} SELECT c_mktsegment AS grp, {PROFILE} FROM papers JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def impact_by_group(t: Tables) -> DataFrame:
    return t.papers().join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("grp")).agg(*profile())


@query(f"WITH {PAPERS} SELECT year, {PROFILE}, count(*) FILTER (cit <= 200) AS low FROM papers GROUP BY 1")
def yearly_citation_profile(t: Tables) -> DataFrame:
    return t.papers().groupBy("year").agg(*profile(), F.count_if(F.col("cit") <= 200).alias("low"))


@query(f"WITH {PAPERS} SELECT CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS domain, {PROFILE} FROM papers JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def impact_by_domain(t: Tables) -> DataFrame:
    return t.papers().join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive").alias("domain")).agg(*profile())


@query(f"WITH {PAPERS} SELECT year, {PROFILE}, max(cit) AS max_cit, quantile_cont(cit, 0.25) AS q1, quantile_cont(cit, 0.75) AS q3 FROM papers WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY 1")
def cohort_maturity(t: Tables) -> DataFrame:
    focal = t.papers().where(F.left("o_orderpriority", F.lit(1)).isin("1", "2"))
    return focal.groupBy("year").agg(*profile(), F.max("cit").alias("max_cit"), F.percentile("cit", 0.25).alias("q1"), F.percentile("cit", 0.75).alias("q3"))


@query(f"WITH {PAPERS} SELECT year, count(*) FILTER (o_orderpriority LIKE '1%') AS c3, count(*) FILTER (o_orderpriority LIKE '2%') AS c4, round(100.0 * count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') / count(*), 6) AS share FROM papers GROUP BY 1")
def focal_emergence(t: Tables) -> DataFrame:
    p = F.left("o_orderpriority", F.lit(1))
    return t.papers().groupBy("year").agg(F.count_if(p == "1").alias("c3"), F.count_if(p == "2").alias("c4"), r6(100.0 * F.count_if(p.isin("1", "2")) / F.count("*")).alias("share"))


def top_sql(fraction: float) -> str:
    return f"round(100.0 * sum(cit) FILTER (rn <= greatest(1, round_even(n * {fraction}, 0))) / sum(cit), 6)"


@query(f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cit DESC, id) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM papers)
    SELECT o_orderpriority AS cluster, {top_sql(0.1)} AS top10, {top_sql(0.2)} AS top20 FROM r GROUP BY 1""")
def concentration_top_share(t: Tables) -> DataFrame:
    shares = R.top_shares(t.papers().select(F.col("o_orderpriority").alias("cluster"), "cit"), "cit", {"top10": 0.1, "top20": 0.2}, ["cluster"])
    return shares.select("cluster", r6("top10").alias("top10"), r6("top20").alias("top20"))


@query(f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY cit DESC, id) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM papers)
    SELECT o_orderpriority AS cluster, round(avg(cit), 6) AS mean_all, round(avg(cit) FILTER (rn > greatest(1, round_even(n * 0.1, 0))), 6) AS mean_rest,
           round(avg(cit) FILTER (rn > greatest(1, round_even(n * 0.1, 0))) / avg(cit), 6) AS ratio FROM r GROUP BY 1""")
def mean_without_top_decile(t: Tables) -> DataFrame:
    d = R.top_parts(t.papers().select(F.col("o_orderpriority").alias("cluster"), "cit"), "cit", {"top": 0.1}, ["cluster"])
    mean, rest = F.col("sum") / F.col("n"), (F.col("sum") - F.col("top_sum")) / F.nullif(F.col("n") - F.col("top_n"), F.lit(0))
    return d.select("cluster", r6(mean).alias("mean_all"), r6(rest).alias("mean_rest"), r6(rest / mean).alias("ratio"))


@query(f"""WITH {PAPERS}, r AS (SELECT id, year, row_number() OVER o AS rn, count(*) OVER (PARTITION BY year) AS n, sum(cit) OVER (o ROWS UNBOUNDED PRECEDING) AS s, sum(cit) OVER (PARTITION BY year) AS total FROM papers WINDOW o AS (PARTITION BY year ORDER BY cit, id))
    SELECT id, year, round(100.0 * (rn - 1) / (n - 1), 6) AS x, round(100.0 * s / total, 6) AS y FROM r""")
def lorenz_curve(t: Tables) -> DataFrame:
    return R.lorenz(t.papers().select("id", "year", "cit"), "cit", [F.asc("id")], ["year"]).select("id", "year", r6("x").alias("x"), r6("y").alias("y"))


@query(f"""WITH {PAPERS}, y AS (SELECT year, count(*) AS n, count(*) FILTER (cit <= 50) AS zero FROM papers GROUP BY 1),
    c AS (SELECT year, sum(n) OVER o AS n, sum(zero) OVER o AS zero FROM y WINDOW o AS (ORDER BY year ROWS UNBOUNDED PRECEDING))
    SELECT year AS through, CAST(n AS BIGINT) AS n, round(100.0 * zero / n, 6) AS zero_share, round(100.0 * zero / n - lag(100.0 * zero / n) OVER (ORDER BY year), 6) AS delta FROM c""")
def recency_cohorts(t: Tables) -> DataFrame:
    y = t.papers().groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("cit") <= 50).alias("zero"))
    o = Window.orderBy("year")
    c = y.select("year", F.sum("n").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.sum("zero").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("zero"))
    share = 100.0 * F.col("zero") / F.col("n")
    return c.withColumn("s", share).select(F.col("year").alias("through"), "n", r6("s").alias("zero_share"), r6(F.col("s") - F.lag("s").over(o)).alias("delta"))


@query(f"""WITH {PAPERS}, y AS (SELECT year, count(*) AS n, sum(cit) AS c, count(*) FILTER (cit > 300) AS high FROM papers GROUP BY 1)
    SELECT year, round(100.0 * n / sum(n) OVER (), 6) AS pct_articles, round(100.0 * c / sum(c) OVER (), 6) AS pct_citations, round((c / sum(c) OVER ()) / (n / sum(n) OVER ()), 6) AS ratio, high FROM y""")
def cohort_shock(t: Tables) -> DataFrame:
    y = t.papers().groupBy("year").agg(F.count("*").alias("n"), F.sum("cit").alias("c"), F.count_if(F.col("cit") > 300).alias("high"))
    every = Window.partitionBy()
    n, c = F.col("n") / F.sum("n").over(every), F.col("c") / F.sum("c").over(every)
    return y.select("year", r6(100 * n).alias("pct_articles"), r6(100 * c).alias("pct_citations"), r6(c / n).alias("ratio"), "high")


@query("""SELECT count(*) AS n, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (n_chars < 150) AS short, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang <> 'en' AND n_chars < 150) AS short_other,
    round(100.0 * count(*) FILTER (n_chars >= 150) / count(*), 6) AS pct_long FROM documents""")
def coverage_stats(t: Tables) -> DataFrame:
    short, en = F.col("n_chars") < 150, F.col("lang") == "en"
    return t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("with_text"), F.count_if(short).alias("short"), F.count_if(en).alias("english"), F.count_if(~en & short).alias("short_other"), r6(100.0 * F.count_if(~short) / F.count("*")).alias("pct_long"))


@query("""SELECT lang, source, quality, count(*) AS n, CAST(grouping(lang, source, quality) AS BIGINT) AS level
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (quality), ())""")
def audit_grouping_sets(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    sets = [[F.col("lang")], [F.col("source")], [F.col("quality")], []]
    return d.groupingSets(sets, F.col("lang"), F.col("source"), F.col("quality")).agg(F.count("*").alias("n"), F.grouping_id("lang", "source", "quality").alias("level"))


FUNNEL = [("identified", "true"), ("with_text", "n_chars > 0"), ("long_enough", "n_chars >= 150"), ("english", "n_chars >= 150 AND lang = 'en'"), ("kept", "n_chars >= 150 AND lang = 'en' AND source <> 'src0'")]


@query(" UNION ALL ".join(f"SELECT {k} AS step, '{name}' AS label, count(*) FILTER ({test}) AS n FROM documents" for k, (name, test) in enumerate(FUNNEL, 1)))
def prisma_funnel(t: Tables) -> DataFrame:
    row = t.documents.agg(*(F.count_if(F.expr(test)).alias(name) for name, test in FUNNEL))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(name).alias("label"), F.col(name).alias("n")) for k, (name, _) in enumerate(FUNNEL, 1)))).alias("s")).select("s.*")


REMOVALS = {"no_text": "coalesce(trim(text), '') = ''", "short": "n_chars < 150", "other_language": "lang <> 'en'", "source": "source = 'src0'"}


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS again FROM documents), r AS (SELECT CASE WHEN again THEN 1 """ + " ".join(f"WHEN {test} THEN {k}" for k, test in enumerate(REMOVALS.values(), 2)) + """ ELSE 99 END AS s FROM f),
    l AS (SELECT * FROM (VALUES (0, 'identified'), (1, 'repeated'), """ + ", ".join(f"({k}, '{name}')" for k, name in enumerate(REMOVALS, 2)) + """) v(step, label))
    SELECT CAST(step AS INTEGER) AS step, label, (SELECT count(*) FROM r WHERE s = step) AS n_removed, (SELECT count(*) FROM r WHERE s > step) AS n_left FROM l""")
def observed_funnel(t: Tables) -> DataFrame:
    """Removal steps over all documents, counted while the rest is written, and held against what was written."""
    d = funnel.repeated(t.documents, "repeated", F.md5("text"), [F.col("doc_id")])
    kept, counts = funnel.observed(funnel.removed(d, {name: F.expr(test) for name, test in REMOVALS.items()}), ["repeated", *REMOVALS], f"funnel-{uuid.uuid4().hex}")
    path = shared_folder(t.spark, "funnel")
    kept.select("doc_id").write.parquet(path)
    return funnel.reconciled(funnel.as_table(t.spark, counts.get), t.spark.read.parquet(path), 0)


@query(f"""WITH {PAPERS}, y AS (SELECT year, count(*) AS n FROM papers GROUP BY 1) SELECT count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT o_custkey) AS authors, max(cit) AS max_cit,
    (SELECT year FROM y ORDER BY n DESC, year LIMIT 1) AS top_year, round(100.0 * (SELECT max(n) FROM y) / count(*), 6) AS top_pct, round(100.0 * count(*) FILTER (cit <= 50) / count(*), 6) AS pct_low FROM papers""")
def kpi_row(t: Tables) -> DataFrame:
    p = t.papers()
    top = p.groupBy("year").agg(F.count("*").alias("m")).agg(F.max_by("year", F.struct("m", -F.col("year"))).alias("top_year"), F.max("m").alias("m"))
    row = p.agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("o_custkey").alias("authors"), F.max("cit").alias("max_cit"), r6(100.0 * F.count_if(F.col("cit") <= 50) / F.count("*")).alias("pct_low"))
    return row.crossJoin(top).withColumn("top_pct", r6(100.0 * F.col("m") / F.col("n"))).drop("m")


@query(f"WITH {PAPERS}, c AS (SELECT year, o_orderpriority AS p, count(*) AS n FROM papers GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, p) AS k FROM c) SELECT year, p AS modal FROM r WHERE k = 1")
def modal_value(t: Tables) -> DataFrame:
    return t.papers().groupBy("year").agg(F.mode("o_orderpriority", True).alias("modal"))


@query(f"""WITH {PAPERS}, s AS (SELECT year, o_orderpriority AS p, count(*) / sum(count(*)) OVER (PARTITION BY year) AS share FROM papers GROUP BY 1, 2), m AS (SELECT p FROM s GROUP BY 1 ORDER BY round(avg(share), 9) DESC, p LIMIT 1)
    SELECT p AS label, round(arg_min(share, year), 6) AS first_share, round(arg_max(share, year), 6) AS last_share FROM s WHERE p = (SELECT p FROM m) GROUP BY 1""")
def dominant_trend(t: Tables) -> DataFrame:
    s = t.papers().groupBy("year", F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    s = s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("year")))
    g = s.groupBy("label").agg(F.round(F.avg("share"), 9).alias("m"), r6(F.min_by("share", "year")).alias("first_share"), r6(F.max_by("share", "year")).alias("last_share"))
    return g.orderBy(F.desc("m"), "label").limit(1).drop("m")


@query(f"WITH {PAPERS}, n AS (SELECT n_name AS country, o_custkey, cit, year FROM papers JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT country, count(*) AS n, median(cit) AS median_cit, round(avg(cit), 6) AS mean_cit, max(cit) AS max_cit, count(DISTINCT year) AS years FROM n GROUP BY 1 ORDER BY n DESC, country LIMIT 10")
def group_profile(t: Tables) -> DataFrame:
    d = t.papers().join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country"))
    return d.agg(F.count("*").alias("n"), F.median("cit").alias("median_cit"), r6(F.avg("cit")).alias("mean_cit"), F.max("cit").alias("max_cit"), F.count_distinct("year").alias("years")).orderBy(F.desc("n"), "country").limit(10)


@query(f"WITH {PAPERS}, y AS (SELECT year, count(*) AS n, max(cit) AS top FROM papers GROUP BY 1), b AS (SELECT year, arg_min(id, (-cit, id)) AS best FROM papers GROUP BY 1) SELECT year, n, top, best, n = max(n) OVER () AS peak FROM y JOIN b USING (year)")
def peak_group(t: Tables) -> DataFrame:
    y = t.papers().groupBy("year").agg(F.count("*").alias("n"), F.max("cit").alias("top"), F.max_by("id", F.struct("cit", -F.col("id"))).alias("best"))
    return y.withColumn("peak", F.col("n") == F.max("n").over(Window.partitionBy()))


EDGES = "e AS (SELECT quantile_cont(cit, [0.25, 0.5, 0.75]) AS e FROM papers), q AS (SELECT papers.*, CAST(CASE WHEN cit <= e[1] THEN 1 WHEN cit <= e[2] THEN 2 WHEN cit <= e[3] THEN 3 ELSE 4 END AS INTEGER) AS q FROM papers, e)"


@query(f"WITH {PAPERS}, {EDGES} SELECT id, q FROM q")
def quartiles_qcut(t: Tables) -> DataFrame:
    return R.quantile_bins(t.papers(), "cit", 4, "q").select("id", "q")


@query(f"WITH {PAPERS}, {EDGES} SELECT q, count(*) AS n, median(year) AS median_year, round(avg(cit), 6) AS mean_cit FROM q GROUP BY 1")
def quartile_citation_table(t: Tables) -> DataFrame:
    d = R.quantile_bins(t.papers(), "cit", 4, "q")
    return d.groupBy("q").agg(F.count("*").alias("n"), r6(F.avg("cit")).alias("mean_cit")).join(R.grouped_quantiles(d, "year", {"median_year": 0.5}, ["q"]), "q")


@query(f"""WITH {PAPERS}, {EDGES} SELECT q, count(*) AS n, min(cit) AS low, quantile_cont(cit, 0.25) AS q1, quantile_cont(cit, 0.5) AS med, quantile_cont(cit, 0.75) AS q3, max(cit) AS high,
    quantile_cont(cit, 0.75) + 1.5 * (quantile_cont(cit, 0.75) - quantile_cont(cit, 0.25)) AS fence FROM q GROUP BY 1""")
def box_summaries(t: Tables) -> DataFrame:
    d = R.quantile_bins(t.papers(), "cit", 4, "q")
    box = R.grouped_quantiles(d, "cit", {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["q"]).withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return d.groupBy("q").agg(F.count("*").alias("n"), F.min("cit").alias("low"), F.max("cit").alias("high")).join(box, "q")


@query(f"""WITH {PAPERS}, r AS (SELECT id, year, row_number() OVER (PARTITION BY year ORDER BY cit, id) AS rn, count(*) OVER (PARTITION BY year) AS n FROM papers)
    SELECT id, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, CAST(ceil((rn - 1) * 5 / (n - 1)) AS INTEGER)) END AS INTEGER) AS q FROM r""")
def quintile_rank_first(t: Tables) -> DataFrame:
    return R.position_bins(t.papers().select("id", "cit", "year"), "cit", [F.asc("id")], 5, "q", ["year"]).select("id", "q")


@query(f"WITH {PAPERS} SELECT id, round((rank() OVER (PARTITION BY year ORDER BY cit) + (count(*) OVER (PARTITION BY year, cit) - 1) / 2.0) / count(*) OVER (PARTITION BY year), 6) AS pct FROM papers")
def pct_rank_within_year(t: Tables) -> DataFrame:
    return R.percentile_ranks(t.papers().select("id", "cit", "year"), "cit", "pct", ["year"]).select("id", r6("pct").alias("pct"))


@query(f"""WITH {PAPERS} SELECT id, {BAND_SQL} AS band, CASE WHEN c_acctbal / 1000 < -0.10 THEN 'strong_negative' WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal / 1000 < 0.10 THEN 'positive' ELSE 'strong_positive' END AS zone,
    CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS cohort FROM papers JOIN customer ON o_custkey = c_custkey""")
def bands_and_zones(t: Tables) -> DataFrame:
    d = t.papers().join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return d.select("id", R.bands(F.col("year"), BANDS).alias("band"), R.zones(F.col("c_acctbal") / 1000).alias("zone"), F.when(F.col("year") < 1998, "early").otherwise("late").alias("cohort"))


@query(f"""WITH {PAPERS}, d AS (SELECT {BAND_SQL} AS band, cit, id FROM papers), e AS (SELECT quantile_cont(cit, 0.25) AS a, quantile_cont(cit, 0.75) AS b FROM papers)
    SELECT band, count(*) AS n, round(avg(cit) FILTER (cit >= b), 6) AS mean_q4, round(avg(cit) FILTER (cit <= a), 6) AS mean_q1, median(cit) AS median_cit, CAST(grouping(band) AS BIGINT) AS overall FROM d, e GROUP BY GROUPING SETS ((band), ())""")
def band_diagnostics(t: Tables) -> DataFrame:
    d = t.papers().select(R.bands(F.col("year"), BANDS).alias("band"), "cit")
    low, high = R.quantiles(d, "cit", [0.25, 0.75])
    sets = d.groupingSets([[F.col("band")], []], F.col("band")).agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("cit") >= high, F.col("cit")))).alias("mean_q4"), r6(F.avg(F.when(F.col("cit") <= low, F.col("cit")))).alias("mean_q1"), F.grouping("band").cast("long").alias("overall"))
    each = R.grouped_quantiles(d, "cit", {"median_cit": 0.5}, ["band"]).withColumn("overall", F.lit(0).cast("long"))
    medians = each.union(R.grouped_quantiles(d, "cit", {"median_cit": 0.5}, []).select(F.lit(None).cast("string"), "median_cit", F.lit(1).cast("long")))
    medians = medians.select(F.col("band").alias("_b"), F.col("overall").alias("_o"), "median_cit")
    return sets.join(medians, F.col("band").eqNullSafe(F.col("_b")) & (F.col("overall") == F.col("_o"))).drop("_b", "_o")


@query(f"""WITH {PAPERS}, y AS (SELECT year, count(*) AS n, sum(cit) AS c, round(100.0 * count(*) FILTER (cit > 200) / count(*), 6) AS cited FROM papers GROUP BY 1),
    s AS (SELECT year, cited, (c / sum(c) OVER ()) / (n / sum(n) OVER ()) AS ratio FROM y)
    SELECT max(ratio) >= 1.5 AS shock, arg_max(cited, year) < max(cited) AS past_peak, avg(cited) FILTER (year < 1998) >= 85 AS early_cited, count(*) FILTER (ratio > 1) AS years_above, round(max(ratio) - min(ratio), 6) AS spread FROM s""")
def claim_verdicts(t: Tables) -> DataFrame:
    y = t.papers().groupBy("year").agg(F.count("*").alias("n"), F.sum("cit").alias("c"), r6(100.0 * F.count_if(F.col("cit") > 200) / F.count("*")).alias("cited"))
    every = Window.partitionBy()
    s = y.withColumn("ratio", (F.col("c") / F.sum("c").over(every)) / (F.col("n") / F.sum("n").over(every)))
    return s.agg((F.max("ratio") >= 1.5).alias("shock"), (F.max_by("cited", "year") < F.max("cited")).alias("past_peak"), (F.avg(F.when(F.col("year") < 1998, F.col("cited"))) >= 85).alias("early_cited"), F.count_if(F.col("ratio") > 1).alias("years_above"), r6(F.max("ratio") - F.min("ratio")).alias("spread"))


@query(f"WITH {PAPERS}, b AS (SELECT {BAND_SQL} AS band, corr(cit, id) AS rho FROM papers GROUP BY 1) SELECT count(*) FILTER (rho > 0) AS positive_bands, count(*) AS bands, round(max(rho) - min(rho), 6) AS range FROM b")
def signal_stability(t: Tables) -> DataFrame:
    b = t.papers().groupBy(R.bands(F.col("year"), BANDS).alias("band")).agg(F.corr("cit", "id").alias("rho"))
    return b.agg(F.count_if(F.col("rho") > 0).alias("positive_bands"), F.count("*").alias("bands"), r6(F.max("rho") - F.min("rho")).alias("range"))


@query("SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey, count(*) AS n FROM nation GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def region_summary(t: Tables) -> DataFrame:
    return B.frequencies(t.nation, F.array("n_regionkey"), "n_regionkey").withColumnRenamed("freq", "n").orderBy(F.desc("n"), "n_regionkey").limit(10)
