"""Production, journals, authors, keywords and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import biblio as B
from .registry import BRANDS, KEYWORDS, PAPERS, Tables, query, r6


@query(f"WITH {PAPERS} SELECT year, count(id) AS n, CAST(sum(cit) AS BIGINT) AS citations FROM papers GROUP BY 1")
def yearly_production(t: Tables) -> DataFrame:
    return B.yearly_production(t.papers().select("id", F.col("year").alias("publication_year"), F.col("cit").alias("cited_by_count")))


def brands(t: Tables) -> DataFrame:
    """Brands as journals, order lines as articles."""
    sales = t.lineitem.select("l_partkey", "l_quantity").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return sales.groupBy(F.col("p_brand").alias("journal")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total_cit"))


@query(f"""WITH {BRANDS}, c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, journal ROWS UNBOUNDED PRECEDING) AS cum, greatest(sum(n) OVER () // 3, 1) AS z FROM j)
    SELECT journal, n, total_cit, CAST(CASE WHEN cum <= z THEN 1 WHEN cum <= 2 * z THEN 2 ELSE 3 END AS INTEGER) AS bradford_zone FROM c""")
def bradford_zones(t: Tables) -> DataFrame:
    return B.bradford_zones(brands(t))


@query(f"""WITH {BRANDS}, c AS (SELECT row_number() OVER o AS r, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM j WINDOW o AS (ORDER BY n DESC, journal))
    SELECT CAST(max(r) FILTER (cum <= total / 3) AS INTEGER) AS core, CAST(max(r) FILTER (cum <= 2 * total / 3) AS INTEGER) AS middle, CAST(max(r) AS INTEGER) AS journals FROM c""")
def bradford_boundaries(t: Tables) -> DataFrame:
    return B.bradford_boundaries(brands(t))


@query(f"WITH {BRANDS}, c AS (SELECT sum(n) OVER (ORDER BY n DESC, journal ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS s FROM j) SELECT count(*) FILTER (s <= 0.333) AS journals_in_core, count(*) AS journals FROM c")
def cumulative_share_count(t: Tables) -> DataFrame:
    order = Window.orderBy(F.desc("n"), "journal").rowsBetween(Window.unboundedPreceding, 0)
    s = brands(t).select((F.sum("n").over(order) / F.sum("n").over(Window.partitionBy())).alias("s"))
    return s.agg(F.count_if(F.col("s") <= 0.333).alias("journals_in_core"), F.count("*").alias("journals"))


@query("""WITH c AS (SELECT upper(left(n_name, 2)) AS country_code, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT country_code, n, round_even(100.0 * n / sum(n) OVER (), 2) AS pct FROM c""")
def geo_counts(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    codes = rows.select(F.explode(T.countries(F.left("n_name", F.lit(2)))).alias("country_code"))
    return B.shares(codes.groupBy("country_code").agg(F.count("*").alias("n")), "n")


@query("""WITH g AS (SELECT n_name AS country, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, country) AS k, sum(n) OVER () AS total FROM g)
    SELECT country, n, round(ln(1 + n), 6) AS log_n, round(100.0 * sum(n) FILTER (k <= 10) OVER () / total, 6) AS top10_share FROM r""")
def geo_log_share(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("n"))
    every, rank = Window.partitionBy(), F.row_number().over(Window.orderBy(F.desc("n"), "country"))
    top = F.sum(F.when(F.col("k") <= 10, F.col("n"))).over(every)
    return rows.withColumn("k", rank).select("country", "n", r6(F.log1p("n")).alias("log_n"), r6(100.0 * top / F.sum("n").over(every)).alias("top10_share"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS id, n_name AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT a.c AS source, b.c AS target, count(*) AS weight FROM d a JOIN d b ON a.id = b.id AND a.c < b.c GROUP BY 1, 2""")
def country_collab_pairs(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return B.pairs(d.groupBy("l_orderkey").agg(F.collect_set("n_name").alias("c")), F.col("c"))


LOTKA = "a AS (SELECT o_custkey, count(*) AS n_papers FROM orders GROUP BY 1), l AS (SELECT n_papers, count(*) AS n_authors, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct_authors FROM a GROUP BY 1)"


def paper_authors(t: Tables) -> DataFrame:
    return t.papers().select(F.col("id").alias("paper"), F.col("o_custkey").alias("author"), "cit")


@query(f"WITH {LOTKA} SELECT * FROM l")
def lotka_distribution(t: Tables) -> DataFrame:
    return B.lotka(paper_authors(t))


@query(f"""WITH {LOTKA}, m AS (SELECT *, 1.0 / (n_papers * n_papers) AS w FROM l WHERE n_papers <= 10)
    SELECT n_papers, n_authors, pct_authors, round(CAST(w AS DOUBLE) * sum(pct_authors) OVER () / sum(CAST(w AS DOUBLE)) OVER (), 6) AS expected FROM m""")
def lotka_expected(t: Tables) -> DataFrame:
    return B.lotka_expected(B.lotka(paper_authors(t))).withColumn("expected", r6("expected"))


@query(f"""WITH {PAPERS}, r AS (SELECT o_custkey AS author, cit, row_number() OVER (PARTITION BY o_custkey ORDER BY cit DESC, id) AS rn FROM papers)
    SELECT author, count(*) AS n_papers, CAST(sum(cit) AS BIGINT) AS total_cit, CAST(sum(CASE WHEN cit >= rn THEN 1 ELSE 0 END) AS BIGINT) AS h_index
    FROM r GROUP BY 1 ORDER BY n_papers DESC, total_cit DESC, author LIMIT 30""")
def top_authors_hindex(t: Tables) -> DataFrame:
    return B.author_table(paper_authors(t)).orderBy(F.desc("n_papers"), F.desc("total_cit"), "author").limit(30)


@query(f"WITH {KEYWORDS} SELECT k AS keyword, count(*) AS freq FROM kw GROUP BY 1")
def keyword_freq(t: Tables) -> DataFrame:
    return B.frequencies(t.keywords(), F.col("kws"), "keyword")


@query(f"WITH {KEYWORDS} SELECT a.k AS source, b.k AS target, count(*) AS weight FROM kw a JOIN kw b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 3")
def keyword_cooc(t: Tables) -> DataFrame:
    return B.pairs(t.keywords(), F.col("kws"), 3)


@query(f"""WITH {KEYWORDS}, e AS (SELECT a.k AS source, b.k AS target, count(*) AS weight FROM kw a JOIN kw b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 4),
    n AS (SELECT k FROM kw GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 20)
    SELECT e.* FROM e WHERE source IN (SELECT k FROM n) AND target IN (SELECT k FROM n)""")
def keyword_graph_edges(t: Tables) -> DataFrame:
    d = t.keywords()
    nodes = B.frequencies(d, F.col("kws"), "k").orderBy(F.desc("freq"), "k").limit(20).select("k")
    edges = B.pairs(d, F.col("kws"), 4)
    return edges.join(nodes.withColumnRenamed("k", "source"), "source", "left_semi").join(nodes.withColumnRenamed("k", "target"), "target", "left_semi").select("source", "target", "weight")


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS p FROM conversations)
    SELECT lower(term) AS lower, CASE lower(term) WHEN 'ai' THEN 'Artificial Intelligence' WHEN 'llm' THEN 'Large Language Models' WHEN 'llms' THEN 'Large Language Models' WHEN 'nlp' THEN 'Natural Language Processing' WHEN 'chatgpt' THEN 'ChatGPT' ELSE arg_min(term, (conv_id, turn, p)) END AS label FROM w GROUP BY 1""")
def canonical_casing(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("p", "term"))
    return B.canonical_casing(words, "term", "conv_id", "turn", "p")


ZIPF = "f AS (SELECT p_name AS term, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM f)"


def part_names(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("freq"))


@query(f"""WITH {ZIPF} SELECT count(*) FILTER (freq >= 2) AS core, count(*) AS terms, round(-regr_slope(ln(freq), ln(rank)) FILTER (freq >= 2), 6) AS alpha, round(regr_intercept(ln(freq), ln(rank)) FILTER (freq >= 2), 6) AS intercept,
    round(regr_r2(ln(freq), ln(rank)) FILTER (freq >= 2), 6) AS r2, round(100.0 * count(*) FILTER (freq = 1) / count(*), 6) AS hapax_pct, round(100.0 * sum(freq) FILTER (rank <= 10) / sum(freq), 6) AS top10_share FROM r""")
def zipf_fit(t: Tables) -> DataFrame:
    z = B.zipf(part_names(t))
    return z.select("core", "terms", *(r6(c).alias(c) for c in ("alpha", "intercept", "r2", "hapax_pct", "top10_share")))


@query(f"WITH {PAPERS} SELECT id, year, cit FROM papers ORDER BY cit DESC, id LIMIT 20")
def top20_cited(t: Tables) -> DataFrame:
    return t.papers().select("id", "year", "cit").orderBy(F.desc("cit"), "id").limit(20)


@query("""WITH c AS (SELECT p_type AS cluster, p_brand AS journal, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, journal) AS rank, sum(n) OVER (PARTITION BY cluster) AS total FROM c)
    SELECT cluster, journal, n, CAST(rank AS INTEGER) AS rank, round(100.0 * n / total, 6) AS pct FROM r WHERE rank <= 5""")
def topk_per_group(t: Tables) -> DataFrame:
    c = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("cluster"), F.col("p_brand").alias("journal")).agg(F.count("*").alias("n"))
    c = c.withColumn("pct", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))))
    return B.top_per_group(c, ["cluster"], [F.desc("n"), F.asc("journal")], 5)


@query("SELECT p_brand AS grp, lower(trim(k)) AS term, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey, unnest(string_split(p_name || '|' || p_type, '|')) u(k) WHERE length(trim(k)) BETWEEN 4 AND 80 GROUP BY 1, 2")
def group_keyword_counter(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.select(F.col("p_brand").alias("grp"), F.explode(T.cluster_terms(F.concat_ws("|", "p_name", "p_type"))).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("freq"))


@query("""WITH w AS (SELECT p_type AS grp, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT grp, count(*) AS n FROM w GROUP BY 1),
    a AS (SELECT grp, term, count(*) AS fg FROM w GROUP BY 1, 2), b AS (SELECT term, count(*) AS f FROM w GROUP BY 1),
    l AS (SELECT grp, term, fg AS freq_group, f AS freq, (fg / n) / (f / (SELECT sum(n) FROM s)) AS lift FROM a JOIN b USING (term) JOIN s USING (grp)),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY lift DESC, term) AS rank FROM l)
    SELECT grp, term, freq_group, freq, round(lift, 6) AS lift, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def lift_keywords(t: Tables) -> DataFrame:
    w = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("grp"), F.col("p_name").alias("term"))
    return B.lift(w, "grp", "term", w.groupBy("grp").agg(F.count("*").alias("n"))).withColumn("lift", r6("lift"))


@query("""WITH a AS (SELECT p_brand, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT min(p_brand) FROM part UNION SELECT max(p_brand) FROM part) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS k FROM a), x AS (SELECT p_brand, list(p_name) AS l FROM r WHERE k <= 15 GROUP BY 1)
    SELECT round(CAST(len(list_intersect(f.l, g.l)) AS DOUBLE) / len(list_distinct(list_concat(f.l, g.l))), 6) AS jaccard FROM x f JOIN x g ON f.p_brand < g.p_brand""")
def jaccard_top15(t: Tables) -> DataFrame:
    ends = t.part.agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b"))
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).crossJoin(F.broadcast(ends)).where("p_brand in (a, b)")
    n = d.groupBy((F.col("p_brand") == F.col("a")).alias("first"), "p_name").agg(F.count("*").alias("n"))
    top = B.top_per_group(n, ["first"], [F.desc("n"), F.asc("p_name")], 15)
    two = top.agg(F.collect_set(F.when(F.col("first"), F.col("p_name"))).alias("f"), F.collect_set(F.when(~F.col("first"), F.col("p_name"))).alias("g"))
    return two.select(r6(F.size(F.array_intersect("f", "g")) / F.size(F.array_union("f", "g"))).alias("jaccard"))


@query("SELECT n_nationkey, n_name, upper(left(n_name, 2)) AS code, coalesce(MAP {'BR': 'Brazil', 'US': 'United States', 'UN': 'United States'}[upper(left(n_name, 2))], n_name) AS label FROM nation")
def code_dimension_lookup(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame([("BR", "Brazil"), ("US", "United States"), ("UN", "United States")], "code string, known string")
    d = t.nation.select("n_nationkey", "n_name", F.upper(F.left("n_name", F.lit(2))).alias("code"))
    return d.join(F.broadcast(dim), "code", "left").select("n_nationkey", "n_name", "code", F.coalesce("known", "n_name").alias("label"))


@query("SELECT s_name AS name, list_aggregate(list_transform(string_split(replace(lower(s_name), '#', ' # '), ' '), lambda w: CASE WHEN w = '' THEN '' ELSE upper(w[1]) || w[2:] END), 'string_agg', ' ') AS spaced FROM supplier")
def label_title_case(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_name").alias("name"), T.title_case(F.replace("s_name", F.lit("#"), F.lit(" # "))).alias("spaced"))


@query()
def keyword_communities(t: Tables) -> DataFrame:
    from ..operators.graph import communities

    return communities(B.pairs(t.keywords(), F.col("kws"), 4))
