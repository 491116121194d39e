"""Bibliometric laws and networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranges import by_value


def yearly_production(papers: DataFrame) -> DataFrame:
    """n and citations by publication_year, from papers (id, publication_year, cited_by_count)."""
    known = papers.where("publication_year is not null")
    return known.groupBy(F.col("publication_year").alias("year")).agg(F.count("id").alias("n"), F.sum("cited_by_count").alias("citations"))


def bradford_zones(journals: DataFrame) -> DataFrame:
    """Add bradford_zone to journals (journal, n, ...): thirds of the articles, largest journals first.

    The zone size is the integer third of all articles and at least one; ties go by name.  The
    window has no partition, but its rows are one for each journal.
    """
    order = Window.orderBy(F.desc("n"), F.asc("journal")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = journals.withColumn("_cum", F.sum("n").over(order)).withColumn("_size", F.greatest(F.expr("sum(n) over () div 3"), F.lit(1)))
    zone = F.when(F.col("_cum") <= F.col("_size"), 1).when(F.col("_cum") <= 2 * F.col("_size"), 2).otherwise(3)
    return cum.withColumn("bradford_zone", zone).drop("_cum", "_size")


def bradford_boundaries(journals: DataFrame) -> DataFrame:
    """The last ranks within one and two real thirds of the articles."""
    order = Window.orderBy(F.desc("n"), F.asc("journal"))
    r = journals.select(F.row_number().over(order).alias("rank"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return r.agg(F.max(F.when(F.col("cum") <= F.col("total") / 3, F.col("rank"))).alias("core"), F.max(F.when(F.col("cum") <= 2 * F.col("total") / 3, F.col("rank"))).alias("middle"), F.max("rank").alias("journals"))


def journal_table(papers: DataFrame) -> DataFrame:
    """n, total_cit and the first known is_in_doaj of each canonical journal, from papers (id, journal, cited_by_count, is_in_doaj, position)."""
    named = papers.withColumn("journal", T.journal_name(F.col("journal"))).where("journal <> ''")
    return named.groupBy("journal").agg(F.count("id").alias("n"), F.sum("cited_by_count").alias("total_cit"), F.min_by("is_in_doaj", F.when(F.col("is_in_doaj").isNotNull(), F.col("position"))).alias("is_in_doaj"))


def lotka(paper_authors: DataFrame) -> DataFrame:
    """n_papers, n_authors and pct_authors from one row for each paper and author."""
    per = paper_authors.groupBy("author").agg(F.count("*").alias("n_papers")).groupBy("n_papers").agg(F.count("*").alias("n_authors"))
    return per.withColumn("pct_authors", F.bround(100.0 * F.col("n_authors") / F.sum("n_authors").over(Window.partitionBy()), 2))


def lotka_expected(distribution: DataFrame, most: int = 10) -> DataFrame:
    """Add expected: the inverse square law scaled to the observed per cents up to `most` papers."""
    every = Window.partitionBy()
    d = distribution.where(F.col("n_papers") <= most).withColumn("_w", 1.0 / (F.col("n_papers") * F.col("n_papers")))
    return d.withColumn("expected", F.col("_w") * F.sum("pct_authors").over(every) / F.sum("_w").over(every)).drop("_w")


def author_table(paper_authors: DataFrame) -> DataFrame:
    """n_papers, total_cit and h_index by author, from one row for each paper and author with its citations cit."""
    rank = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("cit"), "paper"))
    return paper_authors.withColumn("_rn", rank).groupBy("author").agg(F.count("*").alias("n_papers"), F.sum("cit").alias("total_cit"), F.sum(F.when(F.col("cit") >= F.col("_rn"), 1).otherwise(0)).alias("h_index"))


def frequencies(papers: DataFrame, terms: Column, name: str) -> DataFrame:
    """name and freq of the terms of each paper, as given (distinct or not)."""
    return papers.select(F.explode(terms).alias(name)).groupBy(name).agg(F.count("*").alias("freq"))


def pairs(papers: DataFrame, terms: Column, least: int = 1) -> DataFrame:
    """source < target and the papers that have both; formed inside each paper's row, so nothing is joined."""
    distinct = F.array_sort(F.array_distinct(terms))
    rows = papers.select(distinct.alias("t")).where(F.size("t") > 1).select("t", F.posexplode("t").alias("i", "source"))
    rows = rows.select("source", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("target"))
    return rows.groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def shares(counts: DataFrame, n: str, out: str = "pct", places: int = 2) -> DataFrame:
    return counts.withColumn(out, F.bround(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy()), places))


def canonical_casing(terms: DataFrame, key: str = "term", *order: str) -> DataFrame:
    """lower and label: the alias of a keyword, else its first-seen spelling."""
    first = F.min_by(key, F.struct(*order))
    return terms.groupBy(F.lower(key).alias("lower")).agg(first.alias("_first")).select("lower", F.coalesce(T.canonical_keyword(F.col("lower")), F.col("_first")).alias("label"))


def zipf(frequency: DataFrame, least: int = 5, step: int = 10_000) -> DataFrame:
    """alpha, r2, intercept and counts of a log-log fit of frequency (freq, term) over terms seen at least twice; a null fit with fewer than `least`.

    Terms of one frequency have ranks that follow each other, so only the distinct frequencies are
    ordered, and ranks are counted out from them, `step` at a time.
    """
    ordered = by_value(frequency.select("freq"), "freq", descending=True).select("freq", "n", (F.col("before") + F.col("n")).alias("_last"), (F.col("before") + 1).alias("_first"))
    core = ordered.where("freq >= 2").select("freq", "_last", F.explode(F.sequence("_first", "_last", F.lit(step).cast("long"))).alias("_a"))
    ranks = core.select("freq", F.explode(F.sequence("_a", F.least("_last", F.col("_a") + (step - 1)))).alias("rank"))
    x, y = F.ln("rank"), F.ln("freq")
    fit = ranks.select(x.alias("x"), y.alias("y")).agg(F.count("*").alias("core"), F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_r2("y", "x").alias("r"))
    taken = F.greatest(F.lit(0), F.least("n", 10 - F.col("_first") + 1))
    whole = ordered.agg(F.sum("n").alias("terms"), F.coalesce(F.sum(F.when(F.col("freq") == 1, F.col("n"))), F.lit(0)).alias("hapax"), F.sum(taken * F.col("freq")).alias("top"), F.sum(F.col("n") * F.col("freq")).alias("all"))
    some = lambda c: F.when(F.col("core") >= least, c)
    fit = fit.crossJoin(F.broadcast(whole))
    return fit.select("core", "terms", some(-F.col("s")).alias("alpha"), some(F.col("i")).alias("intercept"), some(F.col("r")).alias("r2"), (100.0 * F.col("hapax") / F.col("terms")).alias("hapax_pct"), (100.0 * F.col("top") / F.col("all")).alias("top10_share"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def lift(terms: DataFrame, group: str, term: str, sizes: DataFrame, k: int = 8) -> DataFrame:
    """The terms of each group with the largest share there against all; sizes holds group and n."""
    by = terms.groupBy(group, term).agg(F.count("*").alias("freq_group"))
    whole = terms.groupBy(term).agg(F.count("*").alias("freq"))
    total = sizes.agg(F.sum("n").alias("_total"))
    d = by.join(whole, term).join(sizes, group).crossJoin(F.broadcast(total))
    d = d.withColumn("lift", (F.col("freq_group") / F.col("n")) / (F.col("freq") / F.col("_total")))
    return top_per_group(d.drop("_total", "n"), [group], [F.desc("lift"), F.asc(term)], k)
