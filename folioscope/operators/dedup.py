"""Unions, precedence-keeping dedup, anti joins and lookups.

Row order is part of the meaning here, so every operator takes an explicit order column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_first_of_known(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each non-blank key; rows with a blank key all stay."""
    known = key.isNotNull() & (key != "")
    return keep_first(df.where(known), key, *order).unionByName(df.where(~known | key.isNull()))


def dedup_records(df: DataFrame, doi: Column, title: Column, order: str) -> DataFrame:
    """By DOI among those with one, then by title, where records with a DOI come before those without."""
    known = F.coalesce(doi, F.lit("")) != ""
    once = keep_first_of_known(df, doi, F.col(order))
    return keep_first(once, title, F.when(known, 0).otherwise(1), F.col(order))


def prefer_abstract(df: DataFrame, key: Column, abstract: Column, order: str) -> DataFrame:
    return keep_first(df, key, F.when(F.coalesce(F.trim(abstract), F.lit("")) != "", 0).otherwise(1), F.col(order))


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_by_key(df: DataFrame, key: str, record: list[str], order: str, terms: str) -> DataFrame:
    """One row per key: the fields of its last record, and all its terms, sorted."""
    last = F.max_by(F.struct(*record), F.col(order)).alias("r")
    return df.groupBy(key).agg(last, F.array_sort(F.collect_set(terms)).alias(terms)).select(key, "r.*", terms)


def new_records(new: DataFrame, pool: DataFrame, doi: str, title: str) -> DataFrame:
    """Rows of new whose DOI, if they have one, and title are not in the pool.

    Two anti joins: a disjunction in one would be a nested loop.
    """
    dois = pool.select(F.col(doi).alias("_doi")).where("_doi is not null and _doi <> ''").distinct()
    titles = pool.select(F.col(title).alias("_title")).where("_title is not null").distinct()
    return new.join(dois, F.col(doi) == F.col("_doi"), "left_anti").join(titles, F.col(title) == F.col("_title"), "left_anti")


def in_pool(new: DataFrame, pool: DataFrame, doi: str, title: str) -> DataFrame:
    """Add in_pool: whether the DOI, if there is one, or the title is in the pool."""
    dois = pool.select(F.col(doi).alias("_doi")).where("_doi is not null and _doi <> ''").distinct().withColumn("_d", F.lit(True))
    titles = pool.select(F.col(title).alias("_title")).where("_title is not null").distinct().withColumn("_t", F.lit(True))
    found = new.join(dois, F.col(doi) == F.col("_doi"), "left").join(titles, F.col(title) == F.col("_title"), "left")
    return found.withColumn("in_pool", F.coalesce("_d", "_t", F.lit(False))).drop("_doi", "_title", "_d", "_t")


def recover(df: DataFrame, column: str, *lookups: tuple[str, DataFrame]) -> DataFrame:
    """Fill blanks of a column from lookup tables (key, value) with unique keys, each by its own key of df, in order."""
    for n, (key, table) in enumerate(lookups):
        k, v = table.columns
        df = df.join(table.select(F.col(k).alias(f"_k{n}"), F.col(v).alias(f"_v{n}")), F.col(key) == F.col(f"_k{n}"), "left")
    filled = F.coalesce(F.when(F.col(column) != "", F.col(column)), *(F.when(F.col(f"_v{n}") != "", F.col(f"_v{n}")) for n in range(len(lookups))))
    return df.withColumn(column, filled).drop(*(f"_{x}{n}" for n in range(len(lookups)) for x in "kv"))


def patch(df: DataFrame, table: DataFrame, key: str, counts: list[str] = (), texts: list[str] = ()) -> DataFrame:
    """Update from a table with unique keys: counts that are zero by positive ones, blank texts by others."""
    right = table.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in (*counts, *texts)))
    df = df.join(right, F.col(key) == F.col("_key"), "left")
    for c in counts:
        df = df.withColumn(c, F.when((F.coalesce(F.col(c), F.lit(0)) == 0) & (F.col(f"_{c}") > 0), F.col(f"_{c}")).otherwise(F.coalesce(F.col(c), F.lit(0))))
    for c in texts:
        df = df.withColumn(c, F.when((F.coalesce(F.trim(F.col(c)), F.lit("")) == "") & (F.coalesce(F.col(f"_{c}"), F.lit("")) != ""), F.col(f"_{c}")).otherwise(F.col(c)))
    return df.drop("_key", *(f"_{c}" for c in (*counts, *texts)))


def misses(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache lacks; what a remote lookup must fetch."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key).distinct(), key, "left_anti")


def split(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold and rows that don't; null does not hold."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.where(holds), df.where(~holds)


def with_optional(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with the columns of schema that it lacks added as nulls."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in df.columns))


def require(df: DataFrame, *columns: str) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df
