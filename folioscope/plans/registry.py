"""Registration of catalogue queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, and views of them in the roles of papers, authors and journals."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def papers(self) -> DataFrame:
        """Orders as papers: the order's year, and thousands of its price as citations."""
        return self.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).alias("cit"), "o_custkey", "o_orderstatus", "o_orderpriority")

    def keywords(self, column: str = "p_type") -> DataFrame:
        """id and kws, the distinct part types of an order as its keywords."""
        d = self.lineitem.select("l_orderkey", "l_partkey").join(self.part.select("p_partkey", column), F.col("l_partkey") == F.col("p_partkey"))
        return d.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(column)).alias("kws"))

    def records(self) -> DataFrame:
        """Documents as records: the first line as title, the whole text as abstract, the source."""
        return self.documents.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), "lang", "source")


#: The same views for DuckDB, to put behind WITH.
PAPERS = "papers AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cit, o_custkey, o_orderstatus, o_orderpriority FROM orders)"
KEYWORDS = "kw AS (SELECT DISTINCT l_orderkey AS id, p_type AS k FROM lineitem JOIN part ON l_partkey = p_partkey)"
RECORDS = "records AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, lang, source FROM documents)"
BRANDS = "j AS (SELECT p_brand AS journal, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_cit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(column: Column | str) -> Column:
    return F.round(column, 6)
