"""Every catalogue query runs, and gives the rows of its SQL."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.operators.topics import STOPWORDS
from folioscope.plans import catalogue


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"f{value + 0.0!r}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert rows
    if sql := catalogue.ORACLE_SQL.get(name):
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["journal", "n", "total_cit", "bradford_zone"]
    assert df.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inverted_index_over_whole_texts(spark, sf_dir, tmp_path):
    far = " ".join(["again"] + [f"w{i}" for i in range(5000)] + ["again", "", "end\nline"])
    docs = spark.createDataFrame([(10**9, far)], "doc_id long, text string")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rebuilt = {r["doc_id"]: r["rebuilt"] for r in catalogue.QUERIES["inverted_index_rebuild_whole"](spark, str(tmp_path)).collect()}
    assert rebuilt == {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}


ACCENTED = [(10**9, "  ÉCOLE \u00a0 d'été: Über-Größe\nle français à l'école", "fr", "src1"), (10**9 + 1, "Niñez y educación, SEÑAL\nniñez señal educación", "es", "src2")]


@pytest.fixture
def accented(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs.union(spark.createDataFrame(ACCENTED, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert sum(not r["text"].isascii() for r in rows) > len(ACCENTED)
    return str(tmp_path), rows


def test_titles_of_all_documents(spark, accented):
    path, rows = accented
    brute = {}
    for r in rows:
        low = r["text"].split("\n")[0].lower()
        spaced = lambda x: re.sub(r"\s+", " ", x).strip(" ")
        brute[r["doc_id"]] = (low.strip(" "), spaced(low), spaced(re.sub(r"[^\w\s]", " ", low)))
    assert {r["id"]: (r["key"], r["spaced"], r["plain"]) for r in catalogue.QUERIES["norm_title_all"](spark, path).collect()} == brute


def test_tokens_of_all_documents(spark, accented):
    path, rows = accented
    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(w for w in re.findall(r"\b[a-z]{4,}\b", r["text"].lower()) if w not in STOPWORDS)
    brute = {(g, w, n, k + 1) for g, c in counts.items() for k, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:15])}
    assert {(r["grp"], r["token"], r["n"], r["rank"]) for r in catalogue.QUERIES["token_counts_all"](spark, path).collect()} == brute
