"""Content-addressed tables of fetched records, discovery of earlier results, and lookups by key."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paging import Busy, answer


def cache_key(parameters: Mapping) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, root: str, source: str, parameters: Mapping, make: Callable[[], DataFrame], enabled: bool = True) -> DataFrame:
    """The table for these parameters, made and written if it isn't there yet; a write that failed left no success mark and is made again."""
    path = f"{root}/{source}/{cache_key(parameters)}"
    if not enabled:
        return make()
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest(spark: SparkSession, candidates: list[str], columns: set[str]) -> str | None:
    """The latest written of the candidate tables that has the columns."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        fs = p.getFileSystem(conf)
        if fs.exists(p) and columns <= set(spark.read.parquet(c).columns):
            found.append((fs.getFileStatus(p).getModificationTime(), c))
    return max(found)[1] if found else None


def seed(spark: SparkSession, candidates: list[str], source: str) -> DataFrame | None:
    path = newest(spark, candidates, {"id", "data_source"})
    return spark.read.parquet(path).where(F.col("data_source") == source) if path else None


def patiently(fetch: Callable[[list[str]], Mapping[str, object]], keys: list[str], pauses: Sequence[float]) -> Mapping[str, object]:
    for pause in pauses:
        try:
            return fetch(keys)
        except Busy:
            time.sleep(pause)
    return fetch(keys)


def look_up(keys: DataFrame, key: str, known: DataFrame, fetch: Callable[[list[str]], Mapping[str, object]], batch: int = 50, tasks: int = 4, pauses: Sequence[float] = (10, 20, 40, 60)) -> DataFrame:
    """known (key and what is known of it) with the rest of the keys fetched in batches by at most `tasks` tasks.

    `fetch` gives a value, or a tuple of them, for each key that it finds; others are remembered
    with zeros and empty texts, so that no key is asked for twice.  A busy service is asked again
    after each pause; any other failure is raised (keyed.remembered goes on without the keys at fault).
    """
    wanted = keys.select(F.col(key).cast("string").alias("key")).where("key <> ''").distinct().join(known, "key", "left_anti")
    fields = [f for f in known.schema if f.name != "key"]
    empty = tuple("" if f.dataType.typeName() == "string" else 0 for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b["key"].iloc[s : s + batch].tolist()
                found = patiently(fetch, part, pauses)
                rows = [found.get(k, empty) for k in part]
                rows = [r if isinstance(r, tuple) else (r,) for r in rows]
                yield pd.DataFrame({"key": part} | {f.name: [r[i] for r in rows] for i, f in enumerate(fields)})

    schema = ", ".join(["key string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)])
    return known.unionByName(wanted.repartition(tasks).mapInPandas(run, schema))


def works_by_doi(get: Callable[[dict], tuple[int, Mapping]]) -> Callable[[list[str]], Mapping[str, object]]:
    """For look_up in batches of 50: citations and countries of works by DOI."""

    def fetch(dois: list[str]) -> Mapping[str, object]:
        status, payload = get({"filter": "doi:" + "|".join(dois), "select": "doi,cited_by_count,authorships", "per-page": min(len(dois), 200)})
        payload = answer(status, payload)
        out = {}
        for r in payload.get("results", []):
            doi = (r.get("doi") or "").strip().lower().removeprefix("https://doi.org/")
            codes = {i["country_code"] for a in r.get("authorships") or [] for i in a.get("institutions") or [] if i.get("country_code")}
            if doi:
                out[doi] = (int(r.get("cited_by_count") or 0), "|".join(sorted(codes)))
        return out

    return fetch


def citations_by_pmid(get: Callable[[dict], tuple[int, Mapping]]) -> Callable[[list[str]], Mapping[str, object]]:
    """For look_up in batches of 25: citations of articles by PubMed id."""

    def fetch(pmids: list[str]) -> Mapping[str, object]:
        query = "(" + " OR ".join(f"EXT_ID:{p}" for p in pmids) + ") AND SRC:MED"
        status, payload = get({"query": query, "format": "json", "resultType": "lite", "pageSize": len(pmids)})
        payload = answer(status, payload)
        found = (payload.get("resultList") or {}).get("result", [])
        return {str(r.get("pmid", "")).strip(): int(r.get("citedByCount") or 0) for r in (found if isinstance(found, list) else [found]) if str(r.get("pmid", "")).strip()}

    return fetch


def backfill(records: DataFrame, first: DataFrame, second: DataFrame, most: int, order: str = "id") -> DataFrame:
    """abstract filled for the first `most` records that lack one but have a DOI, from two tables (doi, abstract) in turn."""
    lacking = records.where("coalesce(trim(abstract), '') = '' and coalesce(doi, '') <> ''").orderBy(order).limit(most).select(F.col(order).alias("_id"), "doi")
    found = lacking.join(first.select("doi", F.col("abstract").alias("_a")), "doi", "left").join(second.select("doi", F.col("abstract").alias("_b")), "doi", "left").select("_id", F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit(""))).alias("_new"))
    return records.join(found, F.col(order) == F.col("_id"), "left").withColumn("abstract", F.coalesce("_new", "abstract")).drop("_id", "_new")
