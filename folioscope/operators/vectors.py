"""Prototype similarity, semantic axes and clustering over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def mean_vectors(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """mean (array<double>) of the vectors of each group, by component."""
    parts = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean"))


def similarities(docs: DataFrame, vector: str, prototypes: DataFrame, limit: int = 1000) -> DataFrame:
    """Add sims, the dot products with the prototypes (name, vector) in the order of their names.

    The prototypes become one row, and their number is checked: they are a hand-written list.
    """
    if prototypes.count() > limit:
        raise ValueError(f"over {limit} prototypes")
    row = prototypes.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "vector"))), lambda s: s["vector"]).alias("_p"))
    return docs.crossJoin(F.broadcast(row)).withColumn("sims", F.transform("_p", lambda p: dot(F.col(vector), p))).drop("_p")


def prototype_scores(docs: DataFrame, vector: str, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Add positive (mean of the two best), negative (best) and margin."""
    d = similarities(docs, vector, positive).withColumnRenamed("sims", "_s")
    best = F.slice(F.sort_array("_s", asc=False), 1, 2)
    d = d.withColumn("positive", F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).drop("_s")
    d = similarities(d, vector, negative).withColumn("negative", F.array_max("sims")).drop("sims")
    return d.withColumn("margin", F.col("positive") - F.col("negative"))


def axis(poles: DataFrame, vector: str = "vector", pole: str = "pole") -> DataFrame:
    """One row: axis, the unit vector from the mean of pole 'low' to that of 'high', and center, the middle of both on it."""
    m = mean_vectors(poles, vector, pole)
    row = m.agg(F.max_by("mean", F.when(F.col(pole) == "high", 1)).alias("h"), F.max_by("mean", F.when(F.col(pole) == "low", 1)).alias("l"))
    row = row.withColumn("axis", unit(minus(F.col("h"), F.col("l"))))
    return row.select("axis", ((dot(F.col("h"), F.col("axis")) + dot(F.col("l"), F.col("axis"))) / 2).alias("center"))


def project(docs: DataFrame, vector: str, axis_row: DataFrame, out: str, centered: bool = False) -> DataFrame:
    """Add out, the place of each vector on the axis (one row: axis, center)."""
    d = docs.crossJoin(F.broadcast(axis_row.select(F.col("axis").alias("_a"), F.col("center").alias("_c"))))
    score = dot(F.col(vector), F.col("_a"))
    return d.withColumn(out, score - F.col("_c") if centered else score).drop("_a", "_c")


def leave_one_out(poles: DataFrame, vector: str = "vector", pole: str = "pole", name: str = "name") -> DataFrame:
    """left_out and axis of the axis without each prototype; poles keep at least one each by the caller's choice."""
    sums = poles.select(pole, name, F.posexplode(vector).alias("_i", "_x"))
    whole = sums.groupBy(pole, "_i").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    variants = poles.select(F.col(name).alias("left_out"), F.col(pole).alias("_of"))
    each = whole.crossJoin(F.broadcast(variants)).join(sums.select(F.col(pole).alias("_p"), F.col(name).alias("left_out"), "_i", "_x").withColumnRenamed("_p", "_of"), ["left_out", "_of", "_i"], "left")
    own = F.col(pole) == F.col("_of")
    mean = (F.col("_s") - F.when(own, F.coalesce("_x", F.lit(0.0))).otherwise(0.0)) / (F.col("_n") - F.when(own, 1).otherwise(0))
    sign = F.when(F.col(pole) == "high", 1.0).otherwise(-1.0)
    parts = each.groupBy("left_out", "_i").agg(F.sum(sign * mean).alias("_d"))
    arrays = parts.groupBy("left_out").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_d"))), lambda s: s["_d"]).alias("_v"))
    return arrays.select("left_out", unit(F.col("_v")).alias("axis"))


def stability_band(rho: Column, passes: float = 0.70, marginal: float = 0.60) -> Column:
    return F.when(rho > passes, "PASS").when(rho > marginal, "MARGINAL").otherwise("FAIL")


def with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, vector: str, k: int = 5, most: int = 9, seed: int = 42) -> tuple[DataFrame, int, float | None]:
    """df with cluster, k and the cosine silhouette.

    k is cut to one less than the rows; 0 searches 2 to `most` for the best silhouette; fewer than
    three rows are one cluster.
    """
    data = with_features(df, vector).cache()
    n = data.count()
    if n < 3:
        data.unpersist()
        return df.withColumn("cluster", F.lit(0)), 1, None
    judge = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster", metricName="silhouette", distanceMeasure="cosine")

    def run(k: int) -> tuple[float, int, DataFrame]:
        found = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", distanceMeasure="cosine").fit(data).transform(data)
        return judge.evaluate(found), k, found

    score, k, found = max((run(c) for c in ([min(k, most, n - 1)] if k else range(2, min(most, n - 1) + 1))), key=lambda r: r[0])
    data.unpersist()  # the result reads its source anew
    return found.drop("_features"), k, score


def pca2(df: DataFrame, vector: str) -> DataFrame:
    """Add x and y, the first two principal components; stands in for a neighbour embedding, which Spark lacks."""
    data = with_features(df, vector)
    placed = PCA(k=2, inputCol="_features", outputCol="_pc").fit(data).transform(data).withColumn("_pc", vector_to_array("_pc"))
    return placed.withColumn("x", F.col("_pc")[0]).withColumn("y", F.col("_pc")[1]).drop("_features", "_pc")


def ellipse(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Centre, half axes (one standard deviation) and angle of each group's covariance ellipse."""
    m = df.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("_a"), F.var_samp(y).alias("_b"), F.covar_samp(x, y).alias("_c"))
    mid, gap = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, 2) + F.pow("_c", 2))
    return m.select(*by, "cx", "cy", F.sqrt(mid + gap).alias("major"), F.sqrt(F.greatest(mid - gap, F.lit(0.0))).alias("minor"), (F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b")) / 2).alias("angle"))


def encode_missing(texts: DataFrame, cache: DataFrame, encoder, batch: int = 64) -> DataFrame:
    """key and vector of every text: those in the cache (key, vector), others from encoder(list of texts) in batches on the executors.

    The key is the text's SHA-256, so equal texts are encoded once.
    """
    keyed = texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                yield pd.DataFrame({"key": part["key"], "vector": [list(map(float, v)) for v in encoder(part["text"].tolist())]})

    new = keyed.join(cache.select("key"), "key", "left_anti").mapInPandas(run, "key string, vector array<float>")
    return cache.join(keyed.select("key"), "key", "left_semi").select("key", "vector").unionByName(new)
