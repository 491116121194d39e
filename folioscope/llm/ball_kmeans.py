"""Exact k-means over integer vectors, with clusters as balls.

A cluster's members lie in a ball around its centroid.  A member that is nearer to it than half of
the way to any other centroid is in the stable core and stays without further distances.  The
others lie in annuli between half the distances to the neighbours, in rising order: a member of the
annulus behind the m-th neighbour is compared with the first m only.  The neighbours of a ball are
the centroids within twice its radius.  The tests are strict and in integers, so assignments are
those of comparing with every centroid.

Points stay in a table with the cluster that they had when it was written, their home; a round is
one scan of it that returns a few sums for each task, and once a tenth of the points have left
their homes the table is written anew.  Whatever the home, a point's assignment is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import small_batches, stored

#: The contract's: components, their scale, clusters, rounds and the seed of the first centroids.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: The part of the points that may be away from home before the table is written again.
MOVED = 0.1


def widest(dimensions: int) -> int:
    """Components of up to so much keep four times a squared distance in 64 bits."""
    return int((2.0**62 / (16 * dimensions)) ** 0.5)


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """key and v, floor(scale * x) of each component, for vectors of so many components, none of them null or non-finite.

    Others take no part.  A component of which squares would leave 64 bits fails the query with a message.
    """
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_x")).where((F.size("_x") == dimensions) & F.coalesce(finite, F.lit(False)))
    most = widest(dimensions)
    whole = lambda x: F.when(F.abs(scale * x.cast("double")) <= most, F.floor(scale * x.cast("double"))).otherwise(F.raise_error(F.lit(f"a component beyond {most / scale:g}"))).cast("int")
    return kept.select(F.col("_key").alias(key), F.transform("_x", whole).alias("v"))


def first_centroids(points: DataFrame, key: str, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of seed:key, in that order, null keys last, equal keys by their components; fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = points.select("v", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


class Balls:
    """Centroids with their squared distances and, for each, the others in rising order of distance."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    def assign(self, v: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row of v (ties: the smaller number), its squared distance, and how many distances were taken."""
        cluster, distance, taken = home.astype(np.int64), np.zeros(len(v), dtype=np.int64), len(v)
        for c in np.unique(cluster):
            members = np.flatnonzero(home == c)
            own = ((v[members] - self.centroids[c]) ** 2).sum(axis=1)
            near = self.order[c][(self.order[c] != c) & (self.apart[c][self.order[c]] <= 4 * own.max())]  # neighbours of the ball
            annulus = np.searchsorted(self.apart[c][near], 4 * own, side="right")  # 0 is the stable core
            best, which = own.copy(), np.full(len(members), c)
            for m, other in enumerate(near):
                at = np.flatnonzero(annulus > m)
                d = ((v[members[at]] - self.centroids[other]) ** 2).sum(axis=1)
                nearer = (d < best[at]) | (d == best[at]) & (other < which[at])
                best[at[nearer]], which[at[nearer]] = d[nearer], other
                taken += len(at)
            cluster[members], distance[members] = which, best
        return cluster, distance, taken


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def assigned(points: DataFrame, centroids: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """The columns named of each point, with home (its cluster now) and distance."""
    balls, dimensions = Balls(centroids), centroids.shape[1]
    fields = [points.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance, _ = balls.assign(_matrix(b.column("v"), dimensions), b.column("home").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[*keep, "home", "distance"])

    return points.mapInArrow(run, StructType([*fields, StructField("home", IntegerType()), StructField("distance", LongType())]))


def sums(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Of one scan: each cluster's points, component sums and distance, how many points are away from home, and distances taken.

    A task returns a row for each cluster; they are added up before anything reaches the driver.
    """
    balls, (k, dimensions) = Balls(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moved, taken = np.zeros((k, dimensions + 2), dtype=np.int64), 0, 0
        for b in batches:
            if b.num_rows:
                v, home = _matrix(b.column("v"), dimensions), b.column("home").to_numpy()
                cluster, distance, n = balls.assign(v, home)
                moved, taken = moved + int((cluster != home).sum()), taken + n
                for c in np.unique(cluster):
                    at = cluster == c
                    total[c] += np.concatenate([[at.sum(), distance[at].sum()], v[at].sum(axis=0)])
        rows = [[*map(int, r), moved if c == 0 else 0, taken if c == 0 else 0] for c, r in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = points.select("v", "home").mapInArrow(run, "cluster int, sums array<bigint>")
    rows = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col")).collect()  # so many for each cluster
    out = np.zeros((k, dimensions + 4), dtype=np.int64)
    for c, place, x in rows:
        out[c, place] = x
    return out[:, 0], out[:, 2:-2], out[:, 1], int(out[:, -2].sum()), int(out[:, -1].sum())


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, moved: float = MOVED) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part.

    Every round assigns all vectors to their nearest centroid and moves the centroids to the floor
    of the means; one without vectors stays where it is.  Vectors of another length, null ones and
    those with null or non-finite components take no part; a table without any gives no rows.
    Repeated rows and null or repeated keys are vectors of their own.  Where fewer than k vectors
    take part there are as many clusters.  Other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark, rows=10_000)
    points = integers(rows, key, vector, dimensions, scale)
    centroids = first_centroids(points, key, k, seed)
    if not len(centroids):
        return points.select(key).where("false").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    names = [key, "v"]
    home = lambda df: stored(assigned(df, centroids, names).select(*names, "home"), "points")
    table = home(points.withColumn("home", F.lit(0)))
    for _ in range(rounds):
        n, total, _, away, _ = sums(table, centroids)
        centroids = np.array([[int(x) // int(m) for x in t] if m else list(c) for m, t, c in zip(n, total, centroids, strict=True)], dtype=np.int64)
        if away > moved * n.sum():
            table = home(table)
    _, _, inertia, _, _ = sums(table, centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, int(d), sum(map(int, inertia)), h) for c, (d, h) in enumerate(zip(inertia, digests, strict=True))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = assigned(table, centroids, [key]).withColumnRenamed("home", "cluster")
    return found.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql() -> str:
    """Each round in full: every distance, then the floors of the means."""
    near = "SELECT r, k, d FROM (SELECT r, k, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p, c{i} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1"
    mean = "SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i} JOIN p USING (r), range(1, {d}) t(i) GROUP BY 1, 2) GROUP BY 1) m USING (k)"
    steps = [f"a{i} AS MATERIALIZED ({near.format(i=i)})" + (f", c{i + 1} AS MATERIALIZED ({mean.format(i=i, d=DIMENSIONS + 1)})" if i < ROUNDS else "") for i in range(ROUNDS + 1)]
    return f"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM p QUALIFY k < {CLUSTERS}), {", ".join(steps)}
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN p USING (r) JOIN c{ROUNDS} c USING (k)"""
