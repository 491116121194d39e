"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one point of the index.  Points are dealt into cells by their length, the range
of their norm (powers of four) and the nearest of some centroids, and cells into shards of bounded
size.  A query goes to the cells whose centroids are nearest to it, as many as a measurement on a
bounded sample asks for, so the work grows with the table and not with its square.  A task builds
the graph of a shard as flat neighbour arrays, one for each level, and streams the shard's queries
through it a block at a time; it holds one shard and one block.  Shards' best are merged.

Largest inner product is made nearest distance by one more component: vectors are scaled by the
largest norm of their range and lifted onto the unit sphere, so graphs are built over a metric,
and no vector of extreme norm is in one graph with small ones.  What the graphs find is scored
anew on the original vectors in double precision before any cut.

Both building and searching go breadth-wise: beams of many points advance together in numpy.
Points enter in batches that at most double the graph; those of a batch see the graph before it
and each other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, give_back, parallelism

LINKS, BUILD_BEAM, BEAM = 16, 96, 192
#: Points of a shard, and bytes of their vectors, at most in the mean: beams are tested at this size.
SHARD_POINTS, SHARD_BYTES = 8_192, 32 << 20
#: Cells are smaller only down to this, to occupy the cores.
LEAST_POINTS = 2_048
BLOCK = 256
#: Centroids, and bytes of them, at most.  Larger cells than a shard are cut by a hash, and a query then visits all their shards.
CELLS, CELL_BYTES = 8_192, 64 << 20
#: Vectors, and bytes of them, that centroids and the number of cells to visit are fitted on, at most.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: Part of the sample's true neighbours that must lie in the cells visited.
COVER = 0.95


def lifted(vectors: np.ndarray, power: int) -> np.ndarray:
    """Vectors of norms up to two to the `power`, scaled by that, with one more component that puts them on the unit sphere."""
    scaled = np.ldexp(vectors, -power)
    rest = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
    return np.concatenate([scaled, rest[:, None]], axis=1).astype(np.float32)


def directions(queries: np.ndarray) -> np.ndarray:
    """Queries on the same sphere; their length doesn't matter for which inner product is largest."""
    largest = np.abs(queries).max(axis=1, keepdims=True)
    scaled = queries / np.where(largest > 0, largest, 1)
    norms = np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    return np.concatenate([scaled / np.where(norms > 0, norms, 1), np.zeros((len(queries), 1))], axis=1).astype(np.float32)


class Graph:
    """Points under inner product; level 0 has 2 x links neighbours a point, others links."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 3) -> None:
        exact = np.asarray(vectors, dtype=np.float64)
        n = len(exact)
        largest = np.abs(exact).max(initial=0.0) or 1.0
        norms = np.sqrt(((exact / largest) ** 2).sum(axis=1))
        self.points = lifted(exact / largest / (float(norms.max(initial=0.0)) or 1.0), 0)
        self.links = links
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(np.int64), 12)
        self.tops = int(self.level.max(initial=0))
        # Rows of a level's array belong to the points at or above it, found by `row`.
        self.members = [np.nonzero(self.level >= k)[0] for k in range(self.tops + 1)]
        self.row = [np.full(n, -1, np.int64) for _ in range(self.tops + 1)]
        self.near = []
        for k, m in enumerate(self.members):
            self.row[k][m] = np.arange(len(m))
            self.near.append(np.full((len(m), 2 * links if k == 0 else links), -1, np.int32))
        self.entry = -1
        # High points first, so upper levels lead from the start.
        order = np.argsort(-self.level, kind="stable")
        done = 0
        while done < n:
            size = min(n - done, max(1, min(done, 1024)))
            self._insert(order[done : done + size], beam)
            done += size

    def _distance(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """1 less the inner product: half the squared distance on the sphere."""
        return 1 - np.einsum("bkd,bd->bk", self.points[ids], queries)

    def _search(self, queries: np.ndarray, starts: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (nearest first, -1 and inf where there are fewer) of each query's beam."""
        b, n = len(queries), len(self.points)
        near, row = self.near[level], self.row[level]
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        open_ = np.zeros((b, beam), dtype=bool)
        width = min(starts.shape[1], beam)
        ids[:, :width] = starts[:, :width]
        first = ids[:, :width]
        dist[:, :width] = np.where(first >= 0, self._distance(first, queries), np.inf)
        open_[:, :width] = first >= 0
        seen[np.arange(b)[:, None], np.where(first >= 0, first, n)] = True
        active = np.arange(b)
        while len(active):
            d = np.where(open_[active], dist[active], np.inf)
            pick = d.argmin(axis=1)
            going = np.isfinite(d[np.arange(len(active)), pick])
            active, pick = active[going], pick[going]
            if not len(active):
                break
            open_[active, pick] = False
            found = near[row[ids[active, pick]]].astype(np.int64)
            found[found < 0] = n
            fresh = ~seen[active[:, None], found]
            seen[active[:, None], found] = True
            at = np.where(fresh, found, 0)
            new = self._distance(at, queries[active])
            new[~fresh] = np.inf
            all_d = np.concatenate([dist[active], new], axis=1)
            all_i = np.concatenate([ids[active], at], axis=1)
            all_o = np.concatenate([open_[active], fresh], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[active] = np.take_along_axis(all_d, keep, 1)
            kept = np.take_along_axis(all_i, keep, 1)
            ids[active] = np.where(np.isfinite(dist[active]), kept, -1)
            open_[active] = np.take_along_axis(all_o, keep, 1) & np.isfinite(dist[active])
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def _diverse(self, point: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the point than to any chosen; then the nearest others."""
        b, c = ids.shape
        valid = np.isfinite(dist)
        vectors = self.points[np.where(valid, ids, 0)]
        chosen = np.zeros((b, c), dtype=bool)
        blocked = ~valid
        for j in range(c):
            take = ~blocked[:, j] & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            if take.any():
                gap = 1 - np.einsum("bcd,bd->bc", vectors[take], vectors[take, j])
                blocked[take] |= gap < dist[take]
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * (c + 1) + np.arange(c)
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(valid, keep, 1), np.take_along_axis(ids, keep, 1), -1)

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        if self.entry < 0:
            self.entry = int(batch[0])
            return
        points = self.points[batch]
        starts = np.full((len(batch), 1), self.entry, np.int64)
        top = int(self.level[self.entry])
        among = 1 - points @ points.T
        for k in range(top, -1, -1):
            here = self.level[batch] >= k
            parts = [self._search(points[s : s + BLOCK], starts[s : s + BLOCK], k, beam if here[s : s + BLOCK].any() else 1) for s in range(0, len(batch), BLOCK)]
            width = max(p[0].shape[1] for p in parts)
            ids = np.concatenate([np.pad(p[0], ((0, 0), (0, width - p[0].shape[1])), constant_values=-1) for p in parts])
            dist = np.concatenate([np.pad(p[1], ((0, 0), (0, width - p[1].shape[1])), constant_values=np.inf) for p in parts])
            starts = ids
            if not here.any():
                continue
            own = np.nonzero(here)[0]
            # The nearest of the batch itself count as candidates too.
            peers = among[np.ix_(own, own)].copy()
            np.fill_diagonal(peers, np.inf)
            some = np.argsort(peers, axis=1, kind="stable")[:, :beam]
            cand = np.concatenate([ids[own], batch[own][some]], axis=1)
            cd = np.concatenate([dist[own], np.take_along_axis(peers, some, 1)], axis=1)
            order = np.argsort(cd, axis=1, kind="stable")[:, :beam]
            self._link(k, batch[own], np.take_along_axis(cand, order, 1), np.take_along_axis(cd, order, 1))

    def _link(self, level: int, batch: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        near, row = self.near[level], self.row[level]
        chosen = self._diverse(self.points[batch], ids, dist, self.links)
        near[row[batch], : self.links] = chosen
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, at = np.unique(target, return_index=True)
        most = near.shape[1]
        more = np.split(source, at[1:])
        width = max((len(m) for m in more), default=0)
        if not width:
            return
        back = np.full((len(heads), width), -1, np.int64)
        for k, m in enumerate(more):
            back[k, : len(m)] = m
        cand = np.concatenate([near[row[heads]].astype(np.int64), back], axis=1)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        for s in range(0, len(heads), BLOCK):
            part, who = cand[s : s + BLOCK], heads[s : s + BLOCK]
            d = self._distance(np.where(part >= 0, part, 0), self.points[who])
            d[part < 0] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            part, d = np.take_along_axis(part, order, 1), np.take_along_axis(d, order, 1)
            full = np.isfinite(d).sum(axis=1) > most
            out = part[:, :most].copy()
            if full.any():
                out[full] = self._diverse(self.points[who[full]], part[full], d[full], most)
            near[row[who]] = np.where(np.isfinite(d[:, :most]) | full[:, None], out, -1)

    def nearest(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """The k points found of largest inner product for each query, -1 where there are fewer, in no exact order."""
        if self.entry < 0:
            return np.full((len(queries), k), -1, np.int64)
        beam = min(max(beam, k), len(self.points))
        flat = directions(np.asarray(queries, dtype=np.float64))
        out = []
        for s in range(0, len(flat), BLOCK):
            q = flat[s : s + BLOCK]
            starts = np.full((len(q), 1), self.entry, np.int64)
            for level in range(int(self.level[self.entry]), 0, -1):
                starts = self._search(q, starts, level, 4)[0]
            out.append(self._search(q, starts, 0, beam)[0][:, :k])
        found = np.concatenate(out) if out else np.zeros((0, k), np.int64)
        return np.pad(found, ((0, 0), (0, k - found.shape[1])), constant_values=-1)


class Cells:
    """Centroids for each length and range of norms, and how many of them a query visits."""

    def __init__(self) -> None:
        #: by (length, range): centroids, squared lengths, cells visited, number of the first cell
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int, int]] = {}
        self.n = 0

    def add(self, part: tuple[int, int], vectors: np.ndarray, want: int, k: int, cover: float, seed: int = 1) -> None:
        """Fit `want` centroids on a sample of a part's vectors; more are visited until they hold `cover` of its neighbours."""
        rng = np.random.default_rng(seed)
        points = lifted(vectors, 2 * part[1] + 1)
        want = max(1, min(want, len(points) // 8))
        centres = points[rng.choice(len(points), want, replace=False)].copy() if want > 1 else points.mean(axis=0, keepdims=True)
        for _ in range(10 if want > 1 else 0):
            own = self._nearest(points, centres)
            sums = np.zeros_like(centres, dtype=np.float64)
            np.add.at(sums, own, points)
            counts = np.bincount(own, minlength=want)
            empty = counts == 0
            centres = (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
            centres[empty] = points[rng.integers(0, len(points), int(empty.sum()))]
        visits = 1
        if want > 1:
            own = self._nearest(points, centres)
            asked = rng.choice(len(points), min(512, len(points)), replace=False)
            q, ranks = directions(vectors[asked]), []
            for s in range(0, len(asked), step := max(1, (1 << 21) // len(points))):
                score = -(q[s : s + step] @ points.T)
                score[np.arange(len(score)), asked[s : s + step]] = np.inf
                best = np.argpartition(score, min(k, len(points) - 1) - 1, axis=1)[:, :k]
                order = np.argsort((centres**2).sum(axis=1)[None] - 2 * q[s : s + step] @ centres.T, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(want)[None].repeat(len(order), 0), axis=1)
                ranks.append(np.take_along_axis(place, own[best], axis=1).ravel())
            ranks = np.concatenate(ranks)
            visits = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(cover * len(ranks))))]) + 1
        self.parts[part] = (centres, (centres**2).sum(axis=1), visits, self.n)
        self.n += want

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        lengths = (centres**2).sum(axis=1)
        step = max(1, (1 << 22) // len(centres))
        return np.concatenate([(lengths[None] - 2 * points[s : s + step] @ centres.T).argmin(axis=1) for s in range(0, len(points), step)])

    def of_points(self, vectors: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), -1, np.int64)
        for r in np.unique(ranges):
            mine = np.nonzero(ranges == r)[0]
            centres, _, _, first = self.parts[vectors.shape[1], int(r)]
            out[mine] = first + self._nearest(lifted(vectors[mine], 2 * int(r) + 1), centres)
        return out

    def of_queries(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The cells that each query visits, of every range of its length."""
        q, found = directions(vectors), []
        for (size, _), (centres, lengths, visits, first) in self.parts.items():
            if size == vectors.shape[1]:
                found.append(first + np.argsort(lengths[None] - 2 * q @ centres.T, axis=1, kind="stable")[:, :visits])
        return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * len(vectors)


def norm_ranges(vectors: np.ndarray) -> np.ndarray:
    """The power of four nearest to each vector's norm, computed without overflow."""
    largest = np.abs(vectors).max(axis=1)
    norms = np.sqrt(((vectors / largest[:, None]) ** 2).sum(axis=1))
    return np.floor((np.log2(largest) + np.log2(norms) + 1) / 2).astype(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and the vectors."""
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _usable(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return rows.where(f"vec_id is not null and embedding is not null and {finite} and exists(embedding, x -> x <> 0)")


def _ranged(points: DataFrame) -> DataFrame:
    """Add the column `range` to points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for at, vectors in _by_length(batch.column(1)):
                out[at] = norm_ranges(vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["point", "embedding", "ids", "range"])

    return points.mapInArrow(run, "point string, embedding array<double>, ids array<bigint>, range long")


def fit_cells(points: DataFrame, k: int, shard_points: int, cover: float = COVER) -> Cells:
    """Cells for points (embedding, range), fitted on a bounded sample in a task; the driver gets them and a count for each length and range."""
    counts = {(r["size"], r["range"]): r["count"] for r in points.groupBy(F.size("embedding").alias("size"), "range").count().collect()}
    n, cells = sum(counts.values()), Cells()
    if not n:
        return cells
    longest = max(size for size, _ in counts)
    sample = min(SAMPLE, max(1024, SAMPLE_BYTES // (8 * longest)))
    # A part that the sample has nothing of is one cell.
    level = min((1 << 63) - 1, (1 << 64) * sample // n - (1 << 63))
    most = min(CELLS, max(1, CELL_BYTES // (4 * longest)))
    fine = min(2 * parallelism(points.sparkSession), -(-n // LEAST_POINTS))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            ranges = batch.column(1).to_numpy()
            for at, vectors in _by_length(batch.column(0)):
                for r in np.unique(ranges[at]):
                    parts.setdefault((vectors.shape[1], int(r)), []).append(vectors[ranges[at] == r])
        for (size, r), count in sorted(counts.items()):
            want = min(max(-(-2 * count // shard_points), fine * count // n), -(-most * count // n))
            held = parts.pop((size, r), None)
            if held is None:
                cells.add((size, r), np.ldexp(np.full((1, size), max(1, size) ** -0.5), 2 * r), 1, k, cover)
            else:
                cells.add((size, r), np.concatenate(held), want, k, cover)
        del held
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(cells)], pa.binary())], ["cells"])
        give_back()

    # A range of the hash holds `sample` points or very nearly so.
    some = points.where(F.xxhash64("point") <= level).select("embedding", "range").coalesce(1)
    return pickle.loads(some.mapInArrow(fit, "cells binary").first()[0])


def search(vectors: DataFrame, every: int = 20, k: int = 20, links: int = LINKS, build_beam: int = BUILD_BEAM, beam: int = BEAM, shard_points: int = SHARD_POINTS, cover: float = COVER) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    Nearest is largest inner product in double precision, ties to the smaller vec_id; a query's
    own row is no candidate.  Vectors that are null, zero, or hold a null or non-finite component
    take no part, nor do rows without a vec_id; vectors of another length are no candidates.
    Needs vec_id and embedding; other columns are ignored.  Equal rows count once: a vec_id that
    repeats with the same vector is one candidate and one query.  A vec_id that stands on several
    vectors is one query and one candidate: its score with a vector is the largest over its own.
    Fewer candidates than k give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors).withColumn("point", F.sha2(F.array_join("embedding", ","), 256)).dropDuplicates(["vec_id", "point"])
    # Of equal vectors k + 1 ids are enough: k, and one more for the query's own.
    rank = F.row_number().over(Window.partitionBy("point").orderBy("vec_id"))
    first = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    points = first.groupBy("point").agg(F.min_by("embedding", "r").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = durable(_ranged(points))
    asked = durable(rows.where(F.col("vec_id") % every == 0).select("point", F.col("vec_id").alias("query_id")))
    longest = points.agg(F.max(F.size("embedding"))).first()[0] or 1
    shard_points = max(256, min(shard_points, SHARD_BYTES // (8 * longest)))
    cells = fit_cells(points, k, shard_points, cover)
    sent = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            ranges = batch.column(3).to_numpy()
            for at, some in _by_length(batch.column(1)):
                out[at] = sent.value.of_points(some, ranges[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], ["point", "embedding", "ids", "cell"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for at, some in _by_length(batch.column(1)):
                for j, visited in zip(at, sent.value.of_queries(some), strict=True):
                    out[j] = visited
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], ["point", "embedding", "cells"])

    placed = durable(points.mapInArrow(place, "point string, embedding array<double>, ids array<bigint>, cell long"))
    counts = dict(placed.groupBy("cell").count().collect())  # a row for each cell
    cuts = [max(1, -(-counts.get(c, 0) // shard_points)) for c in range(max(1, cells.n))]
    firsts = np.concatenate([[0], np.cumsum(cuts)]).tolist()
    cut, start = (F.element_at(F.lit(x), F.col("cell").cast("int") + 1) for x in (cuts, firsts[:-1]))
    shards = firsts[-1]
    questions = points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "embedding").mapInArrow(route, "point string, embedding array<double>, cells array<bigint>")
    questions = questions.select("point", "embedding", F.explode("cells").alias("cell")).select("point", "embedding", F.explode(F.sequence(start, start + cut - 1)).alias("shard"))
    none = F.lit(None).cast("array<bigint>").alias("ids")
    stream = placed.select((start + F.pmod(F.xxhash64("point"), cut)).cast("int").alias("shard"), F.lit(0).alias("kind"), "point", "embedding", "ids").union(questions.select(F.col("shard").cast("int"), F.lit(1), "point", "embedding", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: list[np.ndarray] = []
        ids: list[pa.Array] = []
        graph, exact, owners, now = None, np.zeros((0, 0)), None, None
        for batch in batches:
            shard_of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.nonzero((np.diff(shard_of) != 0) | (np.diff(kinds) != 0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if part.num_rows == 0:
                    continue
                if shard_of[a] != now:
                    now, vectors, ids, graph = shard_of[a], [], [], None
                column = part.column(3)
                if kinds[a] == 0:
                    vectors.append(column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                    ids.append(part.column(4))
                    continue
                if not vectors:
                    continue  # queries of an empty shard
                if graph is None:
                    exact, owners = np.concatenate(vectors), pa.concat_arrays(ids)
                    graph, vectors = Graph(exact, links, build_beam), [exact]
                q = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                for s in range(0, len(q), 2048):
                    some = q[s : s + 2048]
                    found = graph.nearest(some, beam, beam)
                    row, col = np.nonzero(found >= 0)
                    hit = found[row, col]
                    score = np.einsum("ij,ij->i", some[row], exact[hit])
                    order = np.lexsort((-score, row))
                    rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                    # Points that tie with the last of the k + 1 stay, for their ids decide.
                    row, hit, score = row[order], hit[order], score[order]
                    last = np.full(len(some), -np.inf)
                    last[row[rank == k]] = score[rank == k]
                    keep = score >= last[row]
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(s + row[keep])), pa.array(score[keep]), owners.take(pa.array(hit[keep]))], ["point", "score", "ids"])

    dealt = stream.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(run, "point string, score double, ids array<bigint>").select("point", "score", F.explode("ids").alias("vec_id"))
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        found = asked.join(found, "point").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    best = F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("point").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    answers = asked.join(best, "point")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
