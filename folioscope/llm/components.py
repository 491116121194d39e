"""Connected components: edges are joined within tasks, what lies in several tasks by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges of 16 bytes that a task joins at a time, at most.
BLOCK = 1 << 18


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))"), F.expr("sum(cast(xxhash64(dst, src) as decimal(38)))")).first()
    return tuple(row)


def least_joined(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, ascending, and for each the least node that they join it to."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _stars(block: int, roots: bool):
    """Of edges (src, dst), in blocks: each node and the least that its block joins it to, with `roots` also the least themselves."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, root = least_joined(*(np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)))
        some = slice(None) if roots else node != root
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some])], ["node", "root"] if roots else ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                if n and n + part.num_rows > block:
                    yield joined(parts)
                    parts, n = [], 0
                parts.append(part)
                n += part.num_rows
        if n:
            yield joined(parts)

    return run


def components(edges: DataFrame, rounds: int = 60, block: int = BLOCK) -> DataFrame:
    """node and root for each node of the undirected edges (src, dst); root is the least node.

    Each task joins its own edges first, `block` of them at a time, and hands on one star for each
    group of them.  At most `block` edges that are left are one task's, and done.  Of more, each
    round links every node's larger neighbours, then its smaller ones, to the least of them, and
    joins within tasks again; the edges end as one star for each component.  Edges stay in tables
    throughout: a round writes a checkpoint, and the driver sees only its count and checksum, but
    every round is some ten jobs, whose plans, threads and records the driver holds.  The stars'
    minima are aggregates with a partial step and the joins to them can be split, so a hub of any
    degree is shared out.
    """
    within = _stars(block, False)
    edges = durable(edges.where("src <> dst").select("src", "dst").mapInArrow(within, "src long, dst long"))
    seen = _stamp(edges)
    for _ in range(rounds):
        if seen[0] <= block:
            return edges.coalesce(1).mapInArrow(_stars(block, True), "node long, root long")
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        # The node itself hangs below its least neighbour already, from that neighbour's side.
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array("src", "dst")).alias("src"), F.col("low").alias("dst"))
        edges = durable(small.where("src <> dst").distinct().mapInArrow(within, "src long, dst long"))
        now = _stamp(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    nodes = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return nodes.union(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
