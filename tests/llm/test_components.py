"""Connected components: results at any size of block, and few jobs, as each leaves threads and records in the driver."""

from __future__ import annotations

import random

import numpy as np
import pytest

from folioscope.llm import common
from folioscope.llm.components import components, least_joined


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return {x: root(x) for x in up}


def graph(seed):
    rng = random.Random(seed)
    chain = rng.sample(range(-(10**9), 10**9), 120)
    star = [(5, -k) for k in range(40)]
    return [*zip(chain, chain[1:], strict=False), *star, *star, *((rng.randrange(10**10, 10**10 + 300), rng.randrange(10**10, 10**10 + 300)) for _ in range(140))]


@pytest.mark.parametrize("block", [3, 50, 1 << 18])
def test_components_at_any_block(spark, block):
    edges = graph(block)
    rows = components(spark.createDataFrame(edges, "src long, dst long"), block=block).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == brute(edges)
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long"), block=block).isEmpty()


def test_edges_of_a_task_take_few_jobs(spark):
    edges = graph(1)
    sc, frame = spark.sparkContext, common.durable(spark.createDataFrame(edges, "src long, dst long"))
    sc.setJobGroup("few-jobs", "components")
    try:
        assert len(components(frame).collect()) == len(brute(edges))
        assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) <= 6
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_least_joined():
    edges = graph(2)
    edges = [e for e in edges if e[0] != e[1]]
    nodes, roots = least_joined(*np.array(edges).T)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == brute(edges)


def test_the_driver_gives_back_what_is_free(spark, monkeypatch):
    asked, plain = [], common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: asked.append(plain(s)))
    common.let_go(spark)
    assert asked in ([True], [False])  # not every JVM has the command
