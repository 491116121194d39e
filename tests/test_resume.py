"""Searches and look-ups that go on where they stopped."""

import json
import os

import pytest

from pyspark.sql import functions as F

from folioscope.sources import cache, keyed, paging
from tests import fake_service


@pytest.fixture
def service(tmp_path):
    return tmp_path


def named(service, names):
    return [f"{service}|{n}" for n in names]


def stream(spark, terms, **options):
    paging.register(spark)
    reader = spark.readStream.format("paged_search").option("terms", json.dumps(terms)).option("fetcher", "tests.fake_service:fetch").option("pauses", "0,0")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def run(d, path, batches):
    """Records of so many batches more."""
    q = d.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(200):
            if q.exception():
                raise q.exception()
            if len([p for p in q.recentProgress if p["numInputRows"]]) >= batches or not q.isActive:
                break
            q.awaitTermination(0.05)
    finally:
        q.stop()


def test_a_stopped_search_goes_on(spark, service):
    d = stream(spark, named(service, "abc"), pages="2")
    for _ in range(5):  # nine pages
        run(d, service, 1)
    rows = spark.read.parquet(f"{service}/out").collect()
    assert sorted((r["term"][-1], r["position"], json.loads(r["record"])["id"]) for r in rows) == sorted((t, i, f"{t}{i}") for t in "abc" for i in range(fake_service.SIZES[t]))
    run(stream(spark, named(service, "abcd"), pages="2"), service, 1)  # a term that is added later
    rows = spark.read.parquet(f"{service}/out").collect()
    assert len(rows) == 34 and sum(r["term"].endswith("|d") for r in rows) == 4


def test_offsets_cover_every_page_once(service):
    s = paging.PagedStream({"terms": json.dumps(named(service, "abc")), "fetcher": "tests.fake_service:fetch", "pages": "3", "most": "18"})
    at, got, seen = s.initialOffset(), [], []
    while True:
        rows, after = s.read(at)
        rows, after = list(rows), json.loads(json.dumps(after))
        if after == at:
            break
        assert list(s.readBetweenOffsets(at, after)) == rows  # as after a failure
        got += rows
        seen.append(at)
        at = after
    assert sorted((r[0][-1], r[1]) for r in got) == sorted([("a", i) for i in range(7)] + [("c", i) for i in range(18)])
    assert len(seen) == 3 and not list(s.readBetweenOffsets(at, at))


def test_a_busy_service_loses_nothing(spark, service):
    d = stream(spark, named(service, "c"), pages="1")
    run(d, service, 2)
    (service / "closed").touch()
    with pytest.raises(Exception, match="stayed busy"):
        run(d, service, 1)
    (service / "closed").unlink()
    for _ in range(2):
        run(d, service, 2)
    assert sorted(json.loads(r["record"])["id"] for r in spark.read.parquet(f"{service}/out").collect()) == sorted(f"c{i}" for i in range(23))


def rows_of(path, spark):
    return sorted((tuple(r) for r in keyed.read(spark, path).collect()), key=str)


def test_a_patch_rewrites_the_buckets_it_meets(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = spark.createDataFrame([(i, i, f"a{i}") for i in range(200)] + [(None, 1, "null")], "k long, n long, v string")
    assert len(keyed.patch(base, path, "k", buckets=16)) == 16
    assert len(rows_of(path, spark)) == 200
    stamps = lambda: {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("_bucket")}
    before = stamps()
    change = spark.createDataFrame([(3, 1, "old"), (3, 2, "new"), (3, 2, "mew"), (999, 5, None), (4, None, None)], "k long, n long, v string")
    met = keyed.patch(change, path, "k", ["n"], fill=True, buckets=16)
    want = {i: (i, i, f"a{i}") for i in range(200)} | {3: (3, 2, "new"), 999: (999, 5, None)}
    assert rows_of(path, spark) == sorted(want.values(), key=str)
    after = stamps()
    assert len(before) == 16 and {d for d in after if after[d] != before[d]} == {f"_bucket={b}" for b in met} and len(met) <= 3
    keyed.patch(change, path, "k", ["n"], fill=True, buckets=16)  # again
    assert rows_of(path, spark) == sorted(want.values(), key=str)
    keyed.patch(spark.createDataFrame([(i, "D") for i in range(200)], "k long, op string"), path, "k", gone=F.col("op") == "D", buckets=16)
    assert [r[:3] for r in rows_of(path, spark)] == [(999, 5, None)]
    assert keyed.patch(base.where("false"), path, "k", buckets=16) == []


def test_a_key_is_asked_for_once_and_again_after_its_time(spark, tmp_path):
    log, path = f"{tmp_path}/log", f"{tmp_path}/memory"

    def fetch(keys):
        with open(log, "a") as f:
            f.write("".join(f"{k}\n" for k in keys if "bad" not in keys or len(keys) == 1))
        if "bad" in keys:
            raise ValueError("no such key")
        return {k: (len(k), k.upper()) for k in keys if not k.startswith("un")}

    def ask(names, now):
        d = spark.createDataFrame([(n,) for n in names], "doi string")
        found = keyed.remembered(d, "doi", path, fetch, "n long, name string", keep=100, keep_missed=10, now=now, batch=4, tasks=2, buckets=8, pauses=(0,)).collect()
        asked = sorted(open(log).read().split()) if os.path.exists(log) else []
        if os.path.exists(log):
            os.remove(log)
        return {r["key"]: tuple(r)[1:] for r in found}, asked

    found, asked = ask(["a", "bb", "un", "bad", "", None, " a", "a"], 1000.0)
    assert found == {"a": (True, 1, "A", None), "bb": (True, 2, "BB", None), "un": (False, None, None, None), "bad": (None, None, None, "ValueError: no such key")}
    assert set(asked) == {"a", "bb", "un", "bad"}
    found, asked = ask(["a", "un", "c", "bad"], 1005.0)
    assert set(asked) == {"c", "bad"} and found["a"] == (True, 1, "A", None) and found["un"][0] is False
    assert ask(["a", "c", "un"], 1006.0)[1] == []
    found, asked = ask(["a", "un", "c"], 1011.0)  # what is not known is asked for again
    assert asked == ["un"]
    assert ask(["a", "c", "bb"], 1101.0)[1] == ["a", "bb"]
    assert ask(["", None], 1.0) == ({}, [])


def test_a_busy_look_up_is_asked_again(spark):
    asked = []

    def fetch(keys):
        asked.append(list(keys))
        if len(asked) < 3:
            raise paging.Busy("status 429")
        return {k: 1 for k in keys}

    assert keyed.answers(fetch, ["a", "b"], (0, 0)) == ({"a": 1, "b": 1}, {}) and asked == [["a", "b"]] * 3
    asked.clear()
    assert keyed.answers(fetch, ["a", "b"], (0,)) == ({}, {"a": "busy: status 429", "b": "busy: status 429"})
    asked.clear()
    assert cache.patiently(fetch, ["a"], (0, 0)) == {"a": 1}
