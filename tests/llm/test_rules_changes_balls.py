"""Quality rules, change points and ball k-means against SQL, brute force and awkward tables."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter
from datetime import datetime

import duckdb
import numpy as np
import pytest

from folioscope.llm import ball_kmeans, changepoints, quality
from folioscope.llm.queries import ORACLE_SQL, QUERIES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_change_points", "op12_ball_kmeans", "op13_quality_rules"])
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    cursor = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    assert rows(df.select(order)) == sorted((tuple(r[names.index(k)] for k in order) for r in cursor.fetchall()), key=str)


# quality rules

AWKWARD = [
    None, "", " \t\n", "one", "a b c a b c", "a b a b a b a b", "x " * 3000, "ab cd é ü", "#*$%&|<>", "l\nl\n\nl \nl", "a\x0bb\x0cc\rd", "1 2 3 4 a1 ٣",
    " ".join(f"w{i % 700}" for i in range(40_000)), " ".join(f"w{i}" for i in range(30_000)), "z" * 200_000, "a a a", "a b c d e f a b c x d e f",
]


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    letters = sum(any(c.isalpha() for c in x) for x in w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered), letters


def verdict(m):
    n, chars, symbols, lines, dup, repeat, letters = m
    return [n < 50, 100 * repeat > 50 * n, 10 * symbols > n, 2 * dup > lines, chars < 3 * n, chars > 10 * n, 10 * letters < 8 * n]


def test_ledger_by_brute_force(spark):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choices(["a", "b", " ", " ", "\n", "#", "\t", "é", "1"], k=rng.randint(1, 120))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, failed int")
    found = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        m = counted(t)
        assert tuple(found[i][c] for c in quality.MEASURES) == m, t
        assert found[i]["failed"] == sum(1 << b for b, x in enumerate(verdict(m)) if x)


def test_hashes_that_agree_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d a b c"), (2, "a b c d e f a b d")], "doc_id long, text string")
    monkeypatch.setattr(quality, "PLACE_BITS", 62)  # two bits of the hash are left
    assert [r["n_repeat_words"] for r in quality.measured(docs).orderBy("doc_id").collect()] == [6, 0]


def test_policies_and_ablations(spark):
    bits = [0, 1, 2, 3, 4, 8, 12, 16, 48, 64, 65, None]
    d = spark.createDataFrame([(i % 2, b) for i, b in enumerate(bits)], "g int, failed long")
    policy = quality.Policy(9, quality.mask("few_words", "symbols"), quality.mask("short_words", "long_words"), 1)
    gone = lambda b, hard, soft: bool(b & hard) or bin(b & soft).count("1") > 1
    verdicts = quality.applied(d, [policy]).collect()
    assert [r["kept_v9"] for r in verdicts] == [not gone(b or 0, 5, 48) for b in bits]
    assert [r["sole_failure"] for r in verdicts] == [{1: 0, 2: 1, 4: 2, 8: 3, 16: 4, 64: 6}.get(b) for b in bits]
    found = {(r["g"], r["rule"]): tuple(r)[2:] for r in quality.ablations(d, policy, within=["g"]).collect()}
    for g in (0, 1):
        own = [b or 0 for i, b in enumerate(bits) if i % 2 == g]
        for name, bit in (("few_words", 1), ("symbols", 4), ("short_words", 16), ("long_words", 32)):
            regained = sum(gone(b, 5, 48) and not gone(b, 5 & ~bit, 48 & ~bit) for b in own)
            assert found[g, name] == (len(own), sum(bool(b & bit) for b in own), sum(not gone(b, 5, 48) for b in own), regained)
    assert len(found) == 8


def test_quality_of_awkward_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert quality.judged(docs).count() == 3
    assert quality.judged(docs.where("false")).collect() == []
    assert [r["n"] for r in quality.ablations(quality.ledger(docs.where("false"))).collect()] == [0] * 7


def test_quality_stays_in_the_jvm_without_exchange(spark, sf_dir):
    plan = QUERIES["op13_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Window", plan)


# change points


def best_cut(v, least, penalty):
    n = len(v)

    def cost(a, b):
        m, s, q = b - a, sum(v[a:b]), sum(x * x for x in v[a:b])
        return m * math.floor(1000 * math.log(1 + (m * q - s * s) // (m * m)))

    def cuts(end):
        yield [0]
        for s in range(least, end - least + 1):
            for x in cuts(s):
                yield [*x, s]

    keys = ((sum(cost(a, b) for a, b in itertools.pairwise([*x, n])) + penalty * (len(x) - 1), len(x), x[::-1]) for x in cuts(n))
    c, _, x = min(keys)
    return x[::-1], c


def test_segments_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        least = rng.choice([1, 2, 3])
        big = rng.choice([1, 3, 50, 1000, 10**12])
        v = [rng.randint(-big, big) * rng.choice([1, 1, 3]) if rng.random() > 0.2 else 0 for _ in range(rng.randint(1, 12 if least > 1 else 9))]
        penalty = rng.choice([0, 500, 2000, 20000])
        assert changepoints.segment(v, least, penalty)[:2] == best_cut(v, least, penalty)


def test_ties_and_bounds():
    assert changepoints.segment([5] * 60) == ([0], 0, 1)  # equal costs: fewest segments, nothing else opened
    assert changepoints.segment([]) == ([], 0, 0)
    assert changepoints.segment([1, 9])[0] == [0]
    rng = random.Random(2)
    for big in (2, 40, 3000):
        v = [rng.randint(0, big) for _ in range(40)]
        sums, squares = changepoints.prefix_sums(v)
        low = changepoints.prefix_bounds(sums, squares, 20000)
        assert all(low[t] <= changepoints.segment(v[:t], 7, 20000)[1] for t in range(1, 41))


def test_long_series_agree_with_short_tables(monkeypatch):
    rng = random.Random(5)
    v = [int(rng.gauss(40 if i // 90 % 2 else 400, 12)) for i in range(500)]
    whole = changepoints.segment(v)
    monkeypatch.setattr(changepoints, "TABLE_DAYS", 10)
    assert changepoints.segment(v) == whole and len(whole[0]) > 3


def test_change_points_of_awkward_tables(spark):
    day = lambda d: datetime(2024, 1, 1 + d)
    lines = [(1, 3, "kept", day(0)), (1, 3, "kept", day(0)), (1, None, "kept", day(3)), (1, 2, "kept", None), (1, 9, "returned", day(9)), (1, 1, None, day(9)), (None, 4, "kept", day(2)), (None, -4, "kept", day(5)), (2, None, "kept", day(1))]
    t = spark.createDataFrame(lines, "vendor_id long, quantity int, flag string, shipped_at timestamp_ntz").selectExpr("*", "1 AS cost", "2 AS segment_no")
    first = (datetime(2024, 1, 1) - datetime(1970, 1, 1)).days
    assert rows(changepoints.vendor_segments(t)) == sorted([(1, 1, first, 1, 6, 1, 0, 1, 0), (None, 1, first + 2, 4, 0, 9, 8788, 1, 8788)], key=str)
    assert changepoints.vendor_segments(t.where("false")).collect() == []


def test_a_hot_series_is_summed_before_it_is_dealt(spark, sf_dir):
    plan = QUERIES["op11_change_points"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "SinglePartition" not in plan and "Broadcast" not in plan


# ball k-means


def plain(vectors, k, rounds, first):
    c = [list(v) for v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in vectors]
        for j in range(len(c)):
            if mine := [v for v, o in zip(vectors, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return c, [near(v) for v in vectors]


def test_balls_assign_as_all_distances_do():
    rng = np.random.default_rng(1)
    for spread in (0, 1, 5, 40, 2000):
        centroids = rng.integers(-60, 60, (8, 3)).astype(np.int64)
        centroids[5] = centroids[2]
        v = np.concatenate([centroids[rng.integers(0, 8, 500)] + rng.integers(-spread, spread + 1, (500, 3)), (centroids[:4] + centroids[4:]) // 2])
        d = ((v[:, None, :] - centroids) ** 2).sum(axis=2)
        for home in (np.zeros(len(v), dtype=np.int32), rng.integers(0, 8, len(v)).astype(np.int32), d.argmin(axis=1).astype(np.int32)):
            c, distance, _ = ball_kmeans.Balls(centroids).assign(v, home)
            assert (c == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_stable_cores_take_one_distance():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-10_000, 10_000, (8, 64)).astype(np.int64)
    home = rng.integers(0, 8, 4000).astype(np.int32)
    _, _, taken = ball_kmeans.Balls(centroids).assign(centroids[home] + rng.integers(-50, 51, (4000, 64)), home)
    assert taken == 4000


@pytest.mark.parametrize("moved", [0.0, 1.0])
def test_clusters_by_brute_force(spark, moved):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (5, 4))
    vectors = [[float(x) for x in base[i % 5] + rng.normal(0, 0.2, 4)] for i in range(300)]
    rows_ = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7])] * 40 + [(None, vectors[9])] * 2
    d = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(5)
    ints = [[math.floor(16 * x) for x in v] for _, v in rows_]
    order = sorted(range(len(rows_)), key=lambda i: (rows_[i][0] is None, hashlib.sha256(f"3:{rows_[i][0]}".encode()).hexdigest() if rows_[i][0] is not None else "", ints[i]))
    c, near = plain(ints, 6, 4, [ints[i] for i in order[:6]])
    total = Counter()
    for dist, k in near:
        total[k] += dist
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    want = sorted(((rows_[i][0], k, dist, total[k], sum(total.values()), sha[k]) for i, (dist, k) in enumerate(near)), key=str)
    assert rows(ball_kmeans.cluster(d, dimensions=4, scale=16, k=6, rounds=4, moved=moved)) == want


def test_vectors_that_take_no_part(spark):
    ok = [0.5] * 64
    bad = [None, [], ok[:63], ok + [0.1], [*ok[:63], None], [*ok[:63], float("nan")], [float("inf"), *ok[:63]], [-float("inf"), *ok[:63]]]
    t = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate([*bad, ok])], "vec_id long, embedding array<float>, home int, v string")
    found = ball_kmeans.cluster(t)
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in found.collect()] == [(8, 0, 0, 0)]
    none = ball_kmeans.cluster(t.where("vec_id < 8"))
    assert none.collect() == [] and none.dtypes == found.dtypes
    with pytest.raises(Exception, match="a component beyond"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """Near copies are linked by fingerprints before the index is asked; the rest of the links is the index's."""
    from folioscope.llm import near_texts, simhash

    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in sorted(prints):
        for bits in (1, 4, 5):
            prints.add(p ^ sum(1 << k for k in rng.sample(range(64), bits)))
    signed = sorted(p - (1 << 63) for p in prints)
    far = lambda a, b: (a + (1 << 63) ^ b + (1 << 63)).bit_count()
    want = {a: min((far(a, b), b) for b in signed if a != b) for a in signed}
    found = simhash.nearest(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert {r["src"]: r["dst"] for r in found} == {a: b for a, (d, b) in want.items() if d <= 4}
    asked, plain = [], simhash.nearest
    monkeypatch.setattr(near_texts, "nearest", lambda d: asked.append(plain(d).count()) or plain(d))
    words = [f"w{k}" for k in range(1500)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), "quite another text that stands alone here"]
    groups = near_texts.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == {0: 0, 1: 0, 2: 2}
    assert asked == [2] or asked == [0]
