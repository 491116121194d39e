"""Queries whose work has to grow no faster than their tables: plans and results on small ones."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import rules, topics
from folioscope.plans import catalogue
from folioscope.sources import works


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_travel_once(spark, sf_dir):
    rng = random.Random(5)
    texts = [(rng.choice("abc"), " ".join(rng.choice(["alpha", "beta", "gamma", "the", "delta"]) for _ in range(rng.randint(0, 30)))) for _ in range(40)]
    docs = spark.createDataFrame([*texts, (None, "alpha beta"), ("a", None)], "source string, text string")
    tf = Counter()
    for source, text in texts:
        words = [w for w in text.split() if w != "the"]
        tf.update((source, " ".join(words[i : i + n])) for n in (2, 3) for i in range(len(words) - n + 1))
    for most in (1, 7, 1000):
        got = topics.phrase_counts(topics.tokens(docs.where("source is not null"), "text", "source"), most=most).groupBy("group", "phrase").agg(F.sum("n").alias("n"))
        assert {(r["group"], r["phrase"]): r["n"] for r in got.collect()} == tf
    df = Counter(p for _, p in tf)
    scored = topics.class_tfidf(docs, "text", "source", 1.0)
    assert {(r["group"], r["phrase"]): (r["tf"], r["df"]) for r in scored.collect()} == {k: (n, df[k[1]]) for k, n in tf.items()}
    for name in ("ctfidf_topics", "topic_phrases"):
        text = plan(catalogue.QUERIES[name](spark, sf_dir))
        assert len(re.findall(r"Exchange hashpartitioning\((?:group#\d+, )?phrase#", text)) == 1


def test_index_of_words_stays_in_its_row(spark, tmp_path):
    texts = ["a b a  c b a", "", " ", "one", None, "x " * 300 + "y", "a b a  c b a"]
    docs = spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    index = docs.select("text", works.inverted_index(F.split("text", " ")).alias("m"))
    for r in index.collect():
        assert r["m"] == (None if r["text"] is None else {w: [i for i, x in enumerate(r["text"].split(" ")) if x == w] for w in r["text"].split(" ")})
    for name, most in (("inverted_index_rebuild_whole", 1 << 30), ("inverted_index_rebuild", 40)):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        assert "Exchange" not in plan(got)
        assert sorted(map(str, ((r["doc_id"], r["rebuilt"]) for r in got.collect()))) == sorted(map(str, ((k % 6, None if t is None else " ".join(t.split(" ")[:most])) for k, t in enumerate(texts))))
    assert spark.createDataFrame([([],)], "w array<string>").select(works.inverted_index(F.col("w")).alias("m")).first()["m"] == {}


def test_a_filter_on_decisions_runs_no_rule_again(spark, sf_dir):
    rules_run = [plan(catalogue.QUERIES[name](spark, sf_dir)).count("RLIKE") for name in ("screening_decisions", "screened_corpus")]
    assert rules_run[0] == rules_run[1] > 0
    docs = spark.createDataFrame([(None, None), ("t", "x" * 60), ("ai literacy", "a large language model " * 4)], "title string, abstract string").withColumn("publication_year", F.lit(2024))
    decided = rules.screen(docs)
    assert plan(rules.screened_corpus(decided)).count("RLIKE") == plan(decided).count("RLIKE")
    assert [r["title"] for r in rules.screened_corpus(decided).collect()] == ["ai literacy"]


def test_rules_read_only_texts_that_hold_an_opening(spark, sf_dir):
    tables = [rules.POSITIVE, rules.AI_SIGNALS, rules.NEGATIVE, {"title": rules.OFFTOPIC_TITLE, "topic": rules.OFFTOPIC_TOPIC, "retracted": rules.RETRACTED, "quality": rules.LOW_QUALITY}]
    odd = {"optional": r"(?iU)\b(?:ab?c|x-?y|(?:no|)ne|f{2}|[gh]i)\b", "before": r"(?iU)\b(?:(?:da)?de|Q*r)", "dotted": r"(?iU)\b(?:İi|kiss?|q(?:a|b(?:c|d))+e)\b"}
    opened = T.Opened(*tables, odd)
    assert {p for t in tables for p in t.values()} - set(opened.of) == {rules.RETRACTED, rules.LOW_QUALITY} and set(odd.values()) & set(opened.of) == {odd["dotted"]}
    rng = random.Random(6)
    pieces = [w for t in tables for p in t.values() for w in re.findall(r"[\w -]{2,}", p) if not w.startswith("b ")]
    pieces += ["ai", "AI", "K12", "k-12", "\u212a12", "cla\u017f\u017fifier", "L\u0130brary", "ÉTICA de publicação", "chatgpt", "GPT-4o", "GPT5", "İi", "ii", "KISS", "kis", "qbde", "qaae", "abc", "ac", "xy", "one", "ne", "de", "dade", "\n", "\u00a0", "-", "e\u0301", "é", "\u2028", "tumour", "tumors"]
    texts = [None, "", "\n", *("".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", " ", "", "\n", ", "]) for w in rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(1500))]
    d = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("found", opened.found(F.col("text")))
    text, found = F.col("text"), F.col("found")
    both = d.select("text", *(c for t in [*tables, odd] for c in (opened.matching_labels(text, found, t), T.matching_labels(text, t)))).collect()
    for r in both:
        assert r[1::2] == r[2::2], r
    assert all(any(label in cell for r in both for cell in r[1::2]) for t in [*tables[:3], odd] for label in t)
    none = T.Opened({"a": "b"})
    assert d.select(none.any_match(text, none.found(text), "b").alias("x")).where("x").count() == d.where(text.contains("b")).count()
    lines = plan(catalogue.QUERIES["rules_matched"](spark, sf_dir))
    assert "regexp_extract_all" in lines and "RLIKE(found#" in lines
