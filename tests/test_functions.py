from pyspark.sql import functions as F

from folioscope.functions import text as T


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_journal_name(spark):
    f = lambda s: one(spark, T.journal_name(F.col("s")), s=s)
    assert f("  IEEE   access") == "IEEE Access"
    assert f("PLOS one") == "PLOS ONE"
    assert f("o'neil ieee-access") == "O'Neil IEEE-Access"
    assert f(None) == ""


def test_doi(spark):
    assert one(spark, T.norm_doi(F.col("s")), s=" HTTPS://doi.org/10.1/X ") == "10.1/x"
    assert one(spark, T.norm_doi(F.col("s")), s="doi:doi:10.1/x") == "doi:10.1/x"
    assert one(spark, T.bare_doi(F.col("s")), s="doi:doi:10.1/x") == "10.1/x"


def test_titles(spark):
    assert one(spark, T.plain_title(F.col("s")), s=" A  Título: novo? ") == "a título novo"
    assert one(spark, T.norm_title(F.col("s")), s=" A  Título: novo? ") == "a título: novo?"


def test_clean_html(spark):
    assert one(spark, T.clean_html(F.col("s")), s="<p>Abstract: We <b>show</b> it</p> ") == "We show it"


def test_keywords(spark):
    assert one(spark, T.keyword_terms(F.col("s")), s="AI | ai | AI | Psychology |  | x") == ["AI", "ai", "x"]
    assert one(spark, T.cluster_terms(F.col("s")), s="*Deep Learning; ab | graph  nets") == ["deep learning", "graph nets"]
    assert one(spark, T.canonical_keyword(F.col("s")), s="LLMs") == "Large Language Models"


def test_countries_strict_and_not(spark):
    text = "us|US|LE| |USA"
    assert one(spark, T.countries(F.col("s")), s=text) == ["US", "US", "LB"]
    assert one(spark, T.countries(F.col("s"), strict=False), s=text) == ["us", "US", "LB", "USA"]


def test_authors(spark):
    f = lambda s: one(spark, T.plain_authors(F.col("s")), s=s)
    assert f("Silva, A.; {Souza, B.}; ") == ["Silva, A.", "Souza, B."]
    assert f("A One and B Two") == ["A One", "B Two"]
    assert f("A|B") == ["A", "B"]
    assert f(None) == []


def test_literal_list(spark):
    got = one(spark, T.literal_list(F.col("s"), "array<struct<display_name: string, score: double>>"), s="[{'display_name': 'AI', 'score': None}]")
    assert got[0]["display_name"] == "AI" and got[0]["score"] is None


def test_lenient(spark):
    assert [one(spark, T.as_bool(F.col("s")), s=s) for s in ("True", "0", "no", None, "nan", "x")] == [True, False, False, False, False, True]
    assert one(spark, T.as_int(F.col("s")), s="12.0") == 12
    assert one(spark, T.as_int(F.col("s")), s="abc") == 0
    assert one(spark, T.as_int(F.col("s"), None), s="abc") is None
    assert one(spark, T.year_prefix(F.col("s")), s="2024-05-01") == 2024


def test_phrases(spark):
    got = one(spark, T.select_phrases(F.col("a"), 3), a=["large language models", "language models", "peer review", "models large", "open science"])
    assert got == ["large language models", "peer review", "open science"]
    assert one(spark, T.cluster_phrase(F.col("s")), s="internet things") == "Internet of Things"
    assert one(spark, T.cluster_phrase(F.col("s")), s="llm ai use") == "LLM AI Use"
    assert not one(spark, T.phrase_is_valid(F.col("s")), s="model based on data")


def test_context_and_entities(spark):
    got = one(spark, T.context(F.col("s"), "c+", 2), s="abccd")
    assert got["position"] == 3 and got["context"] == "abcc"
    assert one(spark, T.unescape(F.col("s")), s="&amp;lt; &lt;b&gt;") == "&lt; <b>"


def test_axis_lines(spark):
    got = one(spark, T.axis_lines(F.col("s")), s="Axis E: mean=0.758 min=-0.1 [PASS]\nAxis N: mean=1 min=0.5")
    assert [tuple(x) for x in got] == [("E", 0.758, -0.1), ("N", 1.0, 0.5)]
