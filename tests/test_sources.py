import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from folioscope import __main__ as cli
from folioscope.plans import stages
from folioscope.sources import cache, exchange, exports, paging, works
from folioscope.streaming import events


def texts(spark, text):
    return spark.createDataFrame([("f", text)], "source_file string, text string")


def test_bibtex(spark):
    text = '@article{a1,\n title = {A {Nested} title},\n doi = {https://doi.proxy.org/10.1/X}, year = {2021}, author = "One, A and\n Two, B"}@ARTICLE{b2,\n title={Second}, booktitle={Proc}, keywords={x; y}}\n@comment{no, title={Not}}\n'
    a, b = exports.bibtex_records(texts(spark, text)).orderBy("title").collect()
    assert (a["title"], a["doi"], a["year"], a["authors"]) == ("A Nested title", "10.1/x", 2021, "One, A and Two, B")
    assert (b["title"], b["journal"], b["keyword_terms"], b["data_source"]) == ("Second", "Proc", "x; y", "bibtex_manual")


def test_ris(spark):
    text = "TY  - JOUR\nT1  - First title\n  goes on\nN2  - Text\nM3  - doi:10.1/A\nY1  - 2020/05\nAU  - One, A\nAU  - Two, B\nKW  - k1\nER  - \nTY  - JOUR\nTI  - Second\nDA  - c2019\nER  - \nTY  - JOUR\nAB  - no title\n"
    a, b = exports.ris_records(texts(spark, text)).orderBy("title").collect()
    assert (a["title"], a["abstract"], a["doi"], a["year"], a["authors"], a["keyword_terms"]) == ("First title goes on", "Text", "10.1/a", 2020, "One, A; Two, B", "k1")
    assert (b["title"], b["year"]) == ("Second", 2019)


def test_medline(spark):
    text = "PMID- 11\nTI  - A title\n      that goes on\nLID - S1 [pii]\nAID - 10.1/Z [doi]\nDP  - 2022 May\nTA  - J X\nFAU - One, Ann\nMH  - m1\nOT  - o1\n\nPMID- 12\nTI  - Other\n"
    a, b = exports.medline_records(texts(spark, text)).orderBy("title").collect()
    assert (a["title"], a["doi"], a["year"], a["journal"], a["authors"], a["keyword_terms"]) == ("A title that goes on", "10.1/z", 2022, "J X", "One, Ann", "m1; o1")
    assert b["title"] == "Other"
    ids = {r["key"]: r["pmid"] for r in exports.medline_ids(texts(spark, text)).collect()}
    assert ids == {"a title that goes on": "11", "other": "12"}


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("Title,Abstract,DOI,Year,Source title,Cited by,Authors\nUm título,\"a\nb\",10.1/Q,2020,Rev,3,A; B\n,,,,,,\n".encode("latin-1"))
    r = exports.read(spark, str(tmp_path / "s.csv"), "scopus").collect()
    assert [(x["title"], x["doi"], x["year"], x["cited_by_count"]) for x in r] == [("Um título", "10.1/q", 2020, "3")]
    (tmp_path / "w.txt").write_text("TI\tAB\tDI\tPY\tSO\tTC\tAU\tDE\tSC\nT1\ta\t10.2/w\t2021\tJ\t4\tX\tk\tc\n")
    assert exports.read(spark, str(tmp_path / "w.txt"), "wos").first()["doi"] == "10.2/w"
    (tmp_path / "A-Great-Paper_2023_x.pdf").write_bytes(b"%PDF")
    p = exports.read(spark, str(tmp_path), "pdf").first()
    assert (p["title"], p["year"]) == ("A Great Paper", 2023)
    assert [exports.detect(f, h) for f, h in (("a.bib", ""), ("a.ris", ""), ("a.csv", "Source title"), ("a.csv", "PMID"), ("a.txt", "PMID- 1"), ("a.txt", "TI\tAB"), ("a.xyz", ""))] == ["bibtex", "ris", "scopus", "pubmed", "medline", "wos", None]


def test_abstract_from_positions(spark):
    d = spark.createDataFrame([(json.dumps(x),) for x in ({"a": [1, 3], "b": [0], "c": [2]}, {"x": [0], "y": [0]}, {})], "s string").select(F.from_json("s", "map<string, array<int>>").alias("m"))
    assert [r[0] for r in d.select(works.rebuild_abstract(F.col("m"))).collect()] == ["b a c a", "y", ""]


def landed(spark, schema, record):
    return spark.createDataFrame([(json.dumps(record),)], "s string").select(F.from_json("s", schema).alias("r")).select("r.*")


def test_flatteners(spark):
    work = {"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2021, "cited_by_count": 3, "authorships": [{"author": {"display_name": "A"}, "institutions": [{"country_code": "BR"}, {"country_code": "US"}]}, {"author": {"display_name": "B"}, "institutions": [{"country_code": "BR"}]}], "primary_location": {"source": {"display_name": "J", "is_in_doaj": True}}}
    r = works.works(landed(spark, works.WORKS, work)).first()
    assert (r["doi"], r["countries"], r["authors"], r["journal"], r["is_in_doaj"], r["data_source"]) == ("10.1/a", "BR|US", "A; B", "J", True, "openalex")
    assert list(r.asDict()) == list(works.CANONICAL)
    p = works.graph_papers(landed(spark, works.PAPERS, {"paperId": "x", "title": "T", "publicationTypes": ["Odd", "Review"], "venue": "V", "s2FieldsOfStudy": [{"category": "CS"}, {"category": "CS"}, {"category": "Med"}]})).first()
    assert (p["id"], p["type"], p["journal"], p["topic_terms"]) == ("s2:x", "review", "V", "CS | Med")
    a = works.articles(landed(spark, works.ARTICLES, {"id": "7", "source": "MED", "title": "T", "pubType": "Review; x", "keywordList": '{"keyword": ["a", "b", "a"]}'})).first()
    assert (a["id"], a["type"], a["keyword_terms"], a["cited_by_count"]) == ("europepmc:med:7", "review", "a | b", 0)
    a = works.articles(landed(spark, works.ARTICLES, {"doi": "https://doi.org/10.1/Q", "title": "T", "keywordList": "one; two"})).first()
    assert (a["id"], a["doi"], a["keyword_terms"]) == ("europepmc:doi:10.1/q", "10.1/q", "one; two")
    e = works.entries(landed(spark, works.ENTRIES, {"title": "T", "coverDate": "2020-03-01", "affiliation": [{"affiliation_country": "South Korea"}, {"affiliation_country": "Norway"}], "authkeywords": "x; y | z"})).first()
    assert (e["id"], e["publication_year"], e["countries"], e["keyword_terms"]) == ("scopus:title:t", 2020, "KR|NO", "x | y | z")
    kinds = {k: works.entries(landed(spark, works.ENTRIES, {"eid": "2-s2", "title": "T", "subtypeDescription": k})).first() for k in ("Short Survey", "Conference Review", "Conference Paper", "Letter")}
    assert [r["type"] for r in kinds.values()] == ["review", "review", "article", "article"] and kinds["Letter"]["id"] == "scopus:2-s2"
    p = works.graph_papers(landed(spark, works.PAPERS, {"paperId": "y", "publicationTypes": ["MetaAnalysis"], "fieldsOfStudy": ["CS", "Med"], "openAccessPdf": {"url": "u"}})).first()
    assert (p["type"], p["keyword_terms"], p["open_access"]) == ("article", "CS | Med", '{"is_oa":true}')
    w = works.works(landed(spark, works.WORKS, {"id": "W2", "topics": [{"display_name": x} for x in "abcd"]})).first()
    assert (w["primary_topic"], w["topic_terms"]) == ("a", "a | b | c")


@pytest.mark.parametrize(("name", "code"), [("United States", "US"), ("United Kingdom", "GB"), ("China", "CN"), ("Germany", "DE"), ("Australia", "AU"), ("Canada", "CA"), ("France", "FR"), ("Spain", "ES"), ("Italy", "IT"), ("Netherlands", "NL"), ("Brazil", "BR"), ("India", "IN"), ("Japan", "JP"), ("South Korea", "KR"), ("Portugal", "PT"), ("Turkey", "TR"), ("Sweden", "SE"), ("Switzerland", "CH"), ("Poland", "PL"), ("Norway", "NO"), ("Ireland", "IE"), ("New Zealand", "NZ"), ("Belgium", "BE"), ("Taiwan", "TW"), ("Malaysia", "MY"), ("Indonesia", "ID"), ("Saudi Arabia", "SA"), ("United Arab Emirates", "AE"), ("Iran", "IR"), ("Pakistan", "PK"), ("South Africa", "ZA"), ("Mexico", "MX"), ("Argentina", "AR"), ("Colombia", "CO"), ("Chile", "CL"), ("Egypt", "EG"), ("Nigeria", "NG"), ("Austria", "AU"), ("Peru", "PE")])
def test_country_codes(spark, name, code):
    e = works.entries(landed(spark, works.ENTRIES, {"title": "T", "affiliation": [{"affiliation_country": name}, {"affiliation_country": name}, {}]}))
    assert e.first()["countries"] == code


def test_cache_and_lookup(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "a")], "id int, data_source string")

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "s", {"q": 1}, make).count() == 1
    assert len(calls) == 1
    path = f"{tmp_path}/s/{cache.cache_key({'q': 1})}"
    assert cache.newest(spark, [path, f"{tmp_path}/none"], {"id"}) == path
    assert cache.seed(spark, [path], "a").count() == 1
    known = spark.createDataFrame([("k1", 5)], "key string, n long")
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("",)], "doi string")
    got = {r["key"]: r["n"] for r in cache.look_up(keys, "doi", known, lambda ks: {k: 9 for k in ks if k == "k2"}).collect()}
    assert got == {"k1": 5, "k2": 9, "k3": 0}


def test_backfill(spark):
    r = spark.createDataFrame([(1, "d1", ""), (2, "d2", None), (3, "d3", ""), (4, "", "")], "id int, doi string, abstract string")
    first, second = spark.createDataFrame([("d1", "one")], "doi string, abstract string"), spark.createDataFrame([("d2", "two"), ("d3", "three")], "doi string, abstract string")
    assert {x["id"]: x["abstract"] for x in cache.backfill(r, first, second, 2).collect()} == {1: "one", 2: "two", 3: "", 4: ""}


def fetch(term, cursor):
    page = cursor or 0
    return [{"term": term, "page": page}], page + 1 if page < 2 else None


def busy(term, cursor):
    raise paging.Busy("status 429")


def nothing(term, cursor):
    return [], None


def search(spark, fetcher, **options):
    paging.register(spark)
    reader = spark.read.format("paged_search").option("terms", '["a", "b"]').option("fetcher", f"tests.test_sources:{fetcher}")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_paged_source(spark):
    d = search(spark, "fetch")
    assert d.count() == 6 and search(spark, "fetch", most=2).count() == 4
    m = works.merge_pages(d.select(F.get_json_object("record", "$.page").alias("id"), "term", "position", "record"), "id", "term", "position")
    assert {r["matched_search_terms"] for r in m.collect()} == {"a|b"}
    assert search(spark, "nothing").count() == 0
    with pytest.raises(Exception, match="stayed busy"):
        search(spark, "busy", pauses="0,0").count()
    with pytest.raises(Exception, match="nothing found for the first term"):
        search(spark, "nothing", first_must_find="true").count()


def all_pages(fetch):
    out, cursor = [], None
    while True:
        found, cursor = fetch("q", cursor)
        out += found
        if cursor is None:
            return out


def test_cursor_pages():
    asked = []

    def get(p):
        asked.append((p["cursor"], p["per-page"], p["search"], p["filter"], p["select"]))
        return 200, {"results": [{"n": len(asked)}] if len(asked) < 3 else [], "meta": {"next_cursor": f"c{len(asked)}"}}

    assert all_pages(paging.cursor_pages(get, "id", "year:2021")) == [{"n": 1}, {"n": 2}]
    assert asked == [(c, 200, "q", "year:2021", "id") for c in ("*", "c1", "c2")]
    with pytest.raises(paging.Busy):
        paging.cursor_pages(lambda p: (429, {}), "id")("q", None)
    with pytest.raises(paging.Refused):
        paging.cursor_pages(lambda p: (404, {}), "id")("q", None)


def test_offset_pages():
    def service(n, asked):
        def get(p):
            asked.append(p["offset"])
            assert (p["limit"], p["year"]) == (100, "2020-2026")
            return 200, {"data": [{"n": i} for i in range(p["offset"], min(n, p["offset"] + 100))]}

        return get

    for n, offsets in ((0, [0]), (99, [0]), (100, [0, 100]), (250, [0, 100, 200]), (900, [0, 100, 200, 300, 400])):
        asked = []
        assert len(all_pages(paging.offset_pages(service(n, asked), "title", (2020, 2026), most=500))) == min(n, 500)
        assert asked == offsets
    assert len(all_pages(paging.offset_pages(service(900, []), "title", (2020, 2026)))) == 900


def test_numbered_pages():
    def service(n, asked):
        def get(p):
            asked.append(p["page"])
            found = [{"n": i} for i in range((p["page"] - 1) * 100, min(n, p["page"] * 100))]
            return 200, {"hitCount": str(n), "resultList": {"result": found[0] if len(found) == 1 else found}}

        return get

    for n, pages in ((0, [1]), (1, [1]), (100, [1]), (101, [1, 2]), (140, [1, 2]), (900, [1, 2])):
        asked = []
        assert len(all_pages(paging.numbered_pages(service(n, asked), most=150))) == min(n, 150)
        assert asked == pages
    assert len(all_pages(paging.numbered_pages(service(901, [])))) == 901


def test_sized_pages():
    def service(n, limit, asked):
        def get(p):
            asked.append((p["start"], p["count"]))
            if p["count"] > limit:
                return 400, {"service-error": {"status": {"statusText": paging.TOO_LARGE + "."}}}
            return 200, {"search-results": {"entry": [{"n": i} for i in range(p["start"], min(n, p["start"] + p["count"]))], "opensearch:totalResults": str(n)}}

        return get

    asked = []
    assert len(all_pages(paging.sized_pages(service(120, 200, asked), "eid"))) == 120 and asked == [(0, 200)]
    asked = []
    assert len(all_pages(paging.sized_pages(service(60, 25, asked), "eid"))) == 60
    assert asked == [(0, 200), (0, 25), (25, 25), (50, 25)]
    asked = []
    assert len(all_pages(paging.sized_pages(service(900, 25, asked), "eid", most=150))) == 150
    assert len(all_pages(paging.sized_pages(service(900, 25, []), "eid"))) == 900
    for status, error in ((400, paging.Refused), (401, paging.Refused), (403, paging.Refused), (429, paging.Refused), (503, paging.Busy)):
        with pytest.raises(error):
            paging.sized_pages(lambda p, s=status: (s, {}), "eid")("q", None)
    with pytest.raises(paging.Refused, match="no entitlement"):
        paging.sized_pages(lambda p: (200, {"search-results": {"entry": [{"error": "no entitlement"}]}}), "eid")("q", None)


def test_lookups_of_works_and_articles(spark):
    def by_doi(p):
        return 200, {"results": [{"doi": "https://doi.org/10.1/A", "cited_by_count": 4, "authorships": [{"institutions": [{"country_code": "US"}, {"country_code": "BR"}]}, {"institutions": None}]}]}

    known = spark.createDataFrame([("10.1/z", 7, "DE")], "key string, cited_by_count long, countries string")
    keys = spark.createDataFrame([("10.1/a",), ("10.1/b",), ("10.1/z",), ("",)], "doi string")
    got = {r["key"]: (r["cited_by_count"], r["countries"]) for r in cache.look_up(keys, "doi", known, cache.works_by_doi(by_doi)).collect()}
    assert got == {"10.1/a": (4, "BR|US"), "10.1/b": (0, ""), "10.1/z": (7, "DE")}
    asked = []
    fetch = cache.citations_by_pmid(lambda p: asked.append(p) or (200, {"resultList": {"result": {"pmid": "11", "citedByCount": "3"}}}))
    assert fetch(["11", "12"]) == {"11": 3}
    assert asked[0]["query"] == "(EXT_ID:11 OR EXT_ID:12) AND SRC:MED" and asked[0]["pageSize"] == 2
    with pytest.raises(RuntimeError, match="status 500"):
        cache.works_by_doi(lambda p: (500, {}))(["x"])


def test_stages(spark):
    rows = [("p1", "10.1/a", "AI in scientific writing", 2021, "A; B", "J one", 4, "ai|x", "BR|US", 1), ("p2", "10.1/a", "Copy", 2021, "A", "J one", 1, "x", "BR", 2), ("p3", None, "Old", 2010, "C", "J", 1, "y", "US", 3), ("p4", None, "Retracted: z", 2022, "C", "J", 1, "y", "US", 4)]
    corpus = spark.createDataFrame(rows, "id string, doi string, title string, publication_year int, authors string, journal string, cited_by_count bigint, keyword_terms string, countries string, ingest_order int").withColumn("abstract", F.lit("x" * 80)).withColumn("is_in_doaj", F.lit(True))
    got = stages.run(spark, {"corpus": corpus}, ["clean", "indicators", "screening"])
    assert [r["id"] for r in got["corpus_clean"].collect()] == ["p1"]
    assert {r["author"] for r in got["top_authors"].collect()} == {"A", "B"}
    assert got["corpus_paper"].count() == 1
    assert stages.resolve(start="indicators", exclude=["embed", "axes", "screening"]) == ["indicators", "analyses", "statistics", "validation", "summary"]


def test_stream(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.limit(300).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = events.append_new(stream().dropDuplicates(["event_type"]), f"{tmp_path}/out", "event_type", f"{tmp_path}/c{_}")
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == source.limit(300).select("event_type").distinct().count()
    table = spark.read.parquet(f"{tmp_path}/out")
    assert table.select("batch").distinct().count() == 1  # the second run found every key known
    source.limit(400).exceptAll(source.limit(300)).withColumn("event_type", F.lit("new kind")).select(*source.columns).write.mode("append").parquet(f"{tmp_path}/in")
    events.append_new(stream().dropDuplicates(["event_type"]), f"{tmp_path}/out", "event_type", f"{tmp_path}/c0").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == table.count() + 1
    source.limit(300).write.mode("overwrite").parquet(f"{tmp_path}/in")
    q = events.tumbling(stream(), "1 hour").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == 300
    assert events.sessions(source, "1 hour").agg(F.sum("n")).first()[0] == source.count()
    assert events.sliding(source, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 2 * source.count()
    assert events.first_seen(source, "user_id").count() == source.select("user_id").distinct().count()


def test_fetch_embed_axes(spark):
    good = "AI supports research integrity and peer review automation in journals. " * 3
    rows = [(i, f"w{i}", f"10.1/{i}", f"AI and research integrity {i}", good, 2021, 5, "openalex") for i in range(6)]
    rows += [(10, "m", "", "Handpicked", "x" * 60, 2021, 0, "ris_manual"), (11, "n", "", "Nothing", "", 2021, 0, "openalex"), (12, "o", "", "Tourism and AI", good, 2021, 0, "openalex"), (13, "p", "", "Plain", "y" * 60, 2021, 0, "openalex")]
    src = spark.createDataFrame(rows, "ingest_order int, id string, doi string, title string, abstract string, publication_year int, cited_by_count bigint, data_source string")
    src = src.join(works.canonical(src, "x").select("id", *(c for c in works.CANONICAL if c not in src.columns)), "id")
    out = stages.fetch({"sources": src})
    reasons = {r["id"]: r["fetch_exclusion_reason"] for r in out["fetch_exclusions"].collect()}
    assert reasons == {"n": "no_abstract", "o": "offtopic_title", "p": "weak_domain_alignment"}
    assert {r["id"] for r in out["corpus"].collect()} == {f"w{i}" for i in range(6)} | {"m"}
    vectors = spark.createDataFrame([(f"w{i}", [float(i % 2), 1.0, float(i)]) for i in range(6)], "id string, vector array<double>")
    poles = spark.createDataFrame([("e", "high", "a", [1.0, 0.0, 0.0]), ("e", "low", "b", [0.0, 1.0, 0.0])], "axis string, pole string, name string, vector array<double>")
    got = stages.run(spark, {"corpus": out["corpus"], "embeddings": vectors, "poles": poles}, ["clean", "embed", "axes"])
    scores = got["axis_scores"].collect()
    assert len(scores) == 6 and abs(sum(r["axis_e_z"] for r in scores)) < 1e-9
    assert [r["id"] for r in got["embedding_exclusions"].collect()] == ["m"]


def test_enrich(spark):
    rows = [("a", "https://doi.org/10.1/A", "T a", 0, "", "openalex"), ("b", "10.1/b", "T b", 5, None, "openalex"), ("c", "", "A Title: one", 0, "DE", "pubmed_manual"), ("d", None, "A title one", 0, "nan", "openalex"), ("e", "10.1/e", "T e", 0, "FR", "pubmed_manual")]
    clean = spark.createDataFrame(rows, "id string, doi string, title string, cited_by_count long, countries string, data_source string")
    tables = {
        "corpus_clean": clean, "corpus_clustered": clean.limit(1), "doi_lookups": spark.createDataFrame([("10.1/a", 9, "BR"), ("10.1/b", 7, "US"), ("10.1/e", 0, "IT")], "key string, cited_by_count long, countries string"),
        "pmid_lookups": spark.createDataFrame([("11", 4)], "key string, cited_by_count long"), "pmid_map": spark.createDataFrame([("a title one", "11"), ("t e", "11")], "key string, pmid string"),
    }
    out = stages.enrich(tables)
    assert {r["id"]: (r["cited_by_count"], r["countries"]) for r in out["corpus_clean"].collect()} == {"a": (9, "BR"), "b": (5, "US"), "c": (4, "DE"), "d": (0, ""), "e": (0, "FR")}
    assert out["corpus_clean"].columns == clean.columns and out["corpus_clustered"].first()["cited_by_count"] == 9
    bare = stages.enrich({"corpus_clean": clean})["corpus_clean"]
    assert sorted(r["cited_by_count"] for r in bare.collect()) == [0, 0, 0, 0, 5]


@pytest.fixture
def run_dir(spark, tmp_path):
    words = ["peer review automation", "scholarly writing support", "citation analysis tools"]
    good = "AI supports research integrity and peer review automation in journals. " * 3
    rows = [(i, f"w{i}", f"10.1/{i}", f"AI and research integrity in {words[i % 3]} {i}", f"{good} {words[i % 3]} {i}", 2020 + i % 5, (i * 7) % 23, "openalex", f"J {i % 4}", f"A{i % 5}; B{i % 3}", "BR|US" if i % 2 else "", f"{words[i % 3]}|ethics") for i in range(36)]
    src = spark.createDataFrame(rows, "ingest_order int, id string, doi string, title string, abstract string, publication_year int, cited_by_count bigint, data_source string, journal string, authors string, countries string, keyword_terms string")
    src = src.join(works.canonical(src, "x").select("id", *(c for c in works.CANONICAL if c not in src.columns)), "id")
    src.write.parquet(f"{tmp_path}/input/sources")
    spark.createDataFrame([(f"w{i}", [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2) + i / 90]) for i in range(36)], "id string, vector array<double>").write.parquet(f"{tmp_path}/input/embeddings")
    poles = [("e", "high", "a", [1.0, 0.0, 0.0]), ("e", "low", "b", [0.0, 1.0, 0.0]), ("n", "high", "a", [0.0, 0.0, 1.0]), ("n", "low", "b", [0.0, 1.0, 0.0])]
    spark.createDataFrame(poles, "axis string, pole string, name string, vector array<double>").write.parquet(f"{tmp_path}/input/poles")
    return str(tmp_path)


def test_command_line(spark, run_dir):
    assert cli.main(["--run-dir", run_dir, "--exclude", "screening", "--exclude", "summary"]) == [s for s in stages.STAGES if s not in ("screening", "summary")]
    assert cli.main(["--run-dir", run_dir, "--start-from", "summary"]) == ["summary", "screening"]
    for stage, tables in stages.MAKES.items():
        for table in tables:
            assert cache.exists(spark, f"{run_dir}/{stage}/{table}") or (stage, table) in (("enrich", "corpus_clustered"), ("validation", "validation_metrics")), (stage, table)  # without a second input
    read = lambda stage, table: spark.read.parquet(f"{run_dir}/{stage}/{table}")
    scores = read("analyses", "axis_scores_enriched").toPandas()
    assert len(scores) == 36 and scores.cluster_label.str.len().min() > 3 and scores.cluster_description.str.startswith(stages.FOCUS).all()
    years = read("analyses", "temporal_profile").toPandas().set_index("year")
    by_year = scores.groupby("publication_year").axis_e.agg(["count", "mean"])
    assert years.n.sort_index().tolist() == by_year["count"].tolist() and np.allclose(years.mean_e.sort_index(), by_year["mean"])
    share = read("analyses", "cluster_share_by_year").toPandas()
    assert np.allclose(share.groupby("year").pct.sum(), 100, atol=0.05)
    tests = {r["axis"]: r for r in read("statistics", "axis_tests").collect()}
    assert set(tests) == {"e", "n"}
    ranks = scores[["cited_by_count", "axis_e"]].rank().corr().iloc[0, 1]
    assert tests["e"]["rho_all"] == pytest.approx(ranks) and tests["e"]["mean"] == pytest.approx(scores.axis_e.mean())
    assert read("statistics", "axis_quartiles").groupBy("axis").agg(F.sum("n").alias("n")).toPandas().n.tolist() == [36, 36]
    sample = read("validation", "validation_sample").toPandas()
    assert sample.groupby(["cluster", "third"]).size().max() <= 2 and sample.form_id.is_unique
    report = {k: json.loads(v) for k, v in read("summary", "report_summary").first().asDict().items()}
    assert report["corpus"][0]["n_articles"] == 36 and sum(c["n"] for c in report["clusters"]) == 36 and report["top_paper"][0]["cited_by_count"] == scores.cited_by_count.max()
    with pytest.raises(SystemExit):
        cli.main(["--run-dir", run_dir, "--start-from", "nothing"])
    with pytest.raises(SystemExit):
        cli.main(["--run-dir", run_dir, "fetch", "--start-from", "summary"])


def test_exchange(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    v = exchange.npy(spark, str(tmp_path / "m.npy"))
    d = spark.createDataFrame([(0, "a"), (1, "b|c"), (2, None)], "n int, s string")
    joined = exchange.numbered(d, v, "n")
    assert {r["n"]: r["vector"] for r in joined.collect()}[2] == [4.0, 5.0]
    with pytest.raises(ValueError, match="2 rows but 3 vectors"):
        exchange.numbered(d.where("n < 2"), v, "n")
    assert exchange.markdown(d, "n").first()["text"] == "| n | s |\n|-|-|\n| 0 | a |\n| 1 | b\\|c |\n| 2 |  |"
    assert exchange.markdown(d, "n", most=2).first()["text"].endswith("| 1 | b\\|c |\n\n… and 1 more rows")
    assert json.loads(exchange.summary({"t": d.orderBy("n").limit(1)}).first()["t"]) == [{"n": 0, "s": "a"}]
    exchange.to_csv(joined, f"{tmp_path}/csv", "n")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3


def test_encoding_of_each_file(spark, tmp_path):
    head = "Title,Abstract,DOI,Year,Source title\n"
    late = head + "".join(f"plain {i},a,,2020,Rev\n" for i in range(1500)) + "educação,é,,2021,Rev\n"
    (tmp_path / "late 1.csv").write_bytes(late.encode("latin-1"))
    (tmp_path / "utf 8.csv").write_bytes((head + "señal \ufffd,ü,,2022,Rev\n").encode())
    rows = exports.scopus_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 1502
    assert {(r["title"], r["abstract"]) for r in rows if r["year"] > 2020} == {("educação", "é"), ("señal \ufffd", "ü")}
