"""Queries over landed records of outside services and manual exports, made from the tables.

Each builds records of one source from rows of a table, with gaps, repeats and spellings that the
source is known for, and runs that source's reader over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules
from ..session import shared_folder
from ..sources import cache, exports, keyed, works
from .registry import Tables, query


def landed(rows: DataFrame, schema: str, *fields: Column) -> DataFrame:
    """Records as a service sends them: JSON, read with the reader's schema."""
    return rows.select(F.from_json(F.to_json(F.struct(*fields)), schema).alias("r")).select("r.*")


def nested(array_of: Column, **fields) -> Column:
    return F.transform(array_of, lambda x: F.struct(*(f(x).alias(name) for name, f in fields.items())))


_COUNTRY = "CASE o_custkey % 3 WHEN 0 THEN 'BR' WHEN 1 THEN 'US' ELSE 'PT' END"


@query(f"""SELECT 'W' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '10.1/x' || o_orderkey END AS doi, CAST(year(o_orderdate) AS INTEGER) AS publication_year, 'J ' || o_orderstatus AS journal, 'A' || o_custkey || CASE WHEN o_custkey = o_orderkey THEN '' ELSE '; A' || o_orderkey END AS authors,
    CASE WHEN {_COUNTRY} < 'GB' THEN {_COUNTRY} || '|GB' ELSE 'GB|' || {_COUNTRY} END AS countries, o_orderpriority AS primary_topic, o_orderpriority || ' | b | c' AS topic_terms, 'again to be again' AS abstract, o_orderkey % 2 = 0 AS is_in_doaj, 'openalex' AS data_source FROM orders""")
def works_flattened(t: Tables) -> DataFrame:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    country = F.when(F.col("o_custkey") % 3 == 0, "BR").when(F.col("o_custkey") % 3 == 1, "US").otherwise("PT")
    person = lambda n, *codes: F.struct(F.struct(n.alias("display_name")).alias("author"), F.array(*(F.struct(c.alias("country_code")) for c in codes)).alias("institutions"))
    topics = F.transform(F.array(F.col("o_orderpriority"), F.lit("b"), F.lit("b"), F.lit("c"), F.lit("d")), lambda x: F.struct(x.alias("display_name")))
    d = landed(
        t.orders, works.WORKS, name("W", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("https://doi.org/10.1/X"), F.col("o_orderkey").cast("string"))).alias("doi"), F.lit("t").alias("title"), F.year("o_orderdate").alias("publication_year"),
        F.create_map(F.lit("again"), F.array(F.lit(0), F.lit(3)), F.lit("be"), F.array(F.lit(2)), F.lit("to"), F.array(F.lit(1))).alias("abstract_inverted_index"), F.array(person(name("A", "o_custkey"), country, F.lit("GB")), person(name("A", "o_orderkey"), country)).alias("authorships"),
        F.struct(F.struct(name("J ", "o_orderstatus").alias("display_name"), (F.col("o_orderkey") % 2 == 0).alias("is_in_doaj")).alias("source")).alias("primary_location"), topics.alias("topics"),
    )
    return works.works(d).select("id", "doi", "publication_year", "journal", "authors", "countries", "primary_topic", "topic_terms", "abstract", "is_in_doaj", "data_source")


@query("""SELECT 's2:' || s_suppkey AS id, '10.2/' || s_suppkey AS doi, CASE s_suppkey % 4 WHEN 0 THEN 'review' ELSE 'article' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'J' || s_nationkey ELSE s_name END AS journal, 'N' || s_nationkey AS primary_topic, 'Med | CS' AS keyword_terms, 'N' || s_nationkey || ' | CS' AS topic_terms,
    CASE WHEN s_suppkey % 3 = 0 THEN '{"is_oa":true}' ELSE '{"is_oa":false}' END AS open_access, CAST(s_suppkey % 7 AS BIGINT) AS cited_by_count FROM supplier""")
def papers_flattened(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    kinds = F.when(key % 4 == 0, F.array(F.lit("Odd"), F.lit("Review"))).when(key % 4 == 1, F.array(F.lit("Conference"), F.lit("Review"))).when(key % 4 == 2, F.array(F.lit("MetaAnalysis")))
    topic = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    d = landed(
        t.supplier, works.PAPERS, key.cast("string").alias("paperId"), F.lit("t").alias("title"), kinds.alias("publicationTypes"), F.when(key % 2 == 0, F.struct(F.concat(F.lit("J"), F.col("s_nationkey").cast("string")).alias("name"))).alias("journal"), F.col("s_name").alias("venue"),
        F.struct(F.concat(F.lit("https://doi.org/10.2/"), key.cast("string")).alias("DOI")).alias("externalIds"), F.array(F.lit("Med"), F.lit("CS")).alias("fieldsOfStudy"), nested(F.array(topic, F.lit("CS"), topic), category=lambda x: x).alias("s2FieldsOfStudy"),
        F.when(key % 3 == 0, F.struct(F.lit("u").alias("url"))).alias("openAccessPdf"), F.when(key % 7 != 0, key % 7).alias("citationCount"),
    )
    return works.graph_papers(d).select("id", "doi", "type", "journal", "primary_topic", "keyword_terms", "topic_terms", "open_access", "cited_by_count")


@query("""SELECT CASE s_suppkey % 3 WHEN 0 THEN 'europepmc:doi:10.3/' || s_suppkey WHEN 1 THEN 'europepmc:med:' || s_suppkey ELSE 'europepmc:title:' || lower(s_name) END AS id, CASE WHEN s_suppkey % 3 = 0 THEN '10.3/' || s_suppkey ELSE '' END AS doi, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'review' ELSE 'article' END AS type,
    CASE s_suppkey % 3 WHEN 0 THEN 'a | b' WHEN 1 THEN 'one; two' ELSE 'x | y | z' END AS keyword_terms, CAST(2000 + s_suppkey % 25 AS INTEGER) AS publication_year, CAST(s_suppkey % 5 AS BIGINT) AS cited_by_count FROM supplier""")
def articles_flattened(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    words = F.when(key % 3 == 0, '["a", "b", " a "]').when(key % 3 == 1, "one; two").otherwise('{"keyword": ["x", "y", "x", "z"]}')
    d = landed(
        t.supplier, works.ARTICLES, F.when(key % 3 != 2, key.cast("string")).alias("id"), F.lit("MED").alias("source"), F.when(key % 3 == 0, F.concat(F.lit("doi:10.3/"), key.cast("string"))).alias("doi"), F.col("s_name").alias("title"), F.when(key % 2 == 0, "Systematic Review; x").otherwise("journal article").alias("pubType"),
        words.alias("keywordList"), (2000 + key % 25).cast("string").alias("pubYear"), (key % 5).cast("string").alias("citedByCount"),
    )
    return works.articles(d).select("id", "doi", "title", "type", "keyword_terms", "publication_year", "cited_by_count")


_NAMES = list(works.COUNTRY_CODES)


@query(f"""WITH n AS (SELECT ['{"', '".join(_NAMES)}'] AS names, ['{"', '".join(works.COUNTRY_CODES.values())}'] AS codes), d AS (SELECT s.*, codes[1 + s_suppkey % {len(_NAMES)}] AS a, codes[1 + (s_suppkey * 7) % {len(_NAMES)}] AS b FROM supplier s, n)
    SELECT CASE s_suppkey % 3 WHEN 0 THEN 'scopus:2-s2.' || s_suppkey WHEN 1 THEN 'scopus:doi:10.4/' || s_suppkey ELSE 'scopus:title:' || lower(s_name) END AS id, array_to_string(list_sort(list_distinct([a, b, 'PE'])), '|') AS countries,
    CASE s_suppkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'review' ELSE 'article' END AS type, CAST(1990 + s_suppkey % 30 AS INTEGER) AS publication_year, 'x | y | z' AS keyword_terms FROM d""")
def entries_flattened(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    name = lambda k: F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    d = landed(
        t.supplier, works.ENTRIES, F.when(key % 3 == 0, F.concat(F.lit("2-s2."), key.cast("string"))).alias("eid"), F.when(key % 3 == 1, F.concat(F.lit("10.4/"), key.cast("string"))).alias("doi"), F.col("s_name").alias("title"), nested(F.array(name(key), name(key * 7), F.lit("Peru"), F.lit("")), affiliation_country=lambda x: x).alias("affiliation"),
        F.when(key % 4 == 0, "Short Survey").when(key % 4 == 1, "Conference Review").when(key % 4 == 2, "Article in Press").alias("subtypeDescription"), F.concat((1990 + key % 30).cast("string"), F.lit("-05-01")).alias("coverDate"), F.lit("x; y | z").alias("authkeywords"),
    )
    return works.entries(d).select("id", "countries", "type", "publication_year", "keyword_terms")


def files(rows: DataFrame, text: Column, each: Column) -> DataFrame:
    """Texts of export files, several records each, in the order of their keys."""
    records = rows.groupBy(each.cast("string").alias("source_file")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), text.alias("t")))).alias("r"))
    return records.select("source_file", F.array_join(F.transform("r", lambda x: x["t"]), "").alias("text"))


def _key_year() -> tuple[Column, Column]:
    return F.col("s_suppkey"), (2000 + F.col("s_suppkey") % 25).cast("string")


_LATEST = "l AS (SELECT * FROM client_changes WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1)"


@query(f"WITH {_LATEST} SELECT coalesce(c.client_id, l.client_id) AS client_id, name, coalesce(l.segment, c.segment) AS segment, coalesce(l.city, c.city) AS city, coalesce(l.balance, c.balance) AS balance FROM clients c FULL JOIN l ON c.client_id = l.client_id WHERE l.op IS DISTINCT FROM 'D'")
def clients_patched(t: Tables) -> DataFrame:
    """The table of clients, written by bucket, after a patch of the latest change of each."""
    path = shared_folder(t.spark, "clients")
    keyed.patch(t.clients, path, "client_id", ["updated_at"], buckets=32)
    keyed.patch(t.client_changes.select("client_id", "segment", "city", "balance", "op", "seq", "change_id"), path, "client_id", ["seq", "change_id"], gone=F.col("op") == "D", fill=True, buckets=32)
    return keyed.read(t.spark, path).select("client_id", "name", "segment", "city", "balance")


_RECORD = "s_name AS title, '10.5/' || s_suppkey AS doi, CAST(2000 + s_suppkey % 25 AS INTEGER) AS year"


@query(f"SELECT {_RECORD}, 'One, A and Two, B' AS authors, CASE WHEN s_suppkey % 2 = 0 THEN 'J ' || s_nationkey ELSE 'Proc' END AS journal, 'bibtex_manual' AS data_source FROM supplier")
def bibtex_parsed(t: Tables) -> DataFrame:
    key, year = _key_year()
    place = F.when(key % 2 == 0, F.concat(F.lit("journal = {J "), F.col("s_nationkey").cast("string"), F.lit("}"))).otherwise("booktitle={Proc}")
    entry = F.concat(F.lit("@article{k"), key.cast("string"), F.lit(",\n title = {{"), F.col("s_name"), F.lit("}},\n doi = {https://dx.doi.org/10.5/"), key.cast("string"), F.lit('}, year = "'), year, F.lit('", author = "One, A and\n Two, B", '), place, F.lit("}"))
    d = exports.bibtex_records(files(t.supplier, F.concat(entry, F.lit("@comment{no, title={Not}}\n")), F.col("s_nationkey")))
    return d.select("title", "doi", "year", "authors", "journal", "data_source")


@query(f"SELECT {_RECORD}, 'One, A; Two, B' AS authors, 'k1; k2' AS keyword_terms, 'Text that goes on' AS abstract FROM supplier")
def ris_parsed(t: Tables) -> DataFrame:
    key, year = _key_year()
    tag = F.when(key % 2 == 0, "TI").otherwise("T1")
    record = F.concat(F.lit("TY  - JOUR\n"), tag, F.lit("  - "), F.col("s_name"), F.lit("\nN2  - Text that\n  goes on\nDO  - doi:10.5/"), key.cast("string"), F.lit("\nY1  - "), year, F.lit("/05\nAU  - One, A\nAU  - Two, B\nKW  - k1\nKW  - k2\nER  - \n"))
    return exports.ris_records(files(t.supplier, record, F.col("s_nationkey"))).select("title", "doi", "year", "authors", "keyword_terms", "abstract")


def _medline_files(t: Tables) -> DataFrame:
    key, year = _key_year()
    record = F.concat(F.lit("PMID- "), (7000 + key).cast("string"), F.lit("\nTI  - "), F.col("s_name"), F.lit("\nLID - S1 [pii]\nAID - 10.5/"), key.cast("string"), F.lit(" [doi]\nDP  - "), year, F.lit(" May\nFAU - One, Ann\nMH  - m1\nOT  - o1\n      and more\n\n"))
    return files(t.supplier, record, F.col("s_nationkey"))


@query(f"SELECT {_RECORD}, 'One, Ann' AS authors, 'm1; o1 and more' AS keyword_terms FROM supplier")
def medline_parsed(t: Tables) -> DataFrame:
    return exports.medline_records(_medline_files(t)).select("title", "doi", "year", "authors", "keyword_terms")


@query("SELECT trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS key, CAST(7000 + max(s_suppkey) AS VARCHAR) AS pmid FROM supplier GROUP BY 1")
def medline_title_ids(t: Tables) -> DataFrame:
    return exports.medline_ids(_medline_files(t))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'one ' || lang WHEN 1 THEN 'two ' || lang ELSE text END AS abstract FROM documents")
def abstracts_backfilled(t: Tables) -> DataFrame:
    doi = F.concat(F.lit("10.6/"), F.col("doc_id").cast("string"))
    d = t.documents.select("doc_id", doi.alias("doi"), F.when(F.col("doc_id") % 3 == 2, F.col("text")).alias("abstract"))
    found = lambda k, word: t.documents.where(F.col("doc_id") % 3 == k).select(doi.alias("doi"), F.concat(F.lit(f"{word} "), "lang").alias("abstract"))
    return cache.backfill(d, found(0, "one"), found(1, "two").unionByName(found(0, "late")), 1 << 30, "doc_id").select("doc_id", "abstract")


def _java(pattern: str) -> str:
    """A rule's pattern for DuckDB: without the flags that its own ones stand for, word ends as ASCII has them."""
    return pattern.replace("(?iU)", "").replace("'", "''")


def _labels(column: str, table: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '{_java(p)}', 'i') THEN '{label}' END" for label, p in table.items()) + "], lambda x: x IS NOT NULL), '|')"


#: Titles that the rules speak of, one for each document in turn.
TITLES = [
    "AI writing assistants in academic writing and peer review", "Research integrity policies for generative AI in universities", "ChatGPT for medical education: a clinical trial", "Industrial robots and manufacturing with deep learning",
    "Systematic review automation with large language models", "Plagiarism detection and authorship ethics", "English as a foreign language learning with chatbots", "A history of printing in the north", "Retracted: machine learning for citation analysis", "AI literacy of librarians and scholarly publishing",
]


# An accented letter is part of a word for the rules, but not for RE2's word ends; _ is for both, and in no rule.
@query(f"""WITH d AS (SELECT doc_id, ['{"', '".join(TITLES)}'][1 + CAST(doc_id % {len(TITLES)} AS INTEGER)] || ' ' || regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS title FROM documents)
    SELECT doc_id, {_labels("title", rules.POSITIVE)} AS positive, {_labels("title", rules.AI_SIGNALS)} AS ai, {_labels("title", rules.NEGATIVE)} AS negative, regexp_matches(title, '{_java(rules.OFFTOPIC_TITLE)}', 'i') AS offtopic_title, regexp_matches(title, '{_java(rules.OFFTOPIC_TOPIC)}', 'i') AS offtopic_topic,
        regexp_matches(title, '{_java(rules.RETRACTED)}', 'i') AS retracted, regexp_matches(title, '{_java(rules.LOW_QUALITY)}', 'i') AS low_quality FROM d""")
def rules_matched(t: Tables) -> DataFrame:
    """The rules of the corpus itself, over the whole texts of documents, each behind a title that they speak of."""
    title = F.concat(F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int")), F.lit(" "), "text")
    more = {"offtopic_title": rules.OFFTOPIC_TITLE, "offtopic_topic": rules.OFFTOPIC_TOPIC, "retracted": rules.RETRACTED, "low_quality": rules.LOW_QUALITY}
    opened = T.Opened(rules.POSITIVE, rules.AI_SIGNALS, rules.NEGATIVE, more)
    d = t.documents.select("doc_id", title.alias("title")).withColumn("found", opened.found(F.col("title")))
    named = lambda table: F.array_join(opened.matching_labels(F.col("title"), F.col("found"), table), "|")
    return d.select("doc_id", named(rules.POSITIVE).alias("positive"), named(rules.AI_SIGNALS).alias("ai"), named(rules.NEGATIVE).alias("negative"), *(opened.any_match(F.col("title"), F.col("found"), p).alias(name) for name, p in more.items()))
