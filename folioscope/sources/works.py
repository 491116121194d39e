"""Flatteners from landed API records to the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CANONICAL = {
    "id": "string", "doi": "string", "title": "string", "abstract": "string", "publication_year": "int", "type": "string", "journal": "string",
    "authors": "string", "authorships": "string", "countries": "string", "primary_topic": "string", "is_in_doaj": "boolean", "cited_by_count": "bigint",
    "keyword_terms": "string", "topic_terms": "string", "open_access": "string", "data_source": "string", "matched_search_terms": "string", "matched_search_term_count": "int",
}

#: Codes of country names as an abstract index spells them; others count by their first two letters.
COUNTRY_CODES = {
    "United States": "US", "United Kingdom": "GB", "China": "CN",
    "Germany": "DE", "Australia": "AU", "Canada": "CA", "France": "FR",
    "Spain": "ES", "Italy": "IT", "Netherlands": "NL", "Brazil": "BR",
    "India": "IN", "Japan": "JP", "South Korea": "KR", "Portugal": "PT",
    "Turkey": "TR", "Sweden": "SE", "Switzerland": "CH", "Poland": "PL",
    "Norway": "NO", "Ireland": "IE", "New Zealand": "NZ", "Belgium": "BE",
    "Taiwan": "TW", "Malaysia": "MY", "Indonesia": "ID", "Saudi Arabia": "SA",
    "United Arab Emirates": "AE", "Iran": "IR", "Pakistan": "PK",
    "South Africa": "ZA", "Mexico": "MX", "Argentina": "AR", "Colombia": "CO",
    "Chile": "CL", "Egypt": "EG", "Nigeria": "NG",
}
#: Types of an abstract index; others are articles.
ENTRY_TYPES = {"Article": "article", "Article in Press": "article", "Review": "review", "Conference Paper": "article", "Conference Review": "review", "Short Survey": "review"}


def canonical(df: DataFrame, source: str) -> DataFrame:
    """The canonical columns in their order: absent ones as nulls, texts cleaned, numbers lenient, the source named."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    out: list[Column] = []
    for name, kind in CANONICAL.items():
        c = have(name)
        if name in ("title", "abstract"):
            c = T.clean_html(c.cast("string"))
        elif name == "publication_year":
            c = T.as_int(c, None).cast("int")
        elif name == "cited_by_count":
            c = T.as_int(c)
        elif name == "matched_search_term_count":
            c = T.as_int(c).cast("int")
        elif name == "is_in_doaj":
            c = T.as_bool(c)
        elif name == "open_access" and name in df.columns and df.schema[name].dataType.typeName() == "struct":
            c = F.to_json(c)
        elif name == "data_source":
            c = F.coalesce(T.blank_to_null(c.cast("string")), F.lit(source))
        else:
            c = F.trim(F.coalesce(c.cast("string"), F.lit("")))
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def inverted_index(words: Column) -> Column:
    """The map from word to its positions in an array of words; a row's own work, in the time of a sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i - 1)["w"] != x["w"], F.lit(True)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda at: entries(s, at))[0]

    def entries(s: Column, at: Column) -> Column:
        ends = F.slice(F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s))), 1, F.size(at))
        return F.map_from_entries(F.zip_with(at, ends, lambda a, b: F.struct(F.get(s, a)["w"], F.transform(F.slice(s, a + 1, b - a), lambda x: x["p"]))))

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.transform(F.array(placed), runs)[0]  # as a variable, the order is made once


def rebuild_abstract(inverted: Column) -> Column:
    """Text of a map from word to positions; of words at one position, the last by name stays."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = lambda o: F.filter(o, lambda x, i: (i == F.size(o) - 1) | (F.try_element_at(o, i + 2)["p"] != x["p"]))
    keep = F.transform(F.array(F.sort_array(pairs)), last)[0]  # as a variable, the order is made once and not for each word
    return F.array_join(F.transform(keep, lambda x: x["w"]), " ")


WORKS = "id string, doi string, title string, publication_year int, type string, cited_by_count bigint, abstract_inverted_index map<string, array<int>>, authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string, country_code: string>>>>, primary_location struct<source: struct<display_name: string, is_in_doaj: boolean>>, keywords array<struct<display_name: string, score: double>>, topics array<struct<display_name: string>>, open_access struct<is_oa: boolean>"


def works(df: DataFrame) -> DataFrame:
    """Works with nested authorships, locations and an inverted abstract (schema WORKS)."""
    codes = F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["country_code"])))
    names = F.array_distinct(F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x != ""))
    flat = df.select(
        "id", T.norm_doi(F.col("doi")).alias("doi"), "title", rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"), "publication_year", "type", F.col("primary_location.source.display_name").alias("journal"),
        F.array_join(names, "; ").alias("authors"), F.to_json("authorships").alias("authorships"), T.pipe_join(codes).alias("countries"), F.try_element_at("topics", F.lit(1))["display_name"].alias("primary_topic"),
        F.coalesce("primary_location.source.is_in_doaj", F.lit(False)).alias("is_in_doaj"), "cited_by_count", F.array_join(T.display_names(F.col("keywords")), " | ").alias("keyword_terms"), F.array_join(T.display_names(F.col("topics"), 3), " | ").alias("topic_terms"), "open_access",
    )
    return canonical(flat, "openalex")


PAPERS = "paperId string, title string, abstract string, year int, citationCount bigint, publicationTypes array<string>, journal struct<name: string>, venue string, externalIds struct<DOI: string>, authors array<struct<name: string>>, fieldsOfStudy array<string>, s2FieldsOfStudy array<struct<category: string>>, openAccessPdf struct<url: string>"
#: Types of a citation-graph API, of which the first known one counts; without one it is an article.
PAPER_TYPES = {"JournalArticle": "article", "Article": "article", "Review": "review", "Conference": "article"}


def graph_papers(df: DataFrame) -> DataFrame:
    """Papers of a citation-graph API (schema PAPERS): the first mapped type, journal or venue, three categories."""
    kinds = F.filter(F.transform("publicationTypes", lambda x: T.lookup(x, PAPER_TYPES)), lambda x: x.isNotNull())
    fields = F.slice(F.array_distinct(F.filter(F.transform("s2FieldsOfStudy", lambda x: x["category"]), lambda x: x != "")), 1, 3)
    words = F.filter("fieldsOfStudy", lambda x: x != "")
    flat = df.select(
        F.concat(F.lit("s2:"), "paperId").alias("id"), T.bare_doi(F.col("externalIds.DOI")).alias("doi"), "title", "abstract", F.col("year").alias("publication_year"), F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("article")).alias("type"),
        F.coalesce(T.blank_to_null(F.col("journal.name")), F.col("venue")).alias("journal"), F.array_join(F.transform("authors", lambda a: a["name"]), "; ").alias("authors"), F.try_element_at("s2FieldsOfStudy", F.lit(1))["category"].alias("primary_topic"), F.col("citationCount").alias("cited_by_count"),
        F.array_join(words, " | ").alias("keyword_terms"), F.array_join(fields, " | ").alias("topic_terms"), F.to_json(F.struct(F.col("openAccessPdf").isNotNull().alias("is_oa"))).alias("open_access"),
    )
    return canonical(flat, "semantic_scholar")


ARTICLES = "id string, source string, doi string, title string, abstractText string, pubYear string, pubType string, journalTitle string, authorString string, citedByCount string, keywordList string, isOpenAccess string"


def articles(df: DataFrame) -> DataFrame:
    """Articles of a life-science index (schema ARTICLES); keywordList is JSON of a string, a list or an object with a list."""
    raw = F.coalesce(F.from_json("keywordList", "array<string>"), F.from_json("keywordList", "keyword array<string>")["keyword"], F.array(F.coalesce(F.from_json("keywordList", "keyword string")["keyword"], F.regexp_replace("keywordList", '^"|"$', ""))))
    words = F.slice(F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), 1, 8)
    doi = T.norm_doi(F.col("doi"))
    number = F.trim(F.coalesce("id", F.lit("")))
    uid = F.when(doi != "", F.concat(F.lit("europepmc:doi:"), doi)).when(number != "", F.concat_ws(":", F.lit("europepmc"), F.lower(F.coalesce(F.nullif("source", F.lit("")), F.lit("epmc"))), number)).otherwise(F.concat(F.lit("europepmc:title:"), F.left(F.trim(F.lower(F.coalesce("title", F.lit("")))), F.lit(80))))
    flat = df.select(
        uid.alias("id"), doi.alias("doi"), "title", F.col("abstractText").alias("abstract"), F.col("pubYear").alias("publication_year"), F.when(F.lower("pubType").contains("review"), "review").otherwise("article").alias("type"), F.col("journalTitle").alias("journal"),
        F.col("authorString").alias("authors"), F.col("citedByCount").alias("cited_by_count"), F.array_join(words, " | ").alias("keyword_terms"), F.to_json(F.struct((F.upper(F.coalesce("isOpenAccess", F.lit("N"))) == "Y").alias("is_oa"))).alias("open_access"),
    )
    return canonical(flat, "europe_pmc")


ENTRIES = "eid string, doi string, title string, description string, coverDate string, subtypeDescription string, publicationName string, creator string, citedby_count string, authkeywords string, affiliation array<struct<affiliation_country: string>>"


def entries(df: DataFrame) -> DataFrame:
    """Entries of an abstract index (schema ENTRIES): its id, else DOI, else title; country names as codes."""
    code = lambda x: F.coalesce(T.lookup(x, COUNTRY_CODES), F.upper(F.left(x, F.lit(2))))
    names = F.filter(F.transform("affiliation", lambda a: a["affiliation_country"]), lambda x: x.isNotNull() & (x != ""))
    words = F.filter(F.transform(F.split(F.regexp_replace("authkeywords", r" \| |; ", "|"), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    doi = T.norm_doi(F.col("doi"))
    uid = F.when(F.coalesce("eid", F.lit("")) != "", F.concat(F.lit("scopus:"), "eid")).when(doi != "", F.concat(F.lit("scopus:doi:"), doi)).otherwise(F.concat(F.lit("scopus:title:"), F.trim(F.lower(F.left(F.coalesce("title", F.lit("")), F.lit(60))))))
    flat = df.select(
        uid.alias("id"), doi.alias("doi"), "title", F.col("description").alias("abstract"), T.year_prefix(F.col("coverDate")).alias("publication_year"), F.coalesce(T.lookup(F.col("subtypeDescription"), ENTRY_TYPES), F.lit("article")).alias("type"),
        F.col("publicationName").alias("journal"), F.col("creator").alias("authors"), T.pipe_join(F.transform(names, code)).alias("countries"), F.col("citedby_count").alias("cited_by_count"), F.array_join(F.slice(words, 1, 8), " | ").alias("keyword_terms"),
    )
    return canonical(flat, "scopus")


def merge_pages(pages: DataFrame, key: str, term: str, order: str) -> DataFrame:
    """Records found by several searches once, as last seen, with all their terms."""
    fields = [c for c in pages.columns if c not in (key, term, order)]
    g = pages.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r"), F.array_sort(F.collect_set(term)).alias("_t"))
    return g.select(key, "r.*", F.array_join("_t", "|").alias("matched_search_terms"), F.size("_t").alias("matched_search_term_count"))
