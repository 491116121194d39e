"""Readers for manually exported records: CSV, TSV, BibTeX, RIS, MEDLINE and PDF names.

Files of tagged records are read by byte ranges that end where a record does, and cut into records by
expressions, so parsing is distributed within files too and stays in the JVM.  Each reader returns
the columns of EXPORT.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EXPORT = ["id", "title", "abstract", "doi", "year", "data_source", "authors", "journal", "cited_by_count", "primary_topic", "keyword_terms", "matched_search_terms", "source_file"]


def _finish(df: DataFrame, source: str) -> DataFrame:
    """Records with a title, with the export columns; the id is the DOI's or the title's slug."""
    blank = F.lit("")
    have = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), blank)) if c in df.columns else blank
    slug = F.when(have("doi") != "", T.slug(have("doi"))).otherwise(F.substring(T.slug(have("title")), 1, 80))
    out = {c: have(c) for c in EXPORT} | {"id": F.concat(F.lit(f"{source}:"), slug), "data_source": F.lit(source), "year": F.col("year").cast("int")}
    return df.where(have("title") != "").select(*(out[c].alias(c) for c in EXPORT))


Paths = str | list[str]


def _file(url: Column) -> Column:
    return F.element_at(F.split(F.url_decode(F.regexp_replace(url, r"%(?![0-9A-Fa-f]{2})", "%25")), "/"), -1)


def _unix(text: Column) -> Column:
    """Line ends as \\n, without a byte-order mark."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def _texts(spark: SparkSession, path: Paths) -> DataFrame:
    """source_file, block (0) and text of each file, as a whole."""
    d = spark.read.text(path, wholetext=True)
    return d.select(_file(F.input_file_name()).alias("source_file"), F.lit(0).cast("long").alias("block"), _unix(F.col("value")).alias("text"))


def _ranges(spark: SparkSession, path: Paths, end: str, again: str, begun: str) -> DataFrame:
    """source_file, block and text of runs of whole records: files are cut at `end`, by as many tasks as their bytes make.

    `block` is the byte at which the task's part of the file starts; within it rows are in order.
    What `end` takes from the next run, `again`, is put back where a run doesn't begin like a file, with `begun`.
    """
    d = spark.read.option("lineSep", end).text(path).select(_file(F.input_file_name()).alias("source_file"), F.col("_metadata.file_block_start").alias("block"), _unix(F.col("value")).alias("text"))
    return d.withColumn("text", F.when(F.col("text").rlike(begun), F.col("text")).otherwise(F.concat(F.lit(again), "text"))) if again else d


def _apart(lines: DataFrame, odd: Column) -> tuple[list[str], list[str]]:
    """Paths of the files of which `odd`, an aggregate, holds and of the others."""
    some = {r[0] for r in lines.groupBy("file").agg(odd.alias("odd")).where("odd").select("file").collect()}  # names of files
    plain = lambda urls: [unquote(u) for u in sorted(urls)]
    return plain(some), plain(set(lines.inputFiles()) - some)


def record_texts(spark: SparkSession, path: Paths, kind: str) -> DataFrame:
    """source_file, block and text of files of tagged records, in parts that hold whole records.

    RIS is cut before what ends a record, BibTeX before an @ that begins a line, MEDLINE before a
    PMID that begins one.  Files in which such a place is no border (the @ begins no entry, no
    blank line goes before the PMID) are read whole, as are compressed ones of any kind.  No cut
    overlaps itself, so ranges that end within one agree on it.
    """
    lines = lambda end: spark.read.option("lineSep", end).text(path).select(F.input_file_name().alias("file"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"))
    if kind == "ris":
        return _ranges(spark, path, "\nER  -", "ER  -", r"^\s*[A-Z][A-Z0-9] +-")
    if kind == "bibtex":
        whole, cut = _apart(lines("\n"), F.bool_or(F.col("value").rlike("^@[^A-Za-z]")))
        ranges = (cut, "\n@", "@", r"^\s*[^A-Za-z\s]")
    else:
        joined = ~F.col("value").rlike(r"\n[ \t\r]*$")  # no blank line goes before the next PMID, if there is one
        whole, cut = _apart(lines("\nPMID-"), F.count_if(joined) > F.max_by(joined, "place").cast("int"))
        ranges = (cut, "\nPMID-", "PMID-", r"^(?! *\d)")
    parts = [_texts(spark, whole)] * bool(whole) + ([_ranges(spark, *ranges)] if cut else [])
    return reduce(DataFrame.unionByName, parts)


def _decoded(spark: SparkSession, path: str, encodings: Sequence[str]) -> list[tuple[str | list[str], str]]:
    """Paths and their encoding: files with any line that isn't UTF-8 have the last of the encodings."""
    lines = spark.read.text(path)
    other = {r[0] for r in lines.where(~F.is_valid_utf8("value")).select(F.input_file_name()).distinct().collect()} if len(encodings) > 1 else set()
    files = set(lines.inputFiles()) if other else set()
    if not other or other == files:
        return [(path, encodings[-1] if other else encodings[0])]
    plain = lambda urls: [unquote(u) for u in sorted(urls)]
    return [(plain(files - other), encodings[0]), (plain(other), encodings[-1])]


def _columns(spark: SparkSession, path: str, separator: str, encodings: Sequence[str]) -> DataFrame:
    """A table with lower-case headers; each file is read in the encoding that all of its lines have."""
    parts = []
    for paths, encoding in _decoded(spark, path, encodings):
        d = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", separator == ",").option("escape", '"').option("mode", "PERMISSIVE" if separator == "," else "DROPMALFORMED").csv(paths)
        parts.append(d.toDF(*(c.strip().lstrip("\ufeff").lower() for c in d.columns)).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _first(d: DataFrame, *names: str) -> Column:
    return next((F.col(f"`{n}`") for n in names if n in d.columns), F.lit(None).cast("string"))


def scopus_csv(spark: SparkSession, path: str) -> DataFrame:
    d = _columns(spark, path, ",", ("UTF-8", "ISO-8859-1"))
    return _finish(d.select(_first(d, "title").alias("title"), _first(d, "abstract").alias("abstract"), T.norm_doi(_first(d, "doi")).alias("doi"), T.year_prefix(_first(d, "year")).alias("year"), _first(d, "authors").alias("authors"), _first(d, "source title").alias("journal"), _first(d, "cited by").alias("cited_by_count"), _first(d, "author keywords", "index keywords").alias("keyword_terms"), _first(d, "document type").alias("primary_topic"), "source_file"), "scopus_manual")


def pubmed_csv(spark: SparkSession, path: str) -> DataFrame:
    d = _columns(spark, path, ",", ("UTF-8", "ISO-8859-1"))
    return _finish(d.select(_first(d, "title").alias("title"), _first(d, "abstract").alias("abstract"), T.norm_doi(_first(d, "doi")).alias("doi"), T.year_prefix(_first(d, "publication year")).alias("year"), _first(d, "authors").alias("authors"), _first(d, "journal/book").alias("journal"), "source_file"), "pubmed_manual")


def wos_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Two-letter headers; lines that don't fit are dropped."""
    d = _columns(spark, path, "\t", ("UTF-8",))
    return _finish(d.select(_first(d, "ti").alias("title"), _first(d, "ab").alias("abstract"), T.norm_doi(_first(d, "di")).alias("doi"), T.year_prefix(_first(d, "py")).alias("year"), _first(d, "au").alias("authors"), _first(d, "so").alias("journal"), _first(d, "tc").alias("cited_by_count"), _first(d, "de").alias("keyword_terms"), _first(d, "sc").alias("primary_topic"), "source_file"), "wos_manual")


def _field(body: Column, name: str) -> Column:
    """A BibTeX field in braces, with one level of braces inside, or in quotes."""
    braces = F.regexp_extract(body, rf"(?is)\b{name}\s*=\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", 1)
    quotes = F.regexp_extract(body, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.when(braces != "", braces).otherwise(quotes), r"[{}]", ""), r"\s*\n\s*", " "))


def bibtex_records(texts: DataFrame) -> DataFrame:
    """Entries of texts (source_file, text), compact ones included; @string, @preamble and @comment are none."""
    apart = F.regexp_replace("text", r"\}(@[A-Za-z])", "}\n$1")
    entries = texts.select("source_file", F.explode(F.regexp_extract_all(apart, F.lit(r"(?s)(@[A-Za-z]+\s*\{[^,\n]+,.+?)(?=\n@[A-Za-z]|\z)"), F.lit(1))).alias("e"))
    entries = entries.where(~F.lower(F.regexp_extract("e", r"^@([A-Za-z]+)", 1)).isin("string", "preamble", "comment"))
    e = F.col("e")
    either = lambda a, b: F.when(_field(e, a) != "", _field(e, a)).otherwise(_field(e, b))
    doi = T.norm_doi(F.regexp_replace(_field(e, "doi"), r"https?://[^/]*doi[^/]*/", ""))
    return _finish(entries.select(_field(e, "title").alias("title"), _field(e, "abstract").alias("abstract"), doi.alias("doi"), T.year_prefix(_field(e, "year")).alias("year"), _field(e, "author").alias("authors"), either("journal", "booktitle").alias("journal"), either("keywords", "keyword").alias("keyword_terms"), "source_file"), "bibtex_manual")


def _values(record: Column, tag: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(record, F.lit(rf"(?m)^{tag} *- +(.*)$"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def _joined(record: Column, *tags: str) -> Column:
    """The first of the tags that the record has, its lines joined."""
    return F.coalesce(*(F.nullif(F.array_join(_values(record, t), " "), F.lit("")) for t in tags), F.lit(""))


def _listed(record: Column, *tags: str) -> Column:
    return F.coalesce(*(F.nullif(F.array_join(_values(record, t), "; "), F.lit("")) for t in tags), F.lit(""))


def ris_records(texts: DataFrame) -> DataFrame:
    """Records that ER ends; lines indented by two continue the one before."""
    whole = F.regexp_replace("text", r"\n {2,}(?=\S)(?![A-Z][A-Z0-9]{1,3} +- )", " ")
    d = texts.select("source_file", F.explode(F.split(whole, r"(?m)^ER *-.*$")).alias("r"))
    r = F.col("r")
    return _finish(d.select(_joined(r, "TI", "T1").alias("title"), _joined(r, "AB", "N2").alias("abstract"), T.norm_doi(_joined(r, "DO", "M3")).alias("doi"), T.year_anywhere(_joined(r, "PY", "Y1", "DA")).alias("year"), _joined(r, "JO", "JF", "T2").alias("journal"), _listed(r, "AU", "A1").alias("authors"), _listed(r, "KW").alias("keyword_terms"), "source_file"), "ris_manual")


def _medline(texts: DataFrame) -> DataFrame:
    whole = F.regexp_replace("text", r"\n {6,}(?=\S)", " ")
    place = F.struct("source_file", F.col("block") if "block" in texts.columns else F.lit(0).alias("block"), F.monotonically_increasing_id().alias("row"))
    return texts.select("source_file", place.alias("place"), F.posexplode(F.split(whole, r"\n[ \t]*\n+")).alias("part", "r"))


def medline_records(texts: DataFrame) -> DataFrame:
    """Records that a blank line ends; lines indented by six continue; the DOI is the LID or AID marked as one."""
    d = _medline(texts)
    r = F.col("r")
    doi = F.regexp_extract(F.array_join(F.concat(_values(r, "LID"), _values(r, "AID")), "\n"), r"(?i)(10\.\S+)\s*\[doi\]", 1)
    words = F.array_join(F.concat(_values(r, "MH"), _values(r, "OT")), "; ")
    return _finish(d.select(_joined(r, "TI").alias("title"), _joined(r, "AB").alias("abstract"), T.norm_doi(doi).alias("doi"), T.year_anywhere(_joined(r, "DP")).alias("year"), _joined(r, "JT", "TA").alias("journal"), _listed(r, "FAU", "AU").alias("authors"), words.alias("keyword_terms"), "source_file"), "pubmed_manual")


def medline_ids(texts: DataFrame) -> DataFrame:
    """key (normalised title) and pmid, that of the last record of the last file by name for each title."""
    r = F.col("r")
    d = _medline(texts).select(T.plain_title(_joined(r, "TI")).alias("key"), _joined(r, "PMID").alias("pmid"), F.struct("place", "part").alias("_n")).where("key <> '' and pmid <> ''")
    return d.groupBy("key").agg(F.max_by("pmid", "_n").alias("pmid"))


def pdf_names(spark: SparkSession, path: str) -> DataFrame:
    """Title and year of files named Title-with-hyphens_Year_rest.pdf; contents aren't read."""
    name = F.element_at(F.split("path", "/"), -1)
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path")
    d = d.select(F.replace(F.regexp_extract(name, r"^(.+?)_(\d{4})_?", 1), F.lit("-"), F.lit(" ")).alias("title"), F.regexp_extract(name, r"^(.+?)_(\d{4})", 2).try_cast("int").alias("year"), name.alias("source_file"))
    return _finish(d, "scopus_pdf")


def detect(path: str, head: str) -> str | None:
    """The reader for a file, by its extension and first characters."""
    ext, first = path.rpartition(".")[2].lower(), head.lstrip("﻿ \n")[:4000]
    if ext == "bib":
        return "bibtex"
    if ext == "ris" or first.startswith("TY  -"):
        return "ris"
    if ext == "pdf":
        return "pdf"
    if ext == "csv":
        return "scopus" if "source title" in first.lower() else "pubmed"
    if ext in ("txt", "nbib", "tsv"):
        return "medline" if first.startswith("PMID") or "\nTI  -" in first else "wos" if "\t" in first else None
    return None


def heads(spark: SparkSession, path: Paths) -> DataFrame:
    """file (its URL) and head of each file: its first line, and behind it the tag of a MEDLINE title if its first block has one."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_block_start").alias("block")).where("block = 0")
    first = lines.where(F.length(F.trim(F.regexp_replace("value", "^﻿", ""))) > 0).groupBy("file").agg(F.min_by("value", "n").alias("first"), F.max(F.col("value").startswith("TI  -")).alias("title"))
    return first.select("file", F.concat("first", F.when(F.col("title"), "\nTI  -").otherwise("")).alias("head"))


def read(spark: SparkSession, path: Paths, kind: str) -> DataFrame:
    if kind in ("bibtex", "ris", "medline"):
        return {"bibtex": bibtex_records, "ris": ris_records, "medline": medline_records}[kind](record_texts(spark, path, kind))
    return {"scopus": scopus_csv, "pubmed": pubmed_csv, "wos": wos_tsv, "pdf": pdf_names}[kind](spark, path)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Records of all exports below a folder, each file by the reader that its name and head ask for; files that nothing reads are left out.

    The driver sees names and first lines of files, never records.
    """
    plans: dict[str, list[str]] = {}
    for url, head in heads(spark, path).collect():
        if kind := detect(url, head):
            plans.setdefault(kind, []).append(unquote(url))
    pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).inputFiles()
    plans.pop("pdf", None)
    parts = [read(spark, sorted(files), kind) for kind, files in sorted(plans.items())] + ([pdf_names(spark, [unquote(u) for u in sorted(pdfs)])] if pdfs else [])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'year' else 'string'}" for c in EXPORT))
