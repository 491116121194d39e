"""Records: dedup, joins, text functions, screening and relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import rank as R
from ..operators import rules
from .registry import RECORDS, Tables, query, r6

KEY = "lower(trim(title))"


@query(f"""WITH {RECORDS}, r AS (SELECT id, source, row_number() OVER (PARTITION BY sha256(abstract) ORDER BY id) AS a, {KEY} AS k FROM records),
    s AS (SELECT id, source, k, row_number() OVER (PARTITION BY k ORDER BY id) AS b FROM r WHERE a = 1) SELECT id, source FROM s WHERE b = 1""")
def dedup_keep_first(t: Tables) -> DataFrame:
    d = t.records().select("id", "source", F.sha2("abstract", 256).alias("doi"), T.title_key(F.col("title")).alias("k"))
    return D.dedup_records(d, F.col("doi"), F.col("k"), "id").select("id", "source")


@query(f"WITH {RECORDS}, r AS (SELECT id, row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN length(abstract) >= 150 THEN 0 ELSE 1 END, id) AS k FROM records) SELECT id FROM r WHERE k = 1")
def prefer_abstract(t: Tables) -> DataFrame:
    d = t.records().withColumn("a", F.when(F.length("abstract") >= 150, F.col("abstract")))
    return D.prefer_abstract(d, T.title_key(F.col("title")), F.col("a"), "id").select("id")


HALVES = "a AS (SELECT * FROM records WHERE source IN ('src0', 'src1', 'src2', 'src3')), b AS (SELECT * FROM records WHERE source NOT IN ('src0', 'src1', 'src2', 'src3'))"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.records().select("id", "source", F.md5("abstract").alias("doi"), T.title_key(F.col("title")).alias("k"))
    return D.split(d, F.col("source").isin("src0", "src1", "src2", "src3"))


@query(f"WITH {RECORDS}, {HALVES} SELECT id FROM a WHERE md5(abstract) NOT IN (SELECT md5(abstract) FROM b) AND {KEY} NOT IN (SELECT {KEY} FROM b)")
def anti_join_new_records(t: Tables) -> DataFrame:
    new, pool = halves(t)
    return D.new_records(new, pool, "doi", "k").select("id")


@query(f"WITH {RECORDS}, {HALVES} SELECT id, md5(abstract) IN (SELECT md5(abstract) FROM b) OR {KEY} IN (SELECT {KEY} FROM b) AS in_pool FROM a")
def manual_vs_corpus_dedup(t: Tables) -> DataFrame:
    new, pool = halves(t)
    return D.in_pool(new, pool, "doi", "k").select("id", "in_pool")


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 0 END AS cit, c_mktsegment AS seg FROM customer)
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND coalesce(cit, 0) > 0 THEN cit WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 3 END AS cit,
           CASE WHEN o_orderkey % 5 = 0 THEN coalesce(seg, '') ELSE o_orderstatus END AS seg FROM orders LEFT JOIN p ON o_orderkey = k""")
def lookup_patch(t: Tables) -> DataFrame:
    table = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(0).alias("cit"), F.col("c_mktsegment").alias("seg"))
    d = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("o_orderkey") % 3).alias("cit"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("seg"))
    return D.patch(d, table, "k", ["cit"], ["seg"]).select("id", "cit", "seg")


@query(f"""WITH {RECORDS}, x AS (SELECT id, {KEY} AS k, CASE WHEN id % 2 = 0 THEN source ELSE '' END AS author FROM records),
    a AS (SELECT k, arg_min(author, id) AS v FROM x WHERE author <> '' GROUP BY 1), l AS (SELECT doc_id, 'q' || quality AS v FROM labels)
    SELECT x.id, coalesce(nullif(author, ''), l.v, a.v) AS author FROM x LEFT JOIN l ON x.id = l.doc_id LEFT JOIN a ON x.k = a.k""")
def author_recovery_coalesce(t: Tables) -> DataFrame:
    x = t.records().select("id", T.title_key(F.col("title")).alias("k"), F.when(F.col("id") % 2 == 0, F.col("source")).otherwise("").alias("author"))
    known = D.keep_first(x.where("author <> ''"), F.col("k"), F.col("id")).select("k", "author")
    labels = t.labels.select("doc_id", F.concat(F.lit("q"), "quality").alias("v"))
    return D.recover(x, "author", ("id", labels), ("k", known)).select("id", "author")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.source <> ''")
def scores_left_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left").where("source <> ''")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment, coalesce(CAST(year(o_orderdate) AS INTEGER), 0) AS year FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def form_left_join(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return d.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), F.coalesce(F.year("o_orderdate"), F.lit(0)).alias("year"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_miss_anti_join(t: Tables) -> DataFrame:
    return D.misses(t.documents, t.labels, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang IN ('en', 'fr')")
def focal_semi_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").where(F.col("lang").isin("en", "fr")).join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query(f"""WITH {RECORDS}, k AS (SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS k, min(id) AS pmid FROM records WHERE lang = 'en' GROUP BY 1)
    SELECT r.id, k.pmid FROM records r LEFT JOIN k ON trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) = k.k WHERE lang = 'en'""")
def title_key_lookup(t: Tables) -> DataFrame:
    d = t.records().where("lang = 'en'").select("id", T.norm_title(F.col("title")).alias("k"))
    return d.join(d.groupBy("k").agg(F.min("id").alias("pmid")), "k", "left").select("id", "pmid")


@query("""SELECT doc_id, CASE WHEN source = 'src0' AND n_chars >= 150 THEN '' WHEN regexp_matches(text, '(?i)(^| )(that|les)( |$)') AND lang <> 'en' THEN 'offtopic_title' WHEN n_chars < 150 THEN 'no_abstract' WHEN lang <> 'en' THEN 'weak_domain_alignment' WHEN n_chars NOT BETWEEN 10 AND 5000 THEN 'out_of_range' ELSE '' END AS reason
    FROM documents""")
def exclusion_cascade(t: Tables) -> DataFrame:
    off = T.any_match(F.col("text"), r"(?i)(^| )(that|les)( |$)") & (F.col("lang") != "en")
    manual = F.col("source") == "src0"
    reason = rules.exclusion_reason(manual, F.col("n_chars") >= 150, off, F.col("lang") == "en")
    outside = (reason == "") & ~manual & ~F.col("n_chars").between(10, 5000)
    return t.documents.select("doc_id", F.when(outside, "out_of_range").otherwise(reason).alias("reason"))


@query("""SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 0) AS number, CAST(coalesce(floor(TRY_CAST(substr(props, 6, 3) AS DOUBLE)), 0) AS BIGINT) AS lenient,
    round(least(greatest(value, 0), 50) / 50, 6) AS capped, lower(trim(event_type)) NOT IN ('', '0', 'false', 'no', 'off', 'nan', 'none') AS flag FROM events""")
def lenient_cast(t: Tables) -> DataFrame:
    number = T.as_number(F.regexp_extract("props", "([0-9]+)", 1))
    return t.events.select("event_id", F.coalesce(number, F.lit(0.0)).alias("number"), T.as_int(F.substring("props", 6, 3)).alias("lenient"), r6(T.capped(F.col("value"), 50)).alias("capped"), T.as_bool(F.col("event_type")).alias("flag"))


@query("""SELECT doc_id AS id, coalesce(nullif(trim(source), ''), 'unknown') AS data_source, CAST(coalesce(quality, 0) AS BIGINT) AS cited_by_count, CAST(NULL AS VARCHAR) AS doi, lang || '|' || source AS matched, CAST(2 AS INTEGER) AS matched_count
    FROM documents LEFT JOIN labels USING (doc_id)""")
def canonical_source_frame(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), "lang", "source").join(t.labels.select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    d = D.with_optional(d, {"doi": "string"})
    matched = T.pipe_join(F.array("lang", "source"))
    return D.require(d, "id", "source").select("id", T.clean_source(F.col("source")).alias("data_source"), T.as_int(F.col("quality")).alias("cited_by_count"), "doi", matched.alias("matched"), T.count_labels(matched).alias("matched_count"))


@query("SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS terms FROM orders GROUP BY 1")
def union_sources(t: Tables) -> DataFrame:
    parts = [t.orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    d = D.union_sources(*parts).select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderkey", F.col("o_orderpriority").alias("terms"))
    return D.merge_by_key(d, "id", ["status"], "o_orderkey", "terms").select("id", "status", F.array_join("terms", "|").alias("terms"))


@query("SELECT doc_id, CASE WHEN n_chars >= 150 AND NOT regexp_matches(text, '(?i)(https?://|download link)') THEN 'kept' ELSE 'excluded' END AS part, CASE WHEN n_chars >= 150 AND NOT regexp_matches(text, '(?i)(https?://|download link)') THEN row_number() OVER (PARTITION BY n_chars >= 150 AND NOT regexp_matches(text, '(?i)(https?://|download link)'), source ORDER BY n_chars DESC, doc_id) END AS rank FROM documents")
def kept_excluded_partition(t: Tables) -> DataFrame:
    good = (F.col("n_chars") >= 150) & ~T.any_match(F.col("text"), r"(?i)(https?://|download link)")
    kept, excluded = D.split(t.documents, good)
    kept = kept.select("doc_id", F.lit("kept").alias("part"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
    return kept.unionByName(excluded.select("doc_id", F.lit("excluded").alias("part"), F.lit(None).cast("long").alias("rank")))


@query("""SELECT 'union' AS op, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5)""")
def set_ops(t: Tables) -> DataFrame:
    c, s = t.customer.select(F.col("c_nationkey").alias("n")), t.supplier.select(F.col("s_nationkey").alias("n"))
    named = lambda d, op: d.select(F.lit(op).alias("op"), "n")
    return named(c.union(s).distinct(), "union").union(named(c.intersect(s), "intersect")).union(named(c.subtract(s.where("n > 5")), "except"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' '), '^(?i:Abstract)[\s:]+', ''), '^\s+|\s+$', '', 'g') AS plain FROM pages")
def clean_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.clean_html(F.col("html")).alias("plain"))


@query("SELECT page_id, regexp_replace(lower(trim('https://doi.org/' || url)), '^(https://doi\\.org/|http://doi\\.org/|doi:)', '') AS doi, regexp_replace(lower(trim('doi:doi:' || url)), '^(?:https://doi\\.org/|http://doi\\.org/|doi:)+', '') AS bare FROM pages")
def norm_doi(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.norm_doi(F.concat(F.lit("https://doi.org/"), "url")).alias("doi"), T.bare_doi(F.concat(F.lit("doi:doi:"), "url")).alias("bare"))


@query(f"WITH {RECORDS} SELECT id, {KEY} AS key, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM records WHERE lang = 'en' AND NOT regexp_matches(title, '[^\\x00-\\x7F]')")
def norm_title(t: Tables) -> DataFrame:
    d = t.records().where("lang = 'en'").where(~F.col("title").rlike(r"[^\x00-\x7F]"))
    return d.select("id", T.title_key(F.col("title")).alias("key"), T.norm_title(F.col("title")).alias("spaced"), T.plain_title(F.col("title")).alias("plain"))


@query(f"WITH {RECORDS} SELECT id, {KEY} AS key, trim(regexp_replace(lower(title), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\x0B\\p{{Z}}]', ' ', 'g'), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g')) AS plain FROM records")
def norm_title_all(t: Tables) -> DataFrame:
    """As norm_title, over the titles of all documents."""
    return t.records().select("id", T.title_key(F.col("title")).alias("key"), T.norm_title(F.col("title")).alias("spaced"), T.plain_title(F.col("title")).alias("plain"))


#: Rules that the synthetic prose meets, with ASCII boundaries, so that SQL can state them too.
DEMO = {"shared": r"(?i)(^| )(the|and)( |$)", "motion": r"(?i)(^| )(tion|sh)( |$)", "license": r"(?i)\blicen[sc]ed?\b", "contact": r"(?i)[a-z0-9.]+@[a-z0-9.]+"}
ARRAY = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in DEMO.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({ARRAY}, '|') AS labels, CAST(len({ARRAY}) AS INTEGER) AS n FROM documents")
def scope_labels(t: Tables) -> DataFrame:
    found = T.matching_labels(F.col("text"), DEMO)
    return t.documents.select("doc_id", F.array_join(found, "|").alias("labels"), F.size(found).alias("n"))


@query(f"SELECT doc_id, coalesce(({ARRAY})[1], 'other_relevant') AS category FROM documents")
def categorise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.first_label(F.col("text"), DEMO, "other_relevant").alias("category"))


#: The ladder over rules of the synthetic prose.
D_POS = {"license": r"(?i)\blicen[sc]ed?\b", "contact": r"(?i)[a-z0-9.]+@[a-z0-9.]+"}
D_NEG = {"token": r"(?i)\btoken\b", "reserved": r"(?i)\ball rights reserved\b"}
D_AI = {"the": r"(?i)(^| )(the|la|der)( |$)"}
_HIT = lambda p: f"regexp_matches(body, '{p}')"
_LIST = lambda table: "list_filter([" + ", ".join(f"CASE WHEN {_HIT(p)} THEN '{k}' END" for k, p in table.items()) + "], lambda x: x IS NOT NULL)"


def ladder_sql() -> str:
    clean = "regexp_replace(regexp_replace(trim(regexp_replace(abstract, '<[^>]+>', '', 'g'), ' '), '^(?i:Abstract)[\\s:]+', ''), '^\\s+|\\s+$', '', 'g')"
    return f"""WITH {RECORDS}, b AS (SELECT id, title, abstract, title || ' ' || {clean} AS body, length({clean}) AS size FROM records),
        m AS (SELECT *, {_LIST(D_POS)} AS pos, {_LIST(D_NEG)} AS neg, len({_LIST(D_AI)}) > 0 AS ai FROM b),
        d AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)\\bretracted\\b|\\[retracted\\]|\\bretraction\\b') THEN ['exclude', 'retracted'] WHEN size < 50 THEN ['exclude', 'missing_abstract']
            WHEN regexp_matches(abstract, '(?i)(?:https?://|download link|conference proceedings|lsdexception|unhidewhenused|semihidden|<w:)') THEN ['exclude', 'low_quality_abstract']
            WHEN len(pos) > 0 AND NOT ai AND list_contains(pos, 'license') THEN ['needs_review', 'no_ai_signal'] WHEN len(pos) > 0 AND NOT ai THEN ['exclude', 'no_ai_signal']
            WHEN len(pos) = 0 AND len(neg) = 0 THEN ['exclude', 'no_scope_signal'] WHEN len(pos) = 0 THEN ['exclude', 'hard_negative:' || array_to_string(neg, '|')]
            WHEN len(neg) = 0 THEN ['include', '']
            WHEN list_contains(pos, 'contact') AND NOT list_contains(neg, 'reserved') THEN ['include', '']
            WHEN list_contains(pos, 'license') AND NOT list_contains(neg, 'token') THEN ['exclude', 'hard_negative:' || array_to_string(neg, '|')]
            ELSE ['needs_review', 'positive:' || array_to_string(pos, '|') || '|negative:' || array_to_string(neg, '|')] END AS r FROM m)
        SELECT id, r[1] AS decision, r[2] AS reason, CASE WHEN r[2] IN ('retracted', 'missing_abstract', 'low_quality_abstract') THEN '' ELSE array_to_string(pos, ',') END AS positive_rules,
            CASE WHEN r[2] IN ('retracted', 'missing_abstract', 'low_quality_abstract') THEN '' ELSE array_to_string(neg, ',') END AS negative_rules FROM d"""


def screened(t: Tables) -> DataFrame:
    d = t.records().withColumn("publication_year", F.lit(None).cast("int"))
    return rules.screen(d, D_POS, D_AI, D_NEG, None, ["license"], {"contact": ["token"]}, {"license": ["reserved"]}, None)


@query(ladder_sql())
def screening_decisions(t: Tables) -> DataFrame:
    return screened(t).select("id", "decision", "reason", "positive_rules", "negative_rules")


@query(f"WITH s AS ({ladder_sql()}) SELECT decision, reason, count(*) AS n FROM s WHERE decision IN ('include', 'needs_review') GROUP BY 1, 2")
def screened_corpus(t: Tables) -> DataFrame:
    return rules.screened_corpus(screened(t)).groupBy("decision", "reason").agg(F.count("*").alias("n"))


def scored(t: Tables) -> DataFrame:
    n = lambda k: F.when(T.any_match(F.col("text"), DEMO[k]), 1).otherwise(0)
    index = rules.relevance(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0), n("shared") + n("license"), n("motion"), n("contact"), F.size(F.split("source", "")), F.col("n_chars") >= 150, n("license"), F.col("lang") != "en")
    return t.documents.select("doc_id", "source", "text", "lang", index.alias("relevance"))


_N = lambda k: f"(CASE WHEN regexp_matches(text, '{DEMO[k]}') THEN 1.0 ELSE 0.0 END)"
SCORED = f"""scored AS (SELECT doc_id, source, text, lang, round_even(least(greatest(0.24 * 0 + 0.24 * CAST({_N('shared')} + {_N('license')} AS DOUBLE) / 3 + 0.10 * CAST({_N('motion')} AS DOUBLE) / 2 + 0.08 * CAST({_N('contact')} AS DOUBLE) / 4
    + 0.05 * CAST(least(length(source), 6) AS DOUBLE) / 6 + 0.05 * CASE WHEN n_chars >= 150 THEN 1.0 ELSE 0.0 END - 0.22 * CAST({_N('license')} AS DOUBLE) / 3 - 0.16 * CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END, 0), 1), 4) AS relevance FROM documents)"""


@query(f"""WITH {SCORED}, r AS (SELECT doc_id, relevance, row_number() OVER (ORDER BY relevance DESC, doc_id) AS rank, count(*) FILTER (relevance >= 0.25) OVER () AS base FROM scored)
    SELECT doc_id, round(relevance, 3) AS relevance, CAST(rank AS INTEGER) AS rank, rank <= least(200, greatest(30, base)) AS keep FROM r WHERE rank <= 200""")
def relevance_rank_floor_cap(t: Tables) -> DataFrame:
    d = scored(t).select("doc_id", "relevance")
    return R.keep_ranked(d, "relevance", [F.desc("relevance"), F.asc("doc_id")], rules.THRESHOLD, rules.FLOOR, rules.CAP).select("doc_id", F.round("relevance", 3).alias("relevance"), "rank", "keep")


@query(f"WITH {SCORED} SELECT doc_id, lang <> 'en' AND NOT (source = 'src1' OR relevance >= 0.48) AS vetoed FROM scored")
def veto(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", rules.veto(F.col("lang") != "en", F.when(F.col("source") == "src1", "label").otherwise(""), F.col("relevance")).alias("vetoed"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER (regexp_matches(text, '{p}')) AS n, round_even(100.0 * count(*) FILTER (regexp_matches(text, '{p}')) / count(*), 2) AS pct FROM documents" for k, p in DEMO.items()))
def rule_audit(t: Tables) -> DataFrame:
    return rules.audit(t.documents, "text", DEMO)


@query("SELECT sha256(string_agg(doc_id || chr(9) || source || chr(9) || sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint, count(*) AS n FROM documents")
def corpus_fingerprint(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", "doc_id", "source", F.sha2("text", 256))
    rows = t.documents.select("doc_id", line.alias("line"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("l"), F.count("*").alias("n"))
    return ordered.select(F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("fingerprint"), "n")


@query("SELECT CAST(bit_xor(('0x' || left(md5(CAST(doc_id AS VARCHAR) || ':' || md5(text)), 15))::BIGINT) AS BIGINT) AS fingerprint, count(*) AS n FROM documents")
def corpus_fingerprint_unordered(t: Tables) -> DataFrame:
    """The form for large corpora: a sum that needs no order and merges by parts."""
    digest = F.conv(F.left(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))), F.lit(15)), 16, 10).cast("long")
    return t.documents.agg(F.bit_xor(digest).alias("fingerprint"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, doc_id || chr(9) || source || chr(9) || sha256(text) AS line FROM documents), a AS (SELECT doc_id // 1000 AS b, sha256(string_agg(line, chr(10) ORDER BY doc_id, line)) AS h, count(*) AS n FROM l GROUP BY 1),
    c AS (SELECT b // 1000 AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM a GROUP BY 1), d AS (SELECT b // 1000 AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM c GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM d""")
def corpus_fingerprint_ranges(t: Tables) -> DataFrame:
    """The ordered form for large corpora: ranges of a thousand ids are digested, then ranges of a thousand digests, and so on; no row gathers more."""
    d = t.documents.select(F.col("doc_id").alias("b"), F.concat_ws("\t", "doc_id", "source", F.sha2("text", 256)).alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(3):
        lines = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
        d = d.groupBy(F.floor(F.col("b") / 1000).alias("c")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("c", "b")
    last = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return d.agg(F.sha2(F.array_join(last, "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 40), ' ') AS rebuilt FROM documents")
def inverted_index_rebuild(t: Tables) -> DataFrame:
    from ..sources.works import inverted_index, rebuild_abstract

    index = t.documents.select("doc_id", inverted_index(F.slice(F.split("text", " "), 1, 40)).alias("inverted"))
    return index.select("doc_id", rebuild_abstract(F.col("inverted")).alias("rebuilt"))


@query("SELECT doc_id, text AS rebuilt FROM documents")
def inverted_index_rebuild_whole(t: Tables) -> DataFrame:
    """As inverted_index_rebuild, over all words of each text."""
    from ..sources.works import inverted_index, rebuild_abstract

    index = t.documents.select("doc_id", inverted_index(F.split("text", " ")).alias("inverted"))
    return index.select("doc_id", rebuild_abstract(F.col("inverted")).alias("rebuilt"))


@query("""SELECT conv_id, turn, array_to_string(list_distinct(list_filter(list_transform(string_split(role || ';' || left(text, 12) || '; ' || role, ';'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ ,;{}]+|[ ,;{}]+$', '', 'g')), lambda x: x <> '')), '') <> '' AS any_author,
    CAST(len(list_distinct(list_filter(list_transform(string_split(role || ';' || left(text, 12) || '; ' || role, ';'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ ,;{}]+|[ ,;{}]+$', '', 'g')), lambda x: x <> ''))) AS INTEGER) AS n_authors FROM conversations""")
def plain_authors(t: Tables) -> DataFrame:
    names = T.plain_authors(F.concat(F.col("role"), F.lit(";"), F.left("text", F.lit(12)), F.lit("; "), F.col("role")))
    return t.conversations.select("conv_id", "turn", (F.size(names) > 0).alias("any_author"), F.size(names).alias("n_authors"))


@query("SELECT conv_id, turn, role AS name, 'inst' || conv_id AS institution, CASE WHEN turn % 2 = 0 THEN 'BR' END AS country FROM conversations")
def nested_authors(t: Tables) -> DataFrame:
    inst = F.struct(F.concat(F.lit("inst"), "conv_id").alias("display_name"), F.when(F.col("turn") % 2 == 0, "BR").alias("country_code"))
    items = F.array(F.struct(F.struct(F.col("role").alias("display_name")).alias("author"), F.array(inst).alias("institutions")))
    return t.conversations.select("conv_id", "turn", F.explode(T.nested_authors(items)).alias("a")).select("conv_id", "turn", "a.*")


@query(r"""SELECT page_id, left(html, 80) AS head, CAST(length(html) AS INTEGER) AS size, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, sha256(html) AS sha,
    TRY_CAST(nullif(regexp_extract(url, '([0-9]{4})', 1), '') AS INTEGER) AS year, CAST(strpos(html, '<p') AS INTEGER) AS at FROM pages""")
def string_toolkit(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.substring("html", 1, 80).alias("head"), F.length("html").alias("size"), T.slug(F.col("url")).alias("slug"), F.sha2("html", 256).alias("sha"), T.year_anywhere(F.col("url")).alias("year"), T.context(F.col("html"), "<p", 20)["position"].alias("at"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS title FROM pages""")
def unescape_entities(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.unescape(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@query("SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS ln_q, round(ln(1 + l_tax), 6) AS log1p_tax, round(sqrt(l_extendedprice), 6) AS root, round_even(l_quantity / 4, 0) AS half_even, round(exp(l_discount), 6) AS e, round(pow(l_discount, 2), 6) AS sq FROM lineitem")
def numeric_toolkit(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(F.ln("l_quantity")).alias("ln_q"), r6(F.log1p("l_tax")).alias("log1p_tax"), r6(F.sqrt("l_extendedprice")).alias("root"), F.bround(F.col("l_quantity") / 4, 0).alias("half_even"), r6(F.exp("l_discount")).alias("e"), r6(F.pow("l_discount", F.lit(2))).alias("sq"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_tumbling_counts(t: Tables) -> DataFrame:
    from ..streaming.events import tumbling

    return tumbling(t.events, "1 hour").select("hour", "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH w AS (SELECT event_type, date_trunc('hour', ts) AS s FROM events UNION ALL SELECT event_type, date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) SELECT s AS start, s + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def event_sliding_counts(t: Tables) -> DataFrame:
    from ..streaming.events import sliding

    return sliding(t.events, "2 hours", "1 hour")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t: Tables) -> DataFrame:
    from ..streaming.events import sessions

    return sessions(t.events, "1 hour")


@query("SELECT DISTINCT user_id FROM events")
def event_first_seen(t: Tables) -> DataFrame:
    from ..streaming.events import first_seen

    return first_seen(t.events, "user_id").select("user_id")
