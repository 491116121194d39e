"""Stages from raw records to indicators and their summary; each maps tables to tables, lazily, in order of dependency."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import biblio as B
from ..operators import dedup as D
from ..operators import rank as R
from ..operators import funnel, report, rules, sampling, stats, topics
from ..operators import vectors as V
from ..sources import cache, exchange

Frames = dict[str, DataFrame]


def lexical_features(d: DataFrame) -> DataFrame:
    """Add rule hits and counts, category, alignment and off-topic flags to canonical records."""
    text = lambda *cs: F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in cs))
    heading = text("title", "primary_topic", "keyword_terms")
    body = text("title", "primary_topic", "keyword_terms", "topic_terms", "abstract")
    hits = {"scope_positive": (body, rules.POSITIVE), "scope_positive_title": (heading, rules.POSITIVE), "scope_negative": (body, rules.NEGATIVE), "ai_signal": (body, rules.AI_SIGNALS)}
    for name, (where, table) in hits.items():
        d = d.withColumn(f"{name}_hits", T.pipe_join(T.matching_labels(where, table))).withColumn(f"{name}_count", T.count_labels(F.col(f"{name}_hits")))
    d = d.withColumn("category", T.first_label(body, rules.POSITIVE, "other_relevant")).withColumn("core_alignment", F.col("scope_positive_count") > 0)
    d = d.withColumn("title_offtopic", T.any_match(F.col("title"), rules.OFFTOPIC_TITLE)).withColumn("offtopic_topic", T.any_match(F.col("primary_topic"), rules.OFFTOPIC_TOPIC))
    return d.withColumn("abstract_ok", F.length(F.coalesce("abstract", F.lit(""))) >= rules.MIN_ABSTRACT)


def fetch(tables: Frames) -> Frames:
    """sources (canonical, with ingest_order, and similarities where there are any) to corpus and fetch_exclusions.

    Each excluded record has a reason; of the others those that pass the threshold stay, within
    the floor and the cap, and manual records with an abstract always do.
    """
    d = D.with_optional(tables["sources"], {"semantic_positive": "double", "semantic_negative": "double", "semantic_margin": "double"})
    d = lexical_features(d)
    manual = F.col("data_source").isin(*rules.MANUAL_SOURCES)
    d = d.withColumn("relevance_index", rules.relevance(F.col("semantic_positive"), F.col("semantic_negative"), F.col("semantic_margin"), F.col("scope_positive_count"), F.col("scope_positive_title_count"), F.col("ai_signal_count"), F.coalesce("matched_search_term_count", F.lit(0)), F.col("abstract_ok"), F.col("scope_negative_count"), F.col("offtopic_topic")))
    d = d.withColumn("fetch_exclusion_reason", rules.exclusion_reason(manual, F.col("abstract_ok"), F.col("title_offtopic"), F.col("core_alignment")))
    order = [F.desc("relevance_index"), F.desc("matched_search_term_count"), F.desc("scope_positive_count"), F.desc("cited_by_count"), F.asc("ingest_order")]
    ranked = R.keep_ranked(d.where("fetch_exclusion_reason = ''"), "relevance_index", order, rules.THRESHOLD, rules.FLOOR, rules.CAP)
    kept = ranked.where("keep").select("ingest_order", F.col("rank").alias("fetch_keep_rank"))
    d = d.join(kept, "ingest_order", "left")
    stays = F.col("fetch_keep_rank").isNotNull() | (manual & F.col("abstract_ok"))
    reason = F.when(stays, "keep").when(F.col("fetch_exclusion_reason") == "", "low_relevance").otherwise(F.col("fetch_exclusion_reason"))
    d = d.withColumn("fetch_exclusion_reason", reason)
    corpus, excluded = D.split(d, F.col("fetch_exclusion_reason") == "keep")
    return {"corpus": corpus.drop("core_alignment", "title_offtopic", "offtopic_topic", "abstract_ok"), "fetch_exclusions": excluded}


#: What removes records from the corpus, in order.
CLEANING = ("doi_repeated", "title_repeated", "year", "retracted", "offtopic")


def clean_observed(tables: Frames) -> tuple[DataFrame, Observation]:
    """corpus_clean and the counts of its steps, which come with the job that writes it."""
    d = tables["corpus"].withColumn("title", T.clean_html(F.col("title"))).withColumn("abstract", T.clean_html(F.col("abstract")))
    d = D.with_optional(d, {"scope_positive_title_hits": "string", "relevance_index": "double", "primary_topic": "string"})
    doi = T.blank_to_null(F.col("doi"))
    known = F.coalesce(doi, F.lit("")) != ""
    d = funnel.repeated(d, "doi_repeated", doi, [F.col("ingest_order")], known)
    d = funnel.repeated(d, "title_repeated", T.title_key(F.col("title")), [F.when(known, 0).otherwise(1), F.col("ingest_order")])
    off = T.any_match(F.col("primary_topic"), rules.OFFTOPIC_TOPIC)
    outside = ~F.coalesce(F.col("publication_year").between(*rules.YEARS), F.lit(False))
    d = funnel.removed(d, {"year": outside, "retracted": F.coalesce(T.any_match(F.col("title"), rules.RETRACTED), F.lit(True)), "offtopic": F.coalesce(rules.veto(off, F.col("scope_positive_title_hits"), F.col("relevance_index")), F.lit(True))})
    return funnel.observed(d, CLEANING, f"clean-{uuid.uuid4().hex}")


def clean(tables: Frames) -> Frames:
    """corpus to corpus_clean: one record of each DOI and title, years in range, no retractions, off-topic topics vetoed.  A run that writes its tables adds clean_funnel, the steps' counts."""
    return {"corpus_clean": clean_observed(tables)[0]}


def enrich(tables: Frames) -> Frames:
    """corpus_clean with citations and countries that it lacks, by DOI and, for PubMed records without one, by title.

    Look-ups are tables, each of which may be missing: doi_lookups (key, cited_by_count, countries)
    and pmid_lookups (key, cited_by_count), as cache.look_up makes them, and pmid_map (key, pmid) of
    normalised titles.  corpus_clustered is patched too, where it is there.
    """
    by_doi, by_pmid, titles = (tables.get(n) for n in ("doi_lookups", "pmid_lookups", "pmid_map"))

    def patched(d: DataFrame) -> DataFrame:
        columns = d.columns
        d = d.withColumn("_doi", T.norm_doi(F.col("doi"))).withColumn("countries", T.blank_to_null(F.col("countries")))
        if by_doi is not None:
            d = D.patch(d.withColumnRenamed("_doi", "key"), by_doi, "key", ["cited_by_count"], ["countries"]).withColumnRenamed("key", "_doi")
        if by_pmid is not None and titles is not None:
            found = titles.join(by_pmid.withColumnRenamed("key", "pmid"), "pmid").select("key", F.col("cited_by_count").alias("_n"))
            d = d.withColumn("key", F.when((F.col("data_source") == "pubmed_manual") & (F.col("_doi") == ""), T.plain_title(F.col("title"))))
            d = d.join(found, "key", "left").withColumn("cited_by_count", F.when((F.coalesce("cited_by_count", F.lit(0)) == 0) & (F.col("_n") > 0), F.col("_n")).otherwise(F.coalesce("cited_by_count", F.lit(0))))
        return d.withColumn("countries", F.coalesce("countries", F.lit(""))).select(*columns)

    return {name: patched(tables[name]) for name in ("corpus_clean", "corpus_clustered") if name in tables}


def indicators(tables: Frames) -> Frames:
    d = tables["corpus_clean"]
    authors = d.select(F.col("id").alias("paper"), F.explode(T.plain_authors(F.col("authors"))).alias("author"), F.col("cited_by_count").alias("cit"))
    words: Column = T.keyword_terms(F.col("keyword_terms"))
    codes = B.frequencies(d, T.countries(F.col("countries")), "country_code").withColumnRenamed("freq", "n")
    cited = [F.desc("cited_by_count"), F.asc("ingest_order")]
    return {
        "top20_cited": d.orderBy(*cited).limit(20).select("id", "title", "publication_year", "cited_by_count", "journal"),
        "yearly_production": B.yearly_production(d),
        "geo_countries": B.shares(codes, "n"),
        "journals": B.bradford_zones(B.journal_table(d.withColumn("position", F.col("ingest_order")))),
        "lotka": B.lotka(authors),
        "top_authors": B.author_table(authors).orderBy(F.desc("n_papers"), F.desc("total_cit"), "author").limit(30),
        "keyword_freq": B.frequencies(d, words, "keyword"),
        "keyword_cooc": B.pairs(d, words, 3),
        "collab_countries": B.pairs(d, T.countries(F.col("countries"), strict=False)),
    }


def embed(tables: Frames) -> Frames:
    """corpus_clean and embeddings (id, vector) to corpus_clustered and embedding_exclusions."""
    good, bad = D.split(tables["corpus_clean"], (F.length("abstract") >= rules.MIN_EMBED) & ~T.any_match(F.col("abstract"), rules.LOW_QUALITY))
    found, _, _ = V.kmeans(good.join(tables["embeddings"], "id"), "vector")
    return {"corpus_clustered": V.pca2(found, "vector"), "embedding_exclusions": bad.withColumn("abs_len", F.length("abstract"))}


def axes(tables: Frames) -> Frames:
    """corpus_clustered and poles (axis, pole, name, vector) to axis_scores with a column for each axis, and its z-score."""
    d = tables["corpus_clustered"]
    names = _few(tables["poles"].select("axis").distinct().orderBy("axis"), "axes")  # the columns to make
    for name in names:
        d = V.project(d, "vector", V.axis(tables["poles"].where(F.col("axis") == name)), f"axis_{name}", centered=True)
    stats = d.agg(*(F.avg(f"axis_{n}").alias(f"_m_{n}") for n in names), *(F.stddev_pop(f"axis_{n}").alias(f"_s_{n}") for n in names))
    d = d.crossJoin(F.broadcast(stats))
    return {"axis_scores": d.select("id", "title", "publication_year", "cluster", *(f"axis_{n}" for n in names), *(((F.col(f"axis_{n}") - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).alias(f"axis_{n}_z") for n in names))}


def _few(rows: DataFrame, what: str, most: int = 1000) -> list:
    """The only column of a few rows that become columns of a result; more of them are an error."""
    found = [r[0] for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} {what}")
    return found


#: Words of a cluster's description before its phrases, which the report gives in Portuguese.
FOCUS = "Artigos com foco predominante em: "


def analyses(tables: Frames) -> Frames:
    """axis_scores, corpus_clustered and keyword_freq to profiles by year and cluster.

    axis_scores_enriched (scores with what the corpus knows, and each cluster's label and
    description), temporal_profile, cluster_share_by_year, zipf_analysis, zipf_stats and the
    papers, journals and keywords that clusters are about.
    """
    corpus = tables["corpus_clustered"]
    given = ["title", "abstract", "cited_by_count", "publication_year", "category", "primary_topic", "keyword_terms", "journal", "doi", "countries"]
    corpus = D.with_optional(corpus, {c: "string" for c in given}).select("id", *given)
    scores = tables["axis_scores"]
    names = [c for c in scores.columns if c.startswith("axis_") and not c.endswith("_z")]
    d = scores.select("id", "cluster", *names).join(corpus.withColumn("cited_by_count", T.as_int(F.col("cited_by_count"))), "id", "left")
    words = F.col("keyword_terms")
    terms = d.select("cluster", F.explode(T.cluster_terms(words, T.CLUSTER_NOISE)).alias("keyword")).groupBy("cluster", "keyword").agg(F.count("*").alias("freq"))
    names_a_cluster = F.when(F.col("keyword").contains(" "), T.phrase_is_valid(F.col("keyword"), T.CLUSTER_STOPLIST, T.CLUSTER_BAD_TOKENS)).otherwise(~F.col("keyword").isin(*T.LONE_WORDS))
    lone = B.top_per_group(terms.where(names_a_cluster), ["cluster"], [F.desc("freq"), F.asc("keyword")], 10)
    fallback = lone.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("words"))
    text = F.concat_ws(" ", "title", "abstract", F.array_join(T.cluster_terms(words, T.CLUSTER_NOISE), " "))
    found = topics.topics(d.withColumn("text", text), "text", "cluster", stoplist=T.CLUSTER_STOPLIST, bad=T.CLUSTER_BAD_TOKENS).withColumnRenamed("group", "cluster")
    said = d.select("cluster").distinct().join(found, "cluster", "left").join(fallback, "cluster", "left")
    own = F.coalesce("phrases", F.array().cast("array<string>"))
    more = F.transform(F.coalesce("words", F.array().cast("array<string>")), T.cluster_phrase)
    phrases = F.when(F.size(own) < 2, F.slice(F.array_distinct(F.concat(own, more)), 1, 5)).otherwise(own)
    phrases = F.when(F.size(phrases) == 0, F.array(F.concat(F.lit("Cluster "), F.col("cluster")))).otherwise(phrases)
    said = said.select("cluster", phrases.alias("p")).select("cluster", F.array_join(F.slice("p", 1, 2), " · ").alias("cluster_label"), F.concat(F.lit(FOCUS), F.array_join(F.slice("p", 1, 5), ", "), F.lit(".")).alias("cluster_description"))
    d = d.join(said, "cluster")
    core = d.where(F.col("publication_year").between(*rules.YEARS))
    means = [F.avg(n).alias(f"mean_{n.removeprefix('axis_')}") for n in names]
    positive = [(100.0 * F.avg((F.col(n) > 0).cast("double"))).alias(f"pct_{n.removeprefix('axis_')}_pos") for n in names]
    years = core.groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("n"), *positive, *means)
    share = core.groupBy(F.col("publication_year").alias("year"), "cluster", "cluster_label").agg(F.count("*").alias("n"))
    share = share.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("year")), 2))
    frequency = tables["keyword_freq"].select(F.col("keyword").alias("term"), "freq")
    fit = B.zipf(frequency)
    ranked = frequency.orderBy(F.desc("freq"), "term").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "term")))
    line = ranked.crossJoin(F.broadcast(fit.select("alpha", "intercept", "core")))
    expected = F.when(F.col("rank") <= F.col("core"), F.round(F.exp("intercept") * F.pow("rank", -F.col("alpha")), 2))
    papers = B.top_per_group(d, ["cluster"], [F.desc("cited_by_count"), F.asc("id")], 10).select("cluster", "cluster_label", "title", "publication_year", "cited_by_count", "journal", "doi")
    labelled = d.where(T.blank_to_null(F.col("journal")).isNotNull()).withColumn("journal", T.journal_label(F.regexp_replace("journal", r"\s+", " ")))
    sizes = d.groupBy("cluster").agg(F.count("*").alias("_all"))
    journals = B.top_per_group(labelled.groupBy("cluster", "cluster_label", "journal").agg(F.count("*").alias("n_papers")), ["cluster"], [F.desc("n_papers"), F.asc("journal")], 5)
    journals = journals.join(sizes, "cluster").select("cluster", "cluster_label", "journal", "n_papers", F.round(100.0 * F.col("n_papers") / F.col("_all"), 1).alias("pct"))
    return {
        "axis_scores_enriched": d.select("id", "title", "publication_year", "cluster", "cluster_label", "cluster_description", "category", "primary_topic", "cited_by_count", *names), "temporal_profile": years, "cluster_share_by_year": share, "zipf_stats": fit,
        "zipf_analysis": line.select("rank", F.col("term").alias("keyword"), "freq", expected.alias("freq_expected")), "cluster_focus_papers": papers, "cluster_focus_journals": journals, "cluster_focus_keywords": lone.join(said, "cluster").select("cluster", "cluster_label", "keyword", "freq"),
    }


def statistics(tables: Frames) -> Frames:
    """axis_scores_enriched to the tests of the report.

    axis_tests: for each axis its mean and deviation, Spearman's rho with citations over all and
    over cited papers, and whether the top quarter is cited more than the bottom one (Mann-Whitney);
    axis_correlations: Pearson's r of each pair; axis_quartiles: citations by quartile of each axis;
    hypotheses, where there are two axes or more: trends of the first two, their association and their citations.
    """
    d = tables["axis_scores_enriched"]
    names = [c for c in d.columns if c.startswith("axis_")]
    cuts = {n: R.quantiles(d, n, [0.25, 0.75]) for n in names}
    if not names or cuts[names[0]][0] is None:
        raise ValueError("no axis scores to test")
    rows, quartiles = [], None
    for n in names:
        (rho, p, _), (rho_cited, p_cited, _) = stats.spearman(d, "cited_by_count", n), stats.spearman(d.where("cited_by_count > 0"), "cited_by_count", n)
        low, high = cuts[n]
        ends = d.where((F.col(n) >= high) | (F.col(n) <= low))
        u, p_u = stats.mann_whitney(ends, "cited_by_count", F.col(n) >= high)
        medians = ends.agg(F.median(F.when(F.col(n) >= high, F.col("cited_by_count"))), F.median(F.when(F.col(n) <= low, F.col("cited_by_count"))), F.avg(n), F.stddev(n)).first()
        rows.append((n.removeprefix("axis_"), *medians[2:], rho, p, rho_cited, p_cited, float(u), p_u, *medians[:2], p_u < 0.05))
        part = R.quantile_bins(d.select("cited_by_count", n), n, 4, "quartile").groupBy("quartile").agg(F.count("*").alias("n"), F.median("cited_by_count").alias("median_cit"), F.avg("cited_by_count").alias("mean_cit"))
        part = part.where("quartile is not null").select(F.lit(n.removeprefix("axis_")).alias("axis"), "*")
        quartiles = part if quartiles is None else quartiles.union(part)
    tests = d.sparkSession.createDataFrame(rows, "axis string, mean double, std double, rho_all double, p_all double, rho_cited double, p_cited double, u double, p double, med_top double, med_bottom double, confirmed boolean")
    made = {"axis_tests": tests, "axis_correlations": stats.correlation_matrix(d, names), "axis_quartiles": quartiles}
    if len(names) > 1 and d.where("publication_year IS NOT NULL").select("publication_year").distinct().limit(2).count() == 2:
        made["hypotheses"] = report.hypotheses(d, names[0], names[1], "publication_year", "cited_by_count")
    return made


def validation(tables: Frames) -> Frames:
    """axis_scores_enriched to validation_sample, two papers of each cluster and third of the first axis, with ids for a form.

    Where a filled form is there (validation_form: id, sample_type and for each axis rater1_<axis>,
    rater2_<axis> and, if a rater had too little information, rater1_<axis>_insufficient and
    rater2_<axis>_insufficient), validation_metrics holds its confirmatory items against the scores.
    """
    d = tables["axis_scores_enriched"]
    first = next(c for c in d.columns if c.startswith("axis_"))
    thirds = R.quantile_bins(d, first, 3, "third").where("third is not null")
    made = {"validation_sample": sampling.row_ids(sampling.cell_sample(thirds, ["cluster", "third"], "id", 2, 60), "id")}
    if "validation_form" in tables:
        axes_ = [c for c in d.columns if c.startswith("axis_")]
        form = tables["validation_form"].where("sample_type = 'confirmatory'").join(d.select("id", *axes_), "id")
        rated = [(c, c.removeprefix("axis_")) for c in axes_ if f"rater1_{c.removeprefix('axis_')}" in form.columns]
        unsure = lambda a: (f"rater1_{a}_insufficient", f"rater2_{a}_insufficient") if f"rater1_{a}_insufficient" in form.columns else None
        parts = [report.ratings(form, a, c, (f"rater1_{a}", f"rater2_{a}"), unsure(a)) for c, a in rated]
        if parts:
            made["validation_metrics"] = reduce(DataFrame.unionByName, parts)
    return made


def summary(tables: Frames) -> Frames:
    """One row, report_summary: counts of the corpus, its exclusions, clusters and tests, tables as JSON."""
    d, clean_, years, geo = (tables[n] for n in ("axis_scores_enriched", "corpus_clean", "yearly_production", "geo_countries"))
    names = [c for c in d.columns if c.startswith("axis_")]
    corpus = d.agg(F.count("*").alias("n_articles"), F.count_if(F.col("cited_by_count") == 0).alias("zero_citations_n"), F.round(100.0 * F.avg((F.col("cited_by_count") == 0).cast("double")), 1).alias("zero_citations_pct"), F.max("cited_by_count").alias("max_citations"))
    corpus = corpus.crossJoin(clean_.agg(F.count("*").alias("n_corpus_clean"), F.count_if(T.blank_to_null(F.col("countries")).isNotNull()).alias("n_articles_with_countries")))
    corpus = corpus.crossJoin(years.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))).crossJoin(geo.agg(F.count("*").alias("n_countries")))
    clusters = d.groupBy("cluster").agg(F.max("cluster_label").alias("label"), F.max("cluster_description").alias("description"), F.count("*").alias("n"), *(F.avg(n).alias(f"mean_{n.removeprefix('axis_')}") for n in names))
    clusters = clusters.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
    parts = {"corpus": corpus, "clusters": clusters, "axis_tests": tables["axis_tests"], "axis_correlations": tables["axis_correlations"], "axis_quartiles": tables["axis_quartiles"], "top_paper": tables["top20_cited"].orderBy(F.desc("cited_by_count"), "id").limit(1)}
    if "fetch_exclusions" in tables:
        parts["prisma"] = tables["fetch_exclusions"].groupBy("fetch_exclusion_reason").agg(F.count("*").alias("n"))
    return {"report_summary": exchange.summary(parts)}


def screening(tables: Frames) -> Frames:
    decided = rules.screen(tables["corpus_clean"])
    return {"screening_decisions": decided, "corpus_paper": rules.screened_corpus(decided)}


STAGES: dict[str, Callable[[Frames], Frames]] = {f.__name__: f for f in (fetch, clean, enrich, indicators, embed, axes, analyses, statistics, validation, summary, screening)}


def resolve(names: Sequence[str] | None = None, start: str | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Stage names in order: those asked for, from `start` on, without the excluded."""
    order = list(STAGES)
    if unknown := {*(names or ()), *exclude, *([start] if start else [])} - set(order):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    chosen = [s for s in order[order.index(start) if start else 0 :] if (not names or s in names) and s not in exclude]
    if not chosen:
        raise ValueError("no stage is left")
    return chosen


def run(spark: SparkSession, tables: Frames, names: Sequence[str] | None = None, root: str | None = None, **which) -> Frames:
    """Run stages over tables; with a root each result is written below it, a folder for each stage, and read again."""
    for name in resolve(names, **which):
        counts = None
        if root and name == "clean":
            corpus, counts = clean_observed(tables)
            made = {"corpus_clean": corpus}
        else:
            made = STAGES[name](tables)
        if root:
            for table, df in made.items():
                df.write.mode("overwrite").parquet(f"{root}/{name}/{table}")
            if counts:  # the job that wrote the table has left them
                funnel.reconciled(funnel.as_table(spark, counts.get), spark.read.parquet(f"{root}/clean/corpus_clean")).write.mode("overwrite").parquet(f"{root}/clean/clean_funnel")
            made = {table: spark.read.parquet(f"{root}/{name}/{table}") for table in [*made, *(["clean_funnel"] if counts else [])]}
        tables = {**tables, **made}
    return tables


#: Tables that a run begins with, below its folder's `input`.
INPUTS = ["sources", "embeddings", "poles", "doi_lookups", "pmid_lookups", "pmid_map", "validation_form"]
#: Tables that each stage makes.
MAKES = {
    "fetch": ["corpus", "fetch_exclusions"], "clean": ["corpus_clean", "clean_funnel"], "enrich": ["corpus_clean", "corpus_clustered"], "indicators": ["top20_cited", "yearly_production", "geo_countries", "journals", "lotka", "top_authors", "keyword_freq", "keyword_cooc", "collab_countries"],
    "embed": ["corpus_clustered", "embedding_exclusions"], "axes": ["axis_scores"], "analyses": ["axis_scores_enriched", "temporal_profile", "cluster_share_by_year", "zipf_stats", "zipf_analysis", "cluster_focus_papers", "cluster_focus_journals", "cluster_focus_keywords"],
    "statistics": ["axis_tests", "axis_correlations", "axis_quartiles", "hypotheses"], "validation": ["validation_sample", "validation_metrics"], "summary": ["report_summary"], "screening": ["screening_decisions", "corpus_paper"],
}


def held(spark: SparkSession, root: str, before: str) -> Frames:
    """What the folder of a run has of its inputs and of the stages before `before`."""
    order = list(STAGES)
    places = [(f"{root}/input/{t}", t) for t in INPUTS] + [(f"{root}/{stage}/{t}", t) for stage in order[: order.index(before)] for t in MAKES[stage]]
    return {table: spark.read.parquet(path) for path, table in places if cache.exists(spark, path)}
