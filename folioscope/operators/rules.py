"""Lexical screening: rule tables, the decision ladder, relevance and vetoes.

Rules are mappings of label to pattern, in order; any other table of the same shape may be passed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The screening rules, off-topic lists, thresholds and weights.
POSITIVE = {
    "research_writing": r"(?iU)\b(?:academic journal writing|academic paper writing|research paper writing|scientific manuscript|journal manuscript|manuscript (?:preparation|drafting|editing)|academic editing|scientific writing|research writing|thesis writing|dissertation writing|scholarly publishing|scientific publishing|research and publishing|academic research and publishing|manuscrito científico|redação científica|redacción científica|comunicação científica|comunicación científica|publicação científica|publicación científica)\b",
    "research_workflow": r"(?iU)\b(?:peer review (?:process|quality|assistance|automation|generation|system|workflow|of manuscripts?|of articles?|of scientific|for scholarly|for academic)|(?:automated|AI|LLM|machine|deep|neural).{0,30}peer review|peer review.{0,30}(?:automation|AI|LLM|tool|system|software|platform)|reviewer comments|reference management|citation management|research workflow|scholarly communication|journal submission|research assistant|(?:automated|AI.{0,5}(?:assisted|driven|powered)|LLM.{0,5}powered|tool.{0,10})\s+literature (?:search|screening)|literature search (?:system|tool|software|platform|assistant|support|services?)|literature review (?:system|tool|software|platform|automation|assistant|support|services?)|(?:automated|AI.{0,5}assisted|LLM.{0,5}powered|tool.{0,10})\s+systematic\s+(?:literature\s+)?review(?:s)?)",
    "integrity_governance": r"(?iU)\b(?:publication ethics|research integrity|research ethics|journal policy|editorial policy|editorial guidelines?|academic integrity|plagiarism detection|text similarity detection|integridade acadêmica|integridad académica|integridade científica|integridad científica|ética de publicação|peer review manipulation|manuscript screening|research paper mill|paper mill(?:s)?\s+(?:fraud|blacklist|threat)|paper mill.{0,60}(?:manuscripts?|authors?|publications?)|authorship (?:misconduct|dispute|polic|guidelines?|dilemma|equity|attribution|practices|conflict|credits?)|honorary authorship|ghost authorship|gift authorship|authorship-for-sale|authorship of|authorship attribution|LLM-generated (?:paper|manuscript|text|content)|generated text detect|AI.{0,5}text detect|deepfake text|(?:detect|detection|identify|identifying|prevalence|disclosure|polic).{0,40}AI-generated)\b",
    "evidence_synthesis": r"(?iU)\b(?:abstract screening|study selection|reference screening|evidence synthesis|systematic review (?:automation|tool(?:s)?|assistant|support)|automated systematic review(?:s)?|living systematic review(?:s)?|title.{0,15}abstract screening|PICO.{0,25}(?:generation|queries)|meta-analysis automation)\b",
    "scholarly_publishing": r"(?iU)\b(?:journal polic(?:y|ies)|editorial polic(?:y|ies)|publishing polic(?:y|ies)|author guidelines?|manuscript preparation|publication ethics|predatory journal|ORCID|AI-generated text detection|AI-text detection|machine-generated text detection|content detection|medical writing|scientific writing|revisão por pares|revisión por pares)\b",
    "ai_literacy": r"(?iU)\b(?:AI literacy|artificial intelligence literacy|algorithmic literacy|AI competency|AI competencies|GenAI literacy|generative AI literacy)\b",
}
AI_SIGNALS = {
    "ai_general": r"(?iU)\b(?:artificial intelligence|inteligência artificial|inteligencia artificial|AI|IA)\b",
    "machine_learning": r"(?iU)\b(?:machine learning|aprendizado de máquina|aprendizaje automático)\b",
    "llm": r"(?iU)\b(?:large language models?|LLMs?)\b",
    "generative_ai": r"(?iU)\b(?:generative AI|IA generativa|GenAI|foundation models?)\b",
    "chatgpt": r"(?iU)\b(?:ChatGPT|GPT-4(?:o)?|GPT-?[0-9])\b",
    "nlp": r"(?iU)\b(?:natural language processing|NLP)\b",
    "language_models": r"(?iU)\b(?:language models?|text classification|classifier|term weighting|automated peer review|embeddings?)\b",
}
NEGATIVE = {
    "language_learning": r"(?iU)\b(?:EFL|ESL|TESOL|TEFL|foreign language|second language|language education|english language|arabic language|kazakh language|language teaching|language learning|pronunciation|vocabulary|reading comprehension|speaking skills|sign language|language classroom|philology|linguocultural|digital pedagogy|english teacher|language teacher)\b",
    "classroom_pedagogy": r"(?iU)\b(?:K-?12|secondary (?:education|school)|middle school|high school|primary school|lesson plan|tutoring|quiz generation|intelligent tutoring|learning analytics|instructional design|educational technology|(?:teaching\s+pedagog(?:y|ical)|pedagog(?:y|ical)\s+(?:practices?|strategies?|approaches?|tools?|methods?)))\b",
    "medical": r"(?iU)\b(?:patient|clinical|medical|medicine|healthcare|hospital|nursing|dental|orthodontic|surgery|surgical|oncology|pharmacy|rheumatology|anesthesia|inpatient|dentistry|midwifery|gynecology|orthopaedic)\b",
    "industrial": r"(?iU)\b(?:marketing|manufacturing|supply chain|e-commerce|corporate|fisheries|farmers|agricultur|tourism|hotel|service recovery|finance|policing|government document|news recommendation|geological|business|remote sensing|geospatial|archaeolog|smart cities|social media (?:marketing|consumer|brand|influencer))\b",
}
OFFTOPIC_TITLE = r"(?iU)\b(?:cardiology|orthodontic|dental|dentist|surgery|surgical|plastic surg|cancers?|tumou?rs?|oncol|cardio|cardiac|dermatol|ophthalm|gynecol|urol|perinat|neonat|anaesth|patholog|radiolog|pharma|drug discovery|food sector|food safety|food produc|food industry|crop|agriculture|manufacturing system|reconfigur|supply chain|inpatient|patients? care|clinical trials?|hospitals?|orthopaedic|anesth|tourism|hotel|marketing|remote sensing|archaeolog|geospatial|psychiatric diagnoses|smoking|hernia)\b"
OFFTOPIC_TOPIC = r"(?iU)\b(?:healthcare|medical|dental|orthodontic|manufacturing|traffic|power forecasting|service interactions|food|finance|market forecasting|patient|clinical|educational technology and pedagogy|technology-enhanced education studies|arabic language education studies|innovations in education and learning technologies)\b"
RETRACTED = r"(?iU)\bretracted\b|\[retracted\]|\bretraction\b"
LOW_QUALITY = r"(?iU)(?:https?://|download link|conference proceedings|lsdexception|unhidewhenused|semihidden|<w:)"
STRONG = ["research_writing", "integrity_governance", "scholarly_publishing"]
POSITIVE_OVERRIDE = {"research_writing": ["medical"], "scholarly_publishing": ["medical"]}
NEGATIVE_OVERRIDE = {"research_workflow": ["medical"], "integrity_governance": ["industrial"], "evidence_synthesis": ["medical"], "ai_literacy": ["medical", "language_learning"]}
YEARS, MIN_ABSTRACT, MIN_EMBED, THRESHOLD, FLOOR, CAP, STRONG_RELEVANCE = (2020, 2026), 50, 150, 0.25, 30, 200, 0.48
MANUAL_SOURCES = ["pubmed_manual", "wos_manual", "bibtex_manual", "scopus_pdf", "ris_manual"]


def _covered(found: Column, negatives: Column, table: Mapping[str, list[str]]) -> Column:
    """Whether any label found has a set in the table that holds all the negatives."""
    hit = F.lit(False)
    for label, allowed in table.items():
        hit |= F.array_contains(found, label) & (F.size(F.array_except(negatives, F.array(*map(F.lit, allowed)))) == 0)
    return hit


def screen(docs: DataFrame, positive: Mapping[str, str] = POSITIVE, ai: Mapping[str, str] = AI_SIGNALS, negative: Mapping[str, str] = NEGATIVE, years: tuple[int, int] | None = YEARS, strong: list[str] = STRONG, positive_override: Mapping[str, list[str]] = POSITIVE_OVERRIDE, negative_override: Mapping[str, list[str]] = NEGATIVE_OVERRIDE, offtopic: str | None = OFFTOPIC_TITLE) -> DataFrame:
    """Add decision, reason, positive_rules and negative_rules to docs (title, abstract, publication_year).

    The first that holds decides: retracted, missing or poor abstract, off-topic title, year out of
    range (a null year is none), no AI signal, no scope signal, negatives without positives,
    inclusion, positives that override the negatives, negatives that override, else review.  The
    reason of an inclusion is empty, and so are the rules of what is excluded before the scope.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    raw = F.coalesce(F.col("abstract"), F.lit(""))
    year = F.col("publication_year")
    outside = F.coalesce(~year.between(*years), F.lit(False)) if years else F.lit(False)
    # Cleaned once, as a column of its own; labels only of what no early rung has settled.
    d = docs.withColumn("_plain", T.clean_html(raw))
    early = F.when(T.any_match(title, RETRACTED), "retracted").when(F.length("_plain") < MIN_ABSTRACT, "missing_abstract").when(T.any_match(raw, LOW_QUALITY), "low_quality_abstract")
    early = early.when(T.any_match(title, offtopic) if offtopic else F.lit(False), "hard_offtopic_title").when(outside, "year_out_of_range")
    d = d.withColumn("_early", early).withColumn("_body", F.when(F.col("_early").isNull(), F.concat_ws(" ", title, "_plain")))
    labels = lambda table: F.when(F.col("_body").isNotNull(), T.matching_labels(F.col("_body"), table)).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_pos", labels(positive)).withColumn("_neg", labels(negative))
    has, against = F.size("_pos") > 0, F.size("_neg") > 0
    # Signals matter only where there is a scope.
    any_ai = F.coalesce(*(F.when(T.any_match(F.col("_body"), p), True) for p in ai.values()), F.lit(False))
    d = d.withColumn("_ai", F.when(has, any_ai).otherwise(False))
    strong_hit = F.arrays_overlap("_pos", F.array(*map(F.lit, strong)))
    ladder = [
        (F.col("_early").isNotNull(), "exclude", F.col("_early")),
        (has & ~F.col("_ai") & strong_hit, "needs_review", F.lit("no_ai_signal")),
        (has & ~F.col("_ai"), "exclude", F.lit("no_ai_signal")),
        (~has & ~against, "exclude", F.lit("no_scope_signal")),
        (~has, "exclude", F.concat(F.lit("hard_negative:"), F.array_join("_neg", "|"))),
        (~against, "include", F.lit("")),
        (_covered(F.col("_pos"), F.col("_neg"), positive_override), "include", F.lit("")),
        (_covered(F.col("_pos"), F.col("_neg"), negative_override), "exclude", F.concat(F.lit("hard_negative:"), F.array_join("_neg", "|"))),
    ]
    review = F.concat(F.lit("positive:"), F.array_join("_pos", "|"), F.lit("|negative:"), F.array_join("_neg", "|"))
    rung = lambda verdict, why: F.struct(F.lit(verdict).alias("decision"), why.alias("reason"))
    verdict = rung("needs_review", review)
    for test, decision, why in reversed(ladder):
        verdict = F.when(test, rung(decision, why)).otherwise(verdict)
    # By a generator, as a filter on what it makes stays above it: pushed below, it would hold each rule once for every rung that reads it.
    return d.select(*docs.columns, F.inline(F.array(verdict)), F.array_join("_pos", ",").alias("positive_rules"), F.array_join("_neg", ",").alias("negative_rules"))


def screened_corpus(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("decision").isin("include", "needs_review"))


def relevance(sem_positive: Column, sem_negative: Column, margin: Column, positive: Column, title_positive: Column, ai: Column, terms: Column, abstract_ok: Column, negative: Column, offtopic: Column) -> Column:
    """The hybrid index from 0 to 1, to four places; similarities from -1 to 1, null as -1."""
    unit = lambda c: F.least(F.greatest((F.coalesce(c, F.lit(-1.0)) + 1) / 2, F.lit(0.0)), F.lit(1.0))
    share = lambda c, cap: F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(float(cap))) / cap
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    index = 0.24 * unit(sem_positive) + 0.18 * F.least(F.greatest(F.coalesce(margin, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) + 0.24 * share(positive, 3) + 0.10 * share(title_positive, 2) + 0.08 * share(ai, 4) + 0.05 * share(terms, 6) + 0.05 * flag(abstract_ok)
    index = index - 0.22 * share(negative, 3) - 0.12 * unit(sem_negative) - 0.16 * flag(offtopic)
    return F.bround(F.least(F.greatest(index, F.lit(0.0)), F.lit(1.0)), 4)


def exclusion_reason(manual: Column, abstract_ok: Column, title_offtopic: Column, aligned: Column) -> Column:
    """Manual records with an abstract stay; else an off-topic title, no abstract and weak alignment, in this order."""
    return F.when(manual & abstract_ok, "").when(title_offtopic, "offtopic_title").when(~abstract_ok, "no_abstract").when(~aligned, "weak_domain_alignment").otherwise("")


def veto(offtopic: Column, title_hits: Column, relevance_index: Column) -> Column:
    """Off-topic records go unless title hits (labels, not empty) or a high index show a strong scope."""
    return offtopic & ~((F.coalesce(title_hits, F.lit("")) != "") | (F.coalesce(relevance_index, F.lit(0.0)) >= STRONG_RELEVANCE))


def audit(docs: DataFrame, text: str, flags: Mapping[str, str]) -> DataFrame:
    """One row per flag: how many texts match its pattern, and the percentage."""
    counts = docs.agg(F.count("*").alias("_n"), *(F.count_if(T.any_match(F.col(text), p)).alias(name) for name, p in flags.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("flag"), F.col(name).alias("n"), F.bround(100 * F.col(name) / F.greatest("_n", F.lit(1)), 2).alias("pct")) for name in flags))
    return counts.select(F.explode(rows).alias("r")).select("r.*")
