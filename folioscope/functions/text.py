"""Scalar text functions, each from columns to a column.

Patterns are Java's with (?iU) where a rule ignores case, so that accented capitals, Unicode word
boundaries and \\w agree with what scholarly text needs.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Journal names with a spelling of their own, and acronyms that title case spoils.
JOURNALS = {
    "plos one": "PLOS ONE",
    "plos medicine": "PLOS Medicine",
    "plos biology": "PLOS Biology",
    "plos pathogens": "PLOS Pathogens",
    "plos neglected tropical diseases": "PLOS Neglected Tropical Diseases",
    "plos computational biology": "PLOS Computational Biology",
    "bmj open": "BMJ Open",
    "bmj": "BMJ",
    "npj digital medicine": "NPJ Digital Medicine",
}
ACRONYMS = "Ieee Acm Bmj Plos Jmir Njm Nejm Jama Who Npj Mdpi Ijms Embo Nih Fda Eu Uk Us".split()
SHORT_ACRONYMS = "Ieee Acm Bmj Plos Jmir".split()

#: Keyword aliases by lower-case form.
KEYWORD_ALIASES = {
    "artificial intelligence": "Artificial Intelligence",
    "ai": "Artificial Intelligence",
    "artificial intelligence (ai)": "Artificial Intelligence",
    "llm": "Large Language Models",
    "llms": "Large Language Models",
    "large language model": "Large Language Models",
    "large language models.": "Large Language Models",
    "large language models (llm)": "Large Language Models",
    "large language models (llms)": "Large Language Models",
    "large language model(llm)": "Large Language Models",
    "large language model (llm)": "Large Language Models",
    "chatgpt; large language models (llms)": "Large Language Models",
    "generative ai": "Generative AI",
    "generative artificial intelligence": "Generative AI",
    "gen ai": "Generative AI",
    "nlp": "Natural Language Processing",
    "natural language processing (nlp)": "Natural Language Processing",
    "systematic reviews": "Systematic Review",
    "chatgpt": "ChatGPT",
}

#: Keywords too broad to count.
KEYWORD_STOPWORDS = [
    "computer science", "psychology", "mathematics", "mathematics education", "context (archaeology)", "relevance (law)", "field (mathematics)",
    "process (computing)", "cognitive science", "transformative learning", "perception", "generative grammar", "reading (process)",
    "context", "field", "process", "relevance", "history", "politics", "sociology", "philosophy",
]

#: What marks a keyword as noise; fragments, tokens and lone words that name no cluster.
CLUSTER_NOISE = r"(?i)conflict|publication of this article|to influence the work reported in this paper|https?://|<w:"
CLUSTER_STOPLIST = [
    "artificial intelligence", "machine learning", "deep learning", "large language model", "large language models", "generative ai", "systematic review", "literature review", "scoping review", "narrative review",
    "sensitivity specificity", "pooled sensitivity", "area curve", "curve auc", "pubmed embase", "future directions", "chatgpt", "humans",
]
CLUSTER_BAD_TOKENS = ["review", "reviews", "study", "studies", "article", "articles", "paper", "papers"]
LONE_WORDS = ["artificial", "intelligence", "machine", "learning", "deep", "language", "large", "model", "models", "humans", "review", "research", "systematic", "literature"]

#: Country codes to repair.
COUNTRY_FIXES = {"LE": "LB"}
NULLS = ["", "nan", "none", "null", "[]"]


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def blank_to_null(text: Column) -> Column:
    """The three ways in which text can be missing, as null."""
    return F.when(~F.lower(F.trim(text)).isin(*NULLS), text)


def clean_html(text: Column) -> Column:
    """Without tags and a leading 'Abstract'; trimmed."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(plain, r"(?i)^Abstract[\s:]+", ""), r"^\s+|\s+$", "")


def norm_doi(doi: Column) -> Column:
    """Bare lower-case DOI: one prefix removed."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(doi, F.lit("")))), r"^(https://doi\.org/|http://doi\.org/|doi:)", "")


def bare_doi(doi: Column) -> Column:
    """As norm_doi, but prefixes are removed as often as they are there."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(doi, F.lit("")))), r"^(?:https://doi\.org/|http://doi\.org/|doi:)+", "")


def title_key(title: Column) -> Column:
    """Lower case, trimmed."""
    return F.lower(F.trim(F.coalesce(title, F.lit(""))))


def norm_title(title: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+", " "))


def plain_title(title: Column) -> Column:
    """As norm_title, with punctuation as white space."""
    return norm_title(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)[^\w\s]", " "))


def title_case(text: Column) -> Column:
    """A capital after every character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def restore_acronyms(text: Column, names: Sequence[str] = ACRONYMS) -> Column:
    for name in names:
        text = F.regexp_replace(text, rf"\b{name}\b", name.upper())
    return text


def journal_name(name: Column) -> Column:
    """One spelling for each journal: own forms, else title case with acronyms restored."""
    lower = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    return F.coalesce(lookup(lower, JOURNALS), restore_acronyms(title_case(lower)))


def journal_label(name: Column) -> Column:
    """The shorter rule of the cluster tables: title case and a few acronyms."""
    return restore_acronyms(title_case(F.trim(F.coalesce(name, F.lit("")))), SHORT_ACRONYMS)


def any_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def matching_labels(text: Column, rules: Mapping[str, str]) -> Column:
    """Labels of the rules that match, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(any_match(text, p), F.lit(label)) for label, p in rules.items())))


def _tokens(pattern: str) -> list[str]:
    return re.findall(r"\\.|\[(?:\\.|[^\]])+\]|.", pattern, re.S)


def _alternatives(pattern: str) -> list[str]:
    """A pattern cut at the bars that stand in no group or class."""
    depth, parts = 0, [""]
    for token in _tokens(pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    return parts


def _first_group(pattern: str) -> tuple[str, str]:
    """What a pattern's first group holds, and what follows it."""
    depth, inside = 0, ""
    for token in _tokens(pattern):
        depth += (token == "(") - (token == ")")
        inside += token
        if not depth:
            break
    return inside.removeprefix("(?:")[:-1], pattern[len(inside) :]


def _openings(pattern: str, most: int) -> list[str] | None:
    """Letters, blanks and hyphens, up to `most`, with one of which each match of a pattern begins; None if that can't be seen from it."""
    out: list[str] = []
    for part in _alternatives(pattern):
        if part.startswith("(?:"):
            inside, after = _first_group(part)
            found = None if after[:1] in ("?", "*", "{") else _openings(inside, most)
        else:
            opening = re.match(r"[\w -]*", part)[0]
            after = part[len(opening) :]
            if opening and after.startswith("?"):
                short, whole = (_openings(o + after[1:], most) for o in (opening[:-1], opening))
                found = short and whole and short + whole
            else:
                # The last one need not be there before these.
                opening = opening[:-1] if after[:1] in ("*", "{") else opening
                found = [opening[:most]] if opening else None
        if found is None:
            return None
        out += found
    return out


def _tree(openings: set[str]) -> str:
    """A pattern for the shortest of the openings that a text goes on with, alternatives by their first letter."""
    by: dict[str, set[str]] = {}
    for o in sorted(openings):
        by.setdefault(o[0], set()).add(o[1:])
    return "(?:" + "|".join(c + ("" if "" in rest else _tree(rest)) for c, rest in by.items()) + ")"


class Opened:
    """Rules that are tried only on texts in which one of their openings stands at a word's edge.

    Most rules are lists of phrases, and most texts hold few of them.  One pattern of all rules' openings reads the text
    once (`found`); a rule that has openings then reads only what it may match.  It decides alone, so no result
    depends on the openings.  Rules of another shape read every text.
    """

    HEAD = r"(?iU)\b"

    def __init__(self, *tables: Mapping[str, str], most: int = 24) -> None:
        self.most = most
        self.of: dict[str, set[str]] = {}
        for pattern in {p for table in tables for p in table.values()}:
            inner = pattern.removeprefix(self.HEAD)
            if inner != pattern and len(_alternatives(inner)) == 1 and (openings := _openings(inner, most)):
                self.of[pattern] = {o if "İ" in o else o.lower() for o in openings}  # two characters in lower case
        self.all = {o for openings in self.of.values() for o in openings}

    def found(self, text: Column) -> Column:
        """Where openings stand, what the text goes on with there, a line each and each once; a column to be kept, as every rule reads it."""
        if not self.all:
            return F.lit("")
        return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(f"{self.HEAD}(?=({_tree(self.all)}.{{0,{self.most}}}))"), F.lit(1))), "\n")

    def any_match(self, text: Column, found: Column, pattern: str) -> Column:
        if pattern not in self.of:
            return any_match(text, pattern)
        return F.when(found.rlike(f"(?iUm)^{_tree(self.of[pattern])}"), any_match(text, pattern)).otherwise(False)

    def matching_labels(self, text: Column, found: Column, rules: Mapping[str, str]) -> Column:
        return F.array_compact(F.array(*(F.when(self.any_match(text, found, p), F.lit(label)) for label, p in rules.items())))


def first_label(text: Column, rules: Mapping[str, str], default: str) -> Column:
    return F.coalesce(*(F.when(any_match(text, p), F.lit(label)) for label, p in rules.items()), F.lit(default))


def pipe_join(values: Column) -> Column:
    """Sorted distinct non-empty values joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))), "|")


def count_labels(joined: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(joined, F.lit("")), r"\|"), lambda x: x != ""))


def display_names(items: Column, limit: int = 8) -> Column:
    """Distinct names of an array of structs with display_name, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: x["display_name"]), lambda x: x.isNotNull() & (x != ""))), 1, limit)


def keyword_terms(text: Column, stopwords: Sequence[str] = KEYWORD_STOPWORDS, separators: str = r"\|") -> Column:
    """Keywords of delimited text: trimmed, without stopwords (any case), distinct (by case), in order."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: (x != "") & ~F.lower(x).isin(*stopwords)))


def cluster_terms(text: Column, noise: str | None = None) -> Column:
    """Keywords as cluster profiles count them: cut at | and ;, lower case, 4 to 80 characters, repeats kept."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"[|;]"), lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^\*+", ""), r"\s+", " "))
    fits = lambda x: (F.length(x) > 3) & (F.length(x) <= 80)
    return F.filter(items, lambda x: fits(x) if noise is None else fits(x) & ~x.rlike(noise))


def canonical_keyword(keyword: Column) -> Column:
    """The alias of a keyword, null where it has none."""
    return lookup(F.lower(keyword), KEYWORD_ALIASES)


def countries(text: Column, strict: bool = True) -> Column:
    """Country codes of delimited text; strict ones are upper-cased and must be two letters."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.upper(F.trim(x)) if strict else F.trim(x))
    items = F.transform(items, lambda x: F.coalesce(lookup(x, COUNTRY_FIXES), x))
    return F.filter(items, lambda x: x.rlike("^[A-Z]{2}$") if strict else x != "")


def plain_authors(text: Column) -> Column:
    """Authors of text delimited by ;, else by ' and ', else by |, else one name."""
    text = F.coalesce(text, F.lit(""))
    cut = F.when(F.instr(text, ";") > 0, F.split(text, ";")).when(F.instr(text, " and ") > 0, F.split(text, " and ")).when(F.instr(text, "|") > 0, F.split(text, r"\|")).otherwise(F.array(text))
    tidy = F.transform(cut, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ ,;{}]+|[ ,;{}]+$", ""))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def nested_authors(items: Column) -> Column:
    """name, institution and country of an array of authorship structs."""
    named = F.transform(items, lambda x: F.struct(x["author"]["display_name"].alias("name"), F.try_element_at(F.transform(x["institutions"], lambda i: i["display_name"]), F.lit(1)).alias("institution"), F.try_element_at(F.transform(x["institutions"], lambda i: i["country_code"]), F.lit(1)).alias("country")))
    return F.filter(named, lambda x: x["name"].isNotNull() & (x["name"] != ""))


def literal_list(text: Column, schema: str) -> Column:
    """A list written as a Python literal or as JSON, parsed without evaluation; null if it is neither."""
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(json, schema, {"allowSingleQuotes": "true"})


def as_bool(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("", "0", "false", "no", "off", "nan", "none")


def as_number(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def as_int(value: Column, default: int | None = 0) -> Column:
    number = F.floor(as_number(value)).cast("long")
    return number if default is None else F.coalesce(number, F.lit(default).cast("long"))


def year_prefix(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4})", 1).try_cast("int")


def year_anywhere(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4})", 1).try_cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def unescape(text: Column) -> Column:
    """The common entities; & last, so that nothing is unescaped twice."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def context(text: Column, pattern: str, around: int) -> Column:
    """position (from 1) and surroundings of a pattern's first match; position 0 and null where there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.struct(at.alias("position"), F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around))).alias("context"))


def clean_source(source: Column) -> Column:
    return F.when(F.lower(F.trim(source)).isin(*NULLS) | source.isNull(), "unknown").otherwise(F.trim(source))


def capped(value: Column, cap: float) -> Column:
    """From 0 to 1: the value's part of cap."""
    return F.least(F.greatest(F.coalesce(as_number(value), F.lit(0.0)), F.lit(0.0)), F.lit(float(cap))) / cap


def month_name(date: Column, names: Sequence[str]) -> Column:
    """Day, month by name and year, as in '3 de maio de 2024'."""
    return F.concat(F.dayofmonth(date), F.lit(" de "), F.element_at(F.array(*map(F.lit, names)), F.month(date)), F.lit(" de "), F.year(date))


def axis_lines(text: Column) -> Column:
    """axis, mean and min of lines such as 'Axis E: mean=0.76 min=0.68 [..]', negative numbers too."""
    lines = F.regexp_extract_all(text, F.lit(r"(Axis \w: *mean=-?[\d.]+ +min=-?[\d.]+)"), F.lit(1))
    number = lambda x, name: F.regexp_extract(x, rf"{name}=(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"Axis (\w)", 1).alias("axis"), number(x, "mean").alias("mean"), number(x, "min").alias("min")))


#: Portuguese months.
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
#: Cluster phrases spelled on their own and acronyms in them.
PHRASES = {"internet things": "Internet of Things", "end life": "End of Life", "point care": "Point of Care", "state art": "State of the Art"}
PHRASE_ACRONYMS = {"Ai": "AI", "Iot": "IoT", "Llm": "LLM", "Llms": "LLMs", "Mri": "MRI", "Ct": "CT", "Aigc": "AIGC", "Nlp": "NLP"}


def cluster_phrase(phrase: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))
    text = title_case(phrase)
    for source, target in PHRASE_ACRONYMS.items():
        text = F.regexp_replace(text, rf"\b{source}\b", target)
    return F.coalesce(lookup(key, PHRASES), text)


def phrase_is_valid(phrase: Column, stoplist: Sequence[str] = (), bad: Sequence[str] = (), tidy: bool = False) -> Column:
    """At least four characters and none of the given fragments, tokens or filler words; tidy phrases are in lower case with single spaces."""
    key = phrase if tidy else F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))
    valid = F.length(key) >= 4
    for fragment in (*stoplist, " using ", " based on ", " et al", "this "):
        valid &= F.instr(key, fragment) == 0
    return valid & ~F.arrays_overlap(F.split(key, " "), F.array(*map(F.lit, bad))) if bad else valid


def select_phrases(candidates: Column, n: int = 5) -> Column:
    """Greedy choice of an ordered array: a phrase goes if its tokens are known or all but one are, at least two."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(state: Column, phrase: Column) -> Column:
        tokens = F.array_distinct(F.split(phrase, " "))
        shared = F.size(F.array_intersect(tokens, state["seen"]))
        known = (F.size(state["kept"]) > 0) & ((shared == F.size(tokens)) | (shared >= F.greatest(F.lit(2), F.size(tokens) - 1)))
        skip = F.array_contains(state["kept"], phrase) | known | (F.size(state["kept"]) >= n)
        grown = F.struct(F.array_append(state["kept"], phrase).alias("kept"), F.array_union(state["seen"], tokens).alias("seen"))
        return F.when(skip, state).otherwise(grown)

    return F.aggregate(candidates, start, step, lambda s: s["kept"])
