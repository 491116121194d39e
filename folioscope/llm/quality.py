"""Quality rules as a ledger of failure bits that versioned policies read.

Every rule is evaluated once for each text: `ledger` stores what was measured and one word of
failure bits.  A policy is a pair of masks and a tolerance over those bits, so a new version of it,
or a trial without one of its rules (`ablations`), reads the stored bits and never a text.  All of
it is DataFrame functions; a text is measured within its row, by sorting, so there is no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: What counts as a symbol.
SYMBOLS = "[#*$%&|<>]"
#: The rest of a word from its first letter, so one match for each word with a letter.
LETTER_WORD = r"\p{L}[^\x20\x09-\x0D]*+"
#: Low bits of a packed window are its place, the others come from its hash.
PLACE_BITS = 31


@dataclass(frozen=True)
class Rule:
    """A named bit and the condition over the measurements under which it is set, in words that Spark's and DuckDB's SQL share."""

    name: str
    bit: int
    fails: str


#: Bits keep their meaning for good: a changed rule takes a new bit, so old ledgers and policies stay readable.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "word_chars < 3 * n_words"),
    Rule("long_words", 5, "word_chars > 10 * n_words"),
    Rule("words_without_letters", 6, "10 * n_letter_words < 8 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")


def mask(*names: str, rules: Sequence[Rule] = RULES) -> int:
    """The bits of the rules named, all rules' if none is."""
    known = {r.name: 1 << r.bit for r in rules}
    return reduce(int.__or__, (known[n] for n in names or known), 0)


@dataclass(frozen=True)
class Policy:
    """Rejects what fails a rule of `hard`, or more than `tolerance` rules of `soft`."""

    version: int
    hard: int
    soft: int = 0
    tolerance: int = 0


#: What every policy rejects, and the versions so far; the last one is in force.
BASE = mask("few_words", "repeated_words")
POLICIES = (
    Policy(1, BASE | mask("symbols", "repeated_lines")),
    Policy(2, BASE | mask("symbols", "repeated_lines", "words_without_letters"), mask("short_words", "long_words"), 0),
)


def repeated_windows(word: str, size: int = 3) -> list[tuple[str, Column]]:
    """Steps, each a column over the ones before, whose last, n_repeat_words, is the number of words within windows that occur twice or more.

    Where hashes of windows repeat, their bits are sorted with the places packed below, neighbours that agree are
    sorted again by their words, so equal hashes of other words count for nothing, and the places
    that remain are swept in order.
    """
    at = lambda i: [F.element_at(word, (i + k).cast("int")) for k in range(size)]
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def beside(name: str, same):
        """Whether an entry is the same as the one before or after it in the sorted column."""
        n = F.size(name)
        return lambda x, k: F.when(k > 0, same(x, F.element_at(name, F.greatest(k, F.lit(1))))).otherwise(False) | F.when(k < n - 1, same(x, F.element_at(name, F.least(k + 2, n)))).otherwise(False)

    hashes = F.when(F.size(word) >= size, F.transform(F.sequence(F.lit(1), F.size(word) - (size - 1)), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))
    packed = F.sort_array(F.transform("_windows", lambda x, k: F.shiftleft(x, PLACE_BITS).bitwiseOR((k + 1).cast("long"))))
    some = F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), packed).otherwise(F.array().cast("array<bigint>"))
    agreeing = F.transform(F.filter("_hashes", beside("_hashes", lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS))), place)
    spelt = F.array_sort(F.transform("_agreeing", lambda i: F.struct(F.array(*at(i)).alias("w"), i.alias("i"))))
    places = F.array_sort(F.transform(F.filter("_spelt", beside("_spelt", lambda x, y: x["w"] == y["w"])), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    sweep = F.aggregate("_places", start, lambda a, i: F.struct((i + size).alias("end"), (a["n"] + i + size - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    return [("_windows", hashes), ("_hashes", some), ("_agreeing", agreeing), ("_spelt", spelt), ("_places", places), ("n_repeat_words", sweep)]


def measured(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and MEASURES of each row's whole text.

    n_words and word_chars (code points in words), n_symbols, n_lines and n_dup_lines (lines with a
    word, and those equal to an earlier one), n_repeat_words (words in three-word windows found
    twice or more), n_letter_words (words with a letter).  A null text measures as an empty one,
    which has none of anything.  Rows stay as they are, repeated ones and null keys included; other
    columns are left out, so their names can't clash.
    """
    d = docs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.withColumns({"_words": F.regexp_extract_all("_text", F.lit(WORD), 0), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))})
    d = d.select(
        *(f"_k{i}" for i in range(len(keys))), "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit(LETTER_WORD)).cast("long").alias("n_letter_words"),
    )
    for name, column in repeated_windows("_words"):
        d = d.withColumn(name, column)
    return d.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *MEASURES)


def ledger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """keys, MEASURES and failed, a long with the bit of each rule that the text fails; a row for each document, awkward ones as `measured` says."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return measured(docs, keys, text).withColumn("failed", reduce(Column.bitwiseOR, bits, F.lit(0).cast("long")))


def rejects(policy: Policy, failed: Column) -> Column:
    """Whether the policy rejects what failed so; null bits are rejected by none."""
    bits = F.coalesce(failed, F.lit(0).cast("long"))
    return (bits.bitwiseAND(F.lit(policy.hard)) != 0) | (F.bit_count(bits.bitwiseAND(F.lit(policy.soft))) > policy.tolerance)


def applied(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Add kept_v<version> for each policy, and sole_failure: the bit that alone is set, null where none or several are."""
    bits = F.coalesce(F.col("failed"), F.lit(0).cast("long"))
    sole = F.when(F.bit_count(bits) == 1, F.bit_count(bits - 1).cast("int"))
    return rows.withColumns({f"kept_v{p.version}": ~rejects(p, F.col("failed")) for p in policies} | {"sole_failure": sole})


def ablations(rows: DataFrame, policy: Policy = POLICIES[-1], rules: Sequence[Rule] = RULES, within: Sequence[str] = ()) -> DataFrame:
    """within, rule, n (documents), n_failed (the rule), n_kept (by the policy) and n_regained (kept by the policy without the rule, and not with it).

    One aggregate over the failure bits, with a count for each rule; no text is read again and
    nothing is ordered.  Without rows there is no group and so no row, but for no `within` at all.
    """
    own = [r for r in rules if (policy.hard | policy.soft) >> r.bit & 1]
    columns = []
    for r in own:
        less = Policy(policy.version, policy.hard & ~(1 << r.bit), policy.soft & ~(1 << r.bit), policy.tolerance)
        failed = F.col("failed").bitwiseAND(F.lit(1 << r.bit)) != 0
        columns += [F.count_if(failed).alias(f"_f{r.bit}"), F.count_if(rejects(policy, F.col("failed")) & ~rejects(less, F.col("failed"))).alias(f"_g{r.bit}")]
    d = rows.groupBy(*within).agg(F.count("*").alias("n"), F.count_if(~rejects(policy, F.col("failed"))).alias("n_kept"), *columns)
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"_f{r.bit}").alias("n_failed"), F.col(f"_g{r.bit}").alias("n_regained")) for r in own))
    return d.select(*within, "n", "n_kept", F.explode(each).alias("r")).select(*within, "r.rule", "n", "r.n_failed", "n_kept", "r.n_regained")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts, base_failed, kept (by the policy in force), the ledger's bits and the verdict of every version."""
    d = applied(ledger(docs))
    base = d["failed"].bitwiseAND(F.lit(BASE)) != 0
    return d.withColumns({"base_failed": base, "kept": ~base & F.col(f"kept_v{POLICIES[-1].version}")})


def sql() -> str:
    """The same rows from DuckDB; windows are counted over rows there."""
    failed = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    gone = lambda p: f"(failed & {p.hard}) <> 0 OR bit_count(CAST(failed & {p.soft} AS BIGINT)) > {p.tolerance}"
    kept = ", ".join(f"NOT ({gone(p)}) AS kept_v{p.version}" for p in POLICIES)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
    f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
    p AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS j FROM f, range(3) t(k)) GROUP BY 1),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words FROM s LEFT JOIN p USING (r)),
    b AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m),
    v AS (SELECT *, {kept}, CASE WHEN bit_count(failed) = 1 THEN CAST(log2(failed) AS INTEGER) END AS sole_failure, (failed & {BASE}) <> 0 AS base_failed FROM b)
    SELECT *, NOT base_failed AND kept_v{POLICIES[-1].version} AS kept FROM v"""
