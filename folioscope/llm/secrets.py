"""Secret scans: rules propose candidates, a random forest removes the false positives.

The forest sees a candidate's length, its character transitions, how much of it dictionary words
cover, its path and its neighbouring words.  It is trained from labelled findings.  The dictionary
is the commonest words of all documents, beside fixed words of placeholders.  Where no labelled
findings are given, they are planted: passages of a bounded sample of the documents get a line
with a credential of one of the forms that the rules look for, or with what they mistake for one
(placeholders, template variables, checksums, words, names of settings), the rules run over them,
and a finding is a secret if it overlaps a planted credential.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: name, substrings of the lower-case text of which one must be there, pattern; its last group is the candidate.
RULES = [
    ("aws_key", ("akia", "asia"), re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("code_host_token", ("ghp_", "gho_", "ghs_", "ghu_", "glpat-"), re.compile(r"(?<![A-Za-z0-9])((?:gh[opsu]_|glpat-)[A-Za-z0-9_-]{20,})")),
    ("chat_token", ("xoxb-", "xoxp-", "xoxa-"), re.compile(r"(?<![A-Za-z0-9])(xox[abp]-[A-Za-z0-9-]{10,})")),
    ("api_secret", ("sk-", "sk_live", "rk_live"), re.compile(r"(?<![A-Za-z0-9])((?:sk-|[sr]k_live_)[A-Za-z0-9_-]{16,})")),
    ("web_token", ("eyj",), re.compile(r"(?<![A-Za-z0-9])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    ("url_password", ("://",), re.compile(r"(?<=[a-z0-9+.-])://[^\s:/@]+:([^\s/@]{4,})@")),
    ("assignment", ("token", "secret", "passw", "pwd", "key", "credential"), re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|passwor[dt]|passwd|pwd|api_?-?key|access_?-?key|private_?-?key|credentials?)[\"']?\s*(?:=|:=|:)\s*[\"'`]?([^\s\"'`,;]{8,})")),
]
BEGIN, END, CLOSE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), "-----END", re.compile(r"-----END[A-Z0-9 ]*(?:-----)?")

#: Fixed words: parts of values that people type, of sample paths, and of passages about samples or checksums.
DICTIONARY = "password secret token example sample test testing dummy placeholder change changeme default your here insert replace value key access admin user guest login client server service account database config local host public private super master root hello world welcome qwerty letmein the and for with this that from enter real fake mock demo temp none null true false string name".split()
SAMPLE_PATHS = "test tests example examples sample samples fixture fixtures mock mocks doc docs demo template spec readme".split()
SAMPLE_WORDS = "example sample placeholder dummy fake your replace insert e.g. like template default here demo".split()
HASH_WORDS = "sha1 sha256 md5 checksum digest hash commit etag uuid integrity revision".split()
CRED_WORDS = "token secret password passwd pwd key credential credentials auth login bearer".split()
#: Words on each side that are a candidate's neighbours.
NEAR = 4
#: Commonest words of the corpus in the dictionary, letters of a word at least, and documents that findings are planted in, each at most.
DICTIONARY_WORDS, WORD_LETTERS, PLANTED = 20_000, 4, 1_500

SCHEMA = "doc_id long, rule string, start long, end long, candidate_sha256 string, score double, is_secret boolean"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """start, end and rule of all candidates, which may overlap; earlier and then longer ones first."""
    lower = text.lower()
    found = [(m.start(m.lastindex), -m.end(m.lastindex), name) for name, needles, pattern in RULES if any(n in lower for n in needles) for m in pattern.finditer(text)]
    if "-----begin" in lower:
        for m in BEGIN.finditer(text):
            stop = text.find(END, m.end())
            if stop < 0:
                break  # nor has any later one an end
            found.append((m.start(), -CLOSE.match(text, stop).end(), "private_key"))
    spans: dict[tuple[int, int], str] = {}
    for start, stop, name in sorted(found):
        spans.setdefault((start, -stop), name)
    return [(*span, name) for span, name in spans.items()]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class Dictionary:
    """Tells which characters of a value words of at least WORD_LETTERS letters cover."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted({w for w in [*words, *DICTIONARY] if len(w) >= WORD_LETTERS})
        self.trie = ahocorasick.Automaton()
        for w in self.words:
            self.trie.add_word(w, len(w))
        self.trie.make_automaton()

    def __reduce__(self) -> tuple:
        return Dictionary, (self.words,)

    def covered(self, lower: str) -> float:
        steps = np.zeros(len(lower) + 1, dtype=np.int64)
        for end, size in self.trie.iter(lower):
            steps[end + 1 - size] += 1
            steps[end + 1] -= 1
        return float((np.cumsum(steps[:-1]) > 0).mean()) if lower else 0.0


def corpus_words(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest words (runs of letters, lower case) of all whole texts; the driver gets `most` of them.

    Words are counted by the size of their count first, in sixteenths of a power of two, so that
    only those that may be among the commonest are sent to be ordered, however many tasks there are.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(rf"\p{{L}}{{{WORD_LETTERS},}}"), F.lit(0))).alias("word"))
    counts = stored(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    size = F.floor(F.log2("n") * 16).cast("int")
    level, held = 0, 0
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # some hundred rows
        level, held = r["size"], held + r["count"]
        if held >= most:
            break
    return [r["word"] for r in counts.where(size >= level).orderBy(F.desc("n"), "word").limit(most).collect()]


def neighbours(text: str, start: int, end: int) -> tuple[str, str]:
    """NEAR words before and after a span, joined by spaces."""
    size = 64
    while len(before := text[max(0, start - size) : start].split()) <= NEAR and size < start:
        size *= 2
    size = 64
    while len(after := text[end : end + size].split()) <= NEAR and size < len(text) - end:
        size *= 2
    return " ".join(before[-NEAR:]), " ".join(after[:NEAR])


def features(value: str, path: str, before: str, after: str, dictionary: Dictionary | None = None) -> list[float]:
    """The forest's inputs, in the order of FEATURES."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = np.unique(list(value), return_counts=True)[1] / max(1, len(value))
    steps = list(zip(kinds, kinds[1:], strict=False))
    moves = [0] * 16
    for a, b in steps:
        moves[4 * a + b] += 1
    share = [m / max(1, len(steps)) for m in moves]
    codes = [ord(c) for c in value]
    near = sum(abs(a - b) <= 1 for a, b in zip(codes, codes[1:], strict=False)) / max(1, n - 1)
    pairs = [value[i : i + 2] for i in range(len(value) - 1)]
    vowels = sum(p[0] in "aeiou" and p[1] in string.ascii_lowercase and p[1] not in "aeiou" for p in (x.lower() for x in pairs)) / max(1, len(pairs))
    lower = value.lower()
    names = set(re.findall(r"[a-z]+", path.lower()))
    left, right = re.findall(r"[^\s=:\"'`()<>,;]+", before.lower())[-NEAR:], re.findall(r"[^\s=:\"'`()<>,;]+", after.lower())[:NEAR]
    around = left + right
    has = lambda words: float(any(w in x for x in around for w in words))
    return [
        math.log1p(n), float(-(counts * np.log2(counts)).sum()) if n else 0.0, len(set(pairs)) / max(1, len(pairs)), near, vowels,
        *(kinds.count(k) / max(1, len(kinds)) for k in range(4)), *(share[k] for k in (1, 2, 4, 6, 8, 9)), sum(a == b for a, b in steps) / max(1, len(steps)),
        (dictionary or Dictionary([])).covered(lower), float(bool(re.search(r"[$%{}<>*]|x{4}|\.{3}|^\(", lower))), float(all(c in "0123456789abcdef" for c in lower)),
        float(bool(names & set(SAMPLE_PATHS))), has(SAMPLE_WORDS), has(HASH_WORDS), float(any(w in x for x in left for w in CRED_WORDS)),
    ]


FEATURES = "length entropy distinct_pairs near_codes vowel_pairs lower upper digit other lower_upper lower_digit upper_lower upper_digit digit_lower digit_upper same_kind dictionary template hex sample_path sample_words hash_words credential_words".split()


def _line(rng: np.random.Generator, secret: bool) -> tuple[str, str, bool]:
    """A line with a credential or with what is mistaken for one, the value in it, and whether its path is one of samples."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda chars, k: "".join(rng.choice(list(chars), k))
    hexa, base, capitals = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    name = pick(["token", "api_key", "secret", "password", "access_key", "client_secret", "db_password", "auth_token"])
    given = lambda value: f"{name}{pick(['=', ': ', ' = '])}{pick(QUOTES)}".replace("~", value)
    if secret:
        value = pick([
            lambda: draw(hexa, pick([16, 18, 20, 24, 32, 40, 40, 48, 64])), lambda: draw(base, int(rng.integers(16, 64))), *[lambda: "AKIA" + draw(capitals, 16)] * 3, lambda: "ghp_" + draw(base, 36), lambda: "sk-" + draw(base, 40),
            lambda: "xoxb-" + draw(string.digits, 11) + "-" + draw(base, 24), lambda: "eyJ" + draw(base, 20) + "." + draw(base, 40) + "." + draw(base, 43), lambda: draw(base + "!#%&+-_", int(rng.integers(10, 24))),
            lambda: "-----BEGIN PRIVATE KEY-----\n" + draw(base + "+/", 400) + "\n-----END PRIVATE KEY-----",
        ])()
        known = value[:4] in ("AKIA", "ghp_", "xoxb") or value[:3] in ("sk-", "eyJ", "---")
        url = f"postgres://{pick(['app', 'root', 'svc'])}:~@db/main".replace("~", value)
        return (value if known and rng.random() < 0.4 else url if not known and rng.random() < 0.1 else given(value)), value, rng.random() < 0.1
    samples = rng.random() < 0.3
    made = "".join(pick(SYLLABLES) for _ in range(int(rng.integers(5, 12))))
    kind = int(rng.integers(0, 9))
    if kind == 0:
        value = "".join(pick(["_", "-", ""]) + pick(DICTIONARY) for _ in range(int(rng.integers(2, 5)))).strip("_-").ljust(8, "1")
    elif kind == 1:
        value = pick(["x", "X", "*", "0", "a", "1"]) * int(rng.integers(8, 41))
    elif kind == 2:
        value = pick(["${%s}", "<%s>", "{{%s}}", "%%%s%%", "$(%s)"]) % (pick(DICTIONARY) + "_" + name)
    elif kind == 3:
        value = (hexa * 4)[: int(rng.integers(8, 40))] if rng.random() < 0.5 else ("abcdefghijklmnopqrstuvwxyz" * 2)[: int(rng.integers(8, 40))]
    elif kind == 4:
        value = draw(hexa, pick([32, 40, 64]))
        return f"{pick(HASH_WORDS)} {pick(HASH_WORDS)} {given(value)}", value, samples
    elif kind == 5:
        value = pick(["os.environ", "config.get", "settings.value", "process.env.", "self.read"]) + pick(["(", ".", "["]) + name
    elif kind == 6:
        value = draw(base, 24)
        return f"{pick(SAMPLE_WORDS)} {pick(SAMPLE_WORDS)} {given(value)}", value, True
    elif kind == 7:
        value = "AKIA" + "".join(pick(["EXAMPLE", "SAMPLE", "FAKE", "TEST", "DUMMY"]) for _ in range(4))[:16].ljust(16, "X")
    else:
        value = made + pick([".", "!", ""])
    return given(value), value, samples


QUOTES = ['"~"', "'~'", "~ "]
#: Common pairs and triples of letters that made-up words are put together from.
SYLLABLES = "er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def planted_findings(passages: list[tuple[str, str]], seed: int = 11) -> list[tuple[str, str, str, str, bool]]:
    """value, path, words before and after, and is_secret of what the rules find of a line planted in each passage (text, path)."""
    rng = np.random.default_rng(seed)
    out = []
    for k, (passage, path) in enumerate(passages):
        line, value, samples = _line(rng, k % 2 == 0)
        words = passage.split()
        at = int(rng.integers(0, len(words) + 1))
        text = " ".join([*words[:at], line, *words[at:]])
        start = text.index(line, len(" ".join(words[:at]))) + line.index(value)
        where = f"{SAMPLE_PATHS[int(rng.integers(len(SAMPLE_PATHS)))]}/{path}" if samples else path
        for a, b, _ in candidates(text):
            if a < start + len(value) and b > start:
                out.append((text[a:b], where, *neighbours(text, a, b), k % 2 == 0))
    return out


def sampled_passages(docs: DataFrame, path: str = "source", held: bool = False, rows: int = PLANTED, words: int = 24) -> list[tuple[str, str]]:
    """Passages of `words` words, from anywhere in the texts of at most `rows` documents, and their paths.

    The documents are those of the smallest digests below a level that about twice `rows` reach;
    with `held`, of those whose crc32(doc_id) mod 4 is 2, else of the others.
    """
    given = F.col(path).cast("string") if path in docs.columns else F.lit("")
    ours = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    rows_of = docs.where(ours if held else ~ours).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(given, F.lit("")).alias("path"), F.col("doc_id"))
    rows_of = rows_of.where("text <> ''").withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    n = rows_of.agg(F.approx_count_distinct("h")).first()[0]
    level = min((1 << 63) - 1, (1 << 64) * (2 * rows + 64) // max(1, n) - (1 << 63))
    cut = F.split(F.trim("text"), r"\s+")
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("w") - words + 1)).cast("int") + 1
    some = rows_of.where(F.col("h") <= level).withColumn("w", cut).select("h", F.array_join(F.slice("w", start, words), " ").alias("passage"), "path").distinct()
    return [(r["passage"], r["path"]) for r in some.orderBy("h", "passage", "path").limit(rows).collect()]


@dataclasses.dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, children and the leaf's share of secrets."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    threshold: float = 0.5
    dictionary: Dictionary = dataclasses.field(default_factory=lambda: Dictionary([]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while len(go := np.nonzero(self.feature[at] >= 0)[0]):
                node = at[go]
                at[go] = np.where(x[go, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[at]
        return total / len(self.roots)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 10, least: int = 2, seed: int = 5) -> Forest:
    """Trees on bootstrap samples; each split looks at a random square root of the features."""
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    roots = []
    tries = max(2, round(math.sqrt(x.shape[1])))

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        ones, n = float(y[rows].sum()), len(rows)
        if level == depth or n < 2 * least or ones in (0.0, n):
            return me
        best: tuple[float, int, float] | None = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            fit = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
            if not fit.any():
                continue
            p, q = c[:-1] / k, (ones - c[:-1]) / (n - k)
            loss = np.where(fit, k * p * (1 - p) + (n - k) * q * (1 - q), np.inf)
            j = int(loss.argmin())
            if best is None or loss[j] < best[0]:
                best = (float(loss[j]), int(f), float((v[j] + v[j + 1]) / 2))
        if best is None:
            return me
        goes = x[rows, best[1]] <= best[2]
        if goes.all() or not goes.any():
            return me
        a, b = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
        nodes[me][:4] = [best[1], best[2], a, b]
        return me

    for _ in range(trees):
        roots.append(grow(rng.integers(0, len(y), len(y)), 0))
    feature, cut, left, right, value = zip(*nodes, strict=True)
    return Forest(np.array(feature, dtype=np.int64), np.array(cut), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value), np.array(roots))


def train_forest(findings: list[tuple[str, str, str, str, bool]] | DataFrame, dictionary: Dictionary | None = None, limit: int = 20_000) -> Forest:
    """Fit on labelled findings (value, path, before, after, is_secret), of a DataFrame at most `limit` rows."""
    if isinstance(findings, DataFrame):
        rows = findings.select("value", "path", "before", "after", "is_secret").where("value is not null and is_secret is not null")
        findings = [tuple(r) for r in rows.orderBy(F.xxhash64("value", "path", "before", "after"), "value").limit(limit).collect()]
    dictionary = dictionary or Dictionary([])
    x = np.array([features(v, p or "", b or "", a or "", dictionary) for v, p, b, a, _ in findings])
    return dataclasses.replace(fit_forest(x, np.array([bool(f[4]) for f in findings], dtype=np.float64)), dictionary=dictionary)


def trained_on(docs: DataFrame, path: str = "source") -> Forest:
    """The forest for docs: their words for a dictionary, findings planted in passages of PLANTED documents, twice in each."""
    passages = sampled_passages(docs, path) or [("", "")]
    while len(passages) < PLANTED:
        passages = passages * 2
    return train_forest(planted_findings(passages, 11) + planted_findings(passages, 12), Dictionary(corpus_words(docs)))


def judge(forest: Forest, text: str, path: str) -> list[tuple[int, int, str, float]]:
    """start, end, rule and score of each candidate of a text, but for those within a confirmed one."""
    out: list[tuple[int, int, str, float]] = []
    last = 0
    for a, b, rule in candidates(text):
        if b > last:
            score = float(forest.scores(np.array([features(text[a:b], path, *neighbours(text, a, b), forest.dictionary)]))[0])
            out.append((a, b, rule, score))
            last = b if score >= forest.threshold else last
    return out


def scan(docs: DataFrame, forest: Forest | None = None, path: str = "source") -> DataFrame:
    """One row per candidate that isn't within a confirmed one: doc_id, rule, start, end (characters), candidate_sha256, score, is_secret.

    Needs doc_id and text; the column `path` counts as empty where it is missing or null, others
    are ignored.  A null or empty text has no candidates.  A null doc_id stays null; equal rows
    give equal findings each.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest or trained_on(docs, path))
    given = F.col(path).cast("string") if path in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            out = []
            for doc, text, path in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                for a, b, rule, score in judge(forest, text, path.as_py()):
                    out.append((doc.as_py(), rule, a, b, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), score, score >= forest.threshold))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], "doc_id rule start end candidate_sha256 score is_secret".split())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(given, F.lit("")).alias("path"))
    return rows.mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, forest: Forest | None = None, path: str = "source") -> DataFrame:
    """docs with each confirmed secret replaced by [REDACTED:rule]; n_chars follows where it is there.

    Needs text; the column `path` counts as empty where it is missing or null.  All rows stay, and
    all columns but text and n_chars unchanged, whatever their names.  Texts without secrets stay
    as they are, null and empty ones too; texts are scanned whole; equal rows give equal rows; an
    empty table gives none.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest or trained_on(docs, path))

    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for text, where in zip(texts, paths, strict=True):
            hits = [h for h in judge(sent.value, text, where) if h[3] >= sent.value.threshold]
            parts, last = [], 0
            for a, b, rule, _ in hits:
                if a >= last:
                    parts += [text[last:a], f"[REDACTED:{rule}]"]
                last = b  # of secrets that overlap in part, the first one's mark stands for all
            out.append("".join([*parts, text[last:]]) if hits else None)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "paths": pd.Series, "return": pd.Series}
    given = F.col("d").getField(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.select(F.struct("*").alias("d"))
    rows = rows.select("d", F.pandas_udf(run, "string")(F.coalesce(F.col("d.text").cast("string"), F.lit("")), F.coalesce(given, F.lit(""))).alias("t"))
    changed = {"text": F.coalesce("t", F.col("d.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("t").isNull(), F.col("d.n_chars")).otherwise(F.length("t").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(changed.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns))
