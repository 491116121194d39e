"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its words' hashed subwords, and a linear softmax over
that mean gives the language.  Both layers are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows.  A temperature fitted on rows set aside calibrates
the probabilities.

The softmax has one class more than there are languages, for text of none of them: its passages
are scrambled ones of the sample, and subwords that no row of a language has speak for it.  A text's
score is the probability of its best language, so that class takes from it.  The rejection
threshold is the level that loses a stated part of the right answers among rows set aside, or,
where most strangers stay below that, half way to them in log-odds; few words tell less than many,
so short, middling and long texts have one each.  Strangers are scrambled passages, and those of
each of a few languages under a model that hasn't learnt it.  The weight of unseen subwords is
that under which strangers fall farthest below these levels.

Both layers are linear, so their product gives each subword one score per language, and each
distinct word is scored once for the texts that hold it.
"""

from __future__ import annotations

import dataclasses
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

LETTER = regex.compile(r"\p{L}")
ORDERS = (1, 2, 3, 4)
#: Words above this many characters are cut into pieces of it before subwords are taken.
PIECE = 48
#: Labelled rows that the model is fitted on at most: of each language, and of all together (but one of each language at least).
ROWS, SAMPLE = 400, 40_000
SNIPPETS = ((4, 3), (3, 12), (2, 60), (2, 200))
#: Scores of distinct words remembered before the memory is emptied, and characters of texts taken at a time.
MEMO_SCORES, CHUNK = 2_000_000, 1_000_000
#: Part of the right answers that may be lost; languages left out in turn to make strangers.
LOSE, FOLDS = 0.001, 4
#: The part of the strangers that a threshold is held against.
OTHERS = 0.95
#: Weights of unseen subwords that are tried.
UNSEEN = (0.0, 25.0, 50.0, 100.0, 200.0, 400.0)
#: Words from which on a text is middling, and long.
LENGTHS = (8, 40)


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every subword of each word, and the number of the word that it is from."""
    pieces, owners = [], []
    for k, word in enumerate(words):
        for start in range(0, len(word), PIECE):
            pieces.append(f"<{word[start : start + PIECE]}>")
            owners.append(k)
    if not pieces:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    owner = np.asarray(owners)
    found, whose = [], []
    rolling = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            break
        rolling = rolling[:n] * np.uint64(0x100000001B3) + codes[order - 1 :]
        if order in ORDERS:
            at = np.nonzero(piece[:n] == piece[order - 1 :])[0]
            mixed = (rolling[at] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(33)) % np.uint64(buckets))
            whose.append(owner[piece[at]])
    found.append(np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in pieces), dtype=np.uint64, count=len(pieces)))
    whose.append(owner)
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


@dataclasses.dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x classes (the languages, then none of them): embeddings times weights
    bias: np.ndarray
    temperature: float = 1.0
    thresholds: tuple[float, ...] = (0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self._memo: dict[str, int] = {}
        self._most = max(10_000, MEMO_SCORES // max(1, len(self.bias)))
        self._sums = np.zeros((1024, len(self.bias)))
        self._sizes = np.zeros(1024)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _learn(self, words: Iterable[str]) -> None:
        new = sorted(words)
        at = len(self._memo)
        need = at + len(new)
        if need > len(self._sizes):
            more = max(need, 2 * len(self._sizes)) - len(self._sizes)
            self._sums = np.concatenate([self._sums, np.zeros((more, len(self.bias)))])
            self._sizes = np.concatenate([self._sizes, np.zeros(more)])
        for start in range(0, len(new), 5_000):
            part = new[start : start + 5_000]
            bucket, owner = subwords(part, len(self.scores))
            place = slice(at + start, at + start + len(part))
            self._sizes[place] = np.bincount(owner, minlength=len(part))
            for k in range(len(self.bias)):
                self._sums[place, k] = np.bincount(owner, weights=self.scores[bucket, k], minlength=len(part))
        self._memo.update((w, at + k) for k, w in enumerate(new))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        start = 0
        while start < len(texts):
            split: list[list[str]] = []
            size = 0
            for text in texts[start:]:
                split.append(text.lower().split() if text else [])
                size += len(text or "")
                if size >= CHUNK:
                    break
            distinct = set().union(*split)
            new = distinct - self._memo.keys()
            if new and len(self._memo) > self._most:
                self._memo.clear()
                new = distinct
            self._learn(new)
            for k, words in enumerate(split, start):
                if words:
                    at = np.fromiter(map(self._memo.__getitem__, words), dtype=np.int64, count=len(words))
                    out[k] += self._sums[at].sum(axis=0) / self._sizes[at].sum()
            start += len(split)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """The language, its calibrated probability and whether it is rejected; und, 0 and True for a text without letters."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        p = softmax(self.logits(texts) / self.temperature)[:, : len(self.languages)]
        best = p.argmax(axis=1)
        known = [bool(t) and LETTER.search(t) is not None for t in texts]
        scores = np.where(known, p.max(axis=1), 0.0)
        rejected = [not k or s < self.thresholds[_length(t)] for t, k, s in zip(texts, known, scores.tolist(), strict=True)]
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], scores, rejected


def _length(text: str) -> int:
    """0 for a short text, 1 for a middling one, 2 for a long one."""
    words = len(text.split(None, LENGTHS[-1]))
    return sum(words >= n for n in LENGTHS)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def snippets(text: str, rng: np.random.Generator) -> Iterator[str]:
    """Passages of several lengths from anywhere in the text."""
    words = text.split()
    for n, length in SNIPPETS:
        for _ in range(n):
            start = int(rng.integers(0, max(1, len(words) - length + 1)))
            yield " ".join(words[start : start + length])


def scrambled(text: str, rng: np.random.Generator) -> str:
    """Text of no language: the letters of a passage in any order, or words of letters drawn at will."""
    if rng.random() < 0.5:
        letters = np.array(list(text))
        rng.shuffle(letters)
        return "".join(letters)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return " ".join("".join(rng.choice(letters, int(rng.integers(3, 16)))) for _ in text.split())


class Bags:
    """The distinct buckets of each of many passages and how often it has them, in three flat arrays."""

    def __init__(self, texts: list[str], buckets: int, part: int = 64) -> None:
        ids, counts, sizes = [], [], []
        for start in range(0, len(texts), part):
            words = [t.lower().split() for t in texts[start : start + part]]
            found, owner = subwords([w for ws in words for w in ws], buckets)
            whose = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
            keys, n = np.unique(whose[owner] * buckets + found, return_counts=True)
            ids.append((keys % buckets).astype(np.int32))
            counts.append(n.astype(np.int32))
            sizes.append(np.bincount(keys // buckets, minlength=len(words)))
        self.ids = np.concatenate(ids or [np.zeros(0, np.int32)])
        self.counts = np.concatenate(counts or [np.zeros(0, np.int32)])
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))]).tolist()

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[k], self.ends[k + 1])
        return self.ids[part], self.counts[part]


def _descend(bags: Bags, y: np.ndarray, rows: np.ndarray, classes: int, buckets: int, size: int, epochs: int, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Scores (buckets x classes) and biases after gradient descent over the rows."""
    embeddings, weights, bias = (rng.random((buckets, size), dtype=np.float32) - np.float32(0.5)) * np.float32(2 / size), np.zeros((classes, size), np.float32), np.zeros(classes, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(rows):
            ids, counts = bags[k]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ embeddings[ids]
            error = softmax(weights @ hidden + bias)
            error[y[k]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = error @ weights
            weights -= step * np.outer(error, hidden)
            bias -= np.float32(0.1) * step * error
            embeddings[ids] -= np.outer(share * (step * np.float32(len(ids) ** 0.5)), back)
            done += 1
    return embeddings @ weights.T, bias.astype(np.float64)


def fit(texts: list[str], labels: list[str], held: np.ndarray, buckets: int | None = None, size: int = 16, epochs: int = 4, rate: float = 0.8, lose: float = LOSE, folds: int = FOLDS, seed: int = 7) -> Model:
    """Train on the texts not held, calibrate and set the thresholds on those held and on strangers."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(languages)}
    none = len(languages)
    if buckets is None:  # few enough share a bucket that unseen subwords show; the scores of many languages take less room
        buckets = 1 << max(15, min(18, int(np.log2((1 << 22) / (none + 1)))))
    every = max(2, min(8, none))  # about as many scrambled passages as a language has
    odd = [k for k in range(len(texts)) if texts[k].split() and k % every == 0]
    texts, held = texts + [scrambled(texts[k], rng) for k in odd], np.concatenate([held, held[odd]])
    y = np.array([number[x] for x in labels] + [none] * len(odd))
    bags = Bags(texts, buckets)
    train = np.array([k for k in range(len(texts)) if not held[k] and len(bags[k][0])], dtype=np.int64)
    model = Model(languages, *_descend(bags, y, train, none + 1, buckets, size, epochs, rate, rng))
    check = np.array([k for k in range(len(texts)) if held[k] and LETTER.search(texts[k])], dtype=np.int64)

    def unseen(rows: np.ndarray) -> np.ndarray:
        seen = np.zeros(buckets, dtype=bool)
        for k in rows[y[rows] != none]:
            seen[bags[k][0]] = True
        return ~seen

    def new_share(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
        return np.array([bags[k][1][new[bags[k][0]]].sum() / max(1, bags[k][1].sum()) for k in rows])

    if not len(check):
        return model
    raw, truth, new = model.logits([texts[k] for k in check]), y[check], unseen(train)
    loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(check)), truth], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    sizes = np.array([_length(texts[k]) for k in check])
    groups = [(raw, new_share(check, new), truth == none, sizes, np.zeros(0, np.int64))]
    for out in range(0, none if none > 1 else 0, -(-none // folds)):
        # Two epochs on a third of the rows tell how sure a model is of a language that it hasn't met.
        others = train[y[train] != out]
        apart = Model(languages, *_descend(bags, y, others[rng.random(len(others)) < 1 / 3], none + 1, buckets, size, 2, rate, rng))
        met = check[truth == out]
        if len(met):
            groups.append((apart.logits([texts[k] for k in met]), new_share(met, unseen(others)), np.ones(len(met), dtype=bool), sizes[truth == out], np.array([out])))

    def levels(weight: float) -> tuple[float, tuple[float, ...]]:
        """By how much, in the mean, strangers fall below the thresholds if unseen subwords have this weight; the thresholds."""
        sure, right, strange, length = [], [], [], []
        for k, (logits, share, strangers, words, gone) in enumerate(groups):
            at = logits.copy()
            at[:, none] += weight * share
            p = np.delete(softmax(at / model.temperature)[:, :none], gone, axis=1)
            sure.append(p.max(axis=1))
            right.append(p.argmax(axis=1) == truth if k == 0 else np.zeros(len(p), dtype=bool))
            strange.append(strangers)
            length.append(words)
        sure, right, strange, length = (np.concatenate(x) for x in (sure, right, strange, length))
        cuts = []
        for k in range(len(LENGTHS) + 1):
            good, odd_ones = (np.sort(np.log(x / (1 - x))) for x in (np.clip(sure[some & (length == k)], 1e-12, 1 - 1e-12) for some in (right & ~strange, strange)))
            cut = good[int(lose * len(good))] if len(good) else -np.inf
            if len(odd_ones) and (far := odd_ones[min(len(odd_ones) - 1, int(OTHERS * len(odd_ones)))]) < cut:
                cut = (cut + far) / 2
            cuts.append(float(1 / (1 + np.exp(-cut))))  # what scores below it is rejected
        return float((np.array(cuts)[length] - sure)[strange].mean()) if strange.any() else 0.0, tuple(cuts)

    weight = max(UNSEEN, key=lambda w: (levels(w)[0], -w))
    model.scores[new, none] += weight
    model.thresholds = levels(weight)[1]
    return model


def crc_mod(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def sampled_passages(docs: DataFrame, rows: int = ROWS, sample: int = SAMPLE) -> DataFrame | None:
    """h, lang and passage of at most `rows` rows for each language, and `sample` in all but one for each; None without a labelled row.

    Only rows with text and lang whose crc32(doc_id) mod 4 is not 2 are used.  The rows are those
    of the smallest digests of doc_id and text, equal rows once, so the bound holds for ids that
    repeat or are missing.  An approximate count of each language's digests first gives a level of
    the digest below which about twice `rows` lie; only such digests leave the executors, and so
    no task gathers a language.  The texts stay there: passages of bounded length, drawn from
    anywhere in the whole texts of the chosen rows, are all that is sent.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null").where(crc_mod(F.col("doc_id")) != 2)
    labelled = labelled.select("text", "lang", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("h"))
    counts = dict(labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect())  # a row for each language
    if not counts:
        return None
    rows = max(1, min(rows, sample // len(counts)))
    whole = 1 << 64
    levels = [(lang, min(whole, whole * (2 * rows + 64) // max(1, n)) - (1 << 63) - 1) for lang, n in counts.items()]
    levels = spark.createDataFrame([(lang, min(x, (1 << 63) - 1)) for lang, x in levels], "lang string, level long")
    near = labelled.select("lang", "h").join(F.broadcast(levels), "lang").where("h <= level").select("lang", "h").distinct().collect()  # about 2 x rows for each language
    chosen: dict[str, list[int]] = {}
    for r in near:
        chosen.setdefault(r["lang"], []).append(r["h"])
    chosen = {lang: sorted(hs)[:rows] for lang, hs in chosen.items()}
    wanted = spark.createDataFrame([(lang, h) for lang, hs in chosen.items() for h in hs], "lang string, h long")  # `sample` rows at most, or one a language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out += [(h, lang, s) for s in snippets(text, np.random.default_rng(h & 0x7FFFFFFF))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.string(), pa.string()), strict=True)], ["h", "lang", "passage"])

    return labelled.join(F.broadcast(wanted), ["lang", "h"]).select("h", "text", "lang").mapInArrow(cut, "h long, lang string, passage string").distinct()


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    model = fit([p for _, _, p in found], [lang for _, lang, _ in found], np.array([(h & 0xFFFF) % 5 == 0 for h, _, _ in found], dtype=bool))
    out = pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    del found, model
    give_back()
    yield out


def train(docs: DataFrame, rows: int = ROWS, sample: int = SAMPLE) -> Model:
    """Fit on the passages of at most `rows` rows for each language, and at most `sample` in all but one for each.

    Every language of the labelled rows is learnt.  A task fits the model, 11 passages for each
    row at most, and the driver only passes it on.
    """
    passages = sampled_passages(docs, rows, sample)
    if passages is None:
        return fit([], [], np.zeros(0, dtype=bool))
    return pickle.loads(passages.coalesce(1).mapInArrow(_fitted, "model binary").first()["model"])


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """A struct (lang_pred, score, rejected) for the column `text` of docs."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        values = [t if isinstance(t, str) else None for t in texts]
        languages, scores, rejected = sent.value.predict(values)
        return pd.DataFrame({"lang_pred": languages, "score": scores, "rejected": rejected})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lang_pred string, score double, rejected boolean")(text.cast("string"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every whole text.

    Needs doc_id and text, and lang where no model is given; other columns are ignored.  A null
    text, or one without letters, is `und` with score 0 and rejected; so is every text where
    nothing is labelled.  A null doc_id counts as the empty string.  Equal texts get equal
    answers; an empty table gives no rows.
    """
    model = train(docs) if model is None else model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predicted(docs, model, F.col("text")).alias("p"))
    return rows.select("doc_id", (crc_mod(F.col("doc_id")) == 2).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose language isn't rejected, all columns unchanged whatever their names.

    Needs text, and doc_id and lang where no model is given.  Null, empty and white texts and
    those without letters are rejected, and so is every text where nothing is labelled.  Texts are
    judged whole; equal rows stay or go together; an empty table gives no rows.
    """
    model = train(docs) if model is None else model
    rows = docs.select(F.struct("*").alias("d"))
    return rows.select("d", predicted(docs, model, F.col("d.text")).alias("p")).where("not p.rejected").select("d.*")
