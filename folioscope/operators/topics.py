"""Class-based TF-IDF topics and token profiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T

#: English function words that topics leave out.
STOPWORDS = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()


def tokens(docs: DataFrame, text: str, group: str, pattern: str = r"[a-zA-Z][a-zA-Z\-]{2,}", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """group and words, the lower-case tokens of each text without stopwords, in order."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({pattern})"), F.lit(1)), lambda w: ~w.isin(*stopwords))
    return docs.select(F.col(group).alias("group"), words.alias("words"))


def ngrams(words, sizes: Sequence[int] = (2, 3)):
    """Runs of words joined by spaces; fewer words than a size give none.  Each size grows from the one before by one word."""
    none = F.array().cast("array<string>")
    out, runs = [], words
    for n in range(2, max(sizes) + 1):
        longer = F.zip_with(runs, F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda run, word: F.concat(run, F.lit(" "), word))
        # The lists end together but for the words that have no run's start; their rests are null.
        runs = F.filter(longer, lambda x: x.isNotNull())
        if n in sizes:
            out.append(F.coalesce(runs, none))
    return F.concat(*out)


def phrase_counts(tokens: DataFrame, sizes: Sequence[int] = (2, 3), most: int = 400_000) -> DataFrame:
    """group, phrase and n of tokens (group, words): runs of words, counted in each task as far as `most` different ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = {}, 0
        for batch in batches:
            for group, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = line.split("\n") if line else []
                counts = found.setdefault(group, Counter())
                held -= len(counts)
                for n in sizes:
                    counts.update(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
                held += len(counts)
                if held >= most:
                    yield from rows(found)
                    found, held = {}, 0
        yield from rows(found)

    def rows(found: dict) -> Iterator[pa.RecordBatch]:
        for group, counts in found.items():
            phrases, n = list(counts), list(counts.values())
            for k in range(0, len(n), 20_000):
                part = n[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(part), kind), pa.array(phrases[k : k + 20_000], pa.string()), pa.array(part, pa.int64())], ["group", "phrase", "n"])

    kind = to_arrow_type(tokens.schema["group"].dataType)
    # One string of a text goes to Python much faster than a list; no token holds a line's end.
    return tokens.select("group", F.array_join("words", "\n")).mapInArrow(run, f"group {tokens.schema['group'].dataType.simpleString()}, phrase string, n long")


def class_tfidf(docs: DataFrame, text: str, group: str, max_share: float = 0.8, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """group, phrase, tf, df and score: each group is one document; phrases in over max_share of the groups go; idf = ln((1 + n) / (1 + df)) + 1.

    The texts are read and cut once, and phrases travel once: counts of a task are dealt out by phrase, so that
    tf and df are both found where they arrive.
    """
    known = docs.where(F.col(group).isNotNull())
    tf = phrase_counts(tokens(known, text, group), sizes).repartition("phrase").groupBy("group", "phrase").agg(F.sum("n").alias("tf"))
    n = known.agg(F.count_distinct(group).alias("_n"))
    d = tf.withColumn("df", F.count("*").over(Window.partitionBy("phrase"))).crossJoin(F.broadcast(n)).where(F.col("df") <= F.col("_n") * max_share)
    return d.withColumn("score", F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1)).select("group", "phrase", "tf", "df", "score")


def topics(docs: DataFrame, text: str, group: str, candidates: int = 30, n: int = 5, stoplist: Sequence[str] = (), bad: Sequence[str] = ()) -> DataFrame:
    """group and phrases: the best-scored valid phrases, chosen greedily so that they share few tokens."""
    scored = class_tfidf(docs, text, group).where(T.phrase_is_valid(F.col("phrase"), stoplist, bad, tidy=True))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "phrase"))).where(F.col("r") <= candidates)
    ordered = best.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "phrase"))), lambda s: s["phrase"]).alias("p"))
    return ordered.select("group", F.transform(T.select_phrases(F.col("p"), n), T.cluster_phrase).alias("phrases"))


def token_counts(docs: DataFrame, text: str, group: str, k: int = 15, pattern: str = r"\b[a-z]{4,}\b", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """The k most frequent tokens of each group."""
    t = tokens(docs, text, group, pattern, stopwords).select("group", F.explode("words").alias("token")).groupBy("group", "token").agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "token"))).where(F.col("rank") <= k)
