"""Substring dedup by repeated-phrase automata.

A passage recurs if a window of `window` words does.  The steps, each over the whole corpus:

1. Each distinct text names seeds, the least hashed phrase of PHRASE words in every window.  Equal
   windows name equal seeds, so only windows whose seed recurs can recur; a seventh of the words
   are seeds, and those are all that is counted.
2. Windows with a recurring seed are hashed; equal ones confirm a recurring window, and the least
   position owns it.  Runs of owned windows are passages.
3. Documents with a recurring seed are dealt into shards of bounded bytes, and each shard gets the
   passages around the seeds that its documents have.  A task compiles a shard's passages into an
   Aho-Corasick automaton over words, streams the shard's documents through it, and drops it.
   Nothing but the automata says where windows recur; occurrences are verified where they are found.

Text classes, positions and seeds are tables throughout.  No step pairs the occurrences of a
window or of a seed: shards and passages meet by their seeds, at most HEAVY of either for a seed;
where a seed has more of both, they meet by single windows.  Passages of over SHARD_BYTES in a
shard are cut into chunks with an automaton each, which meet all documents of the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bit_filter, durable, filter_bits, in_filter, numbered, parallelism, small_batches, stored

WINDOW, PHRASE = 20, 8
#: Bits of a position that count words within a text, of which no string has more; the rest number the texts.
START_BITS = 30
#: Bytes of texts in a shard, and of passages in an automaton.
TEXT_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: Passages and shards that may meet by one seed, the fewer of them; windows of a passage at most.
HEAVY, LONGEST = 64, 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2 to the 64th."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.n < n:
            self.n = max(n, 2 * self.n, 4096)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n - 1, self.base, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n - 1, self.inverse, np.uint64)]))
        return self.up[:n], self.down[:n]


_powers = [_Powers(b) for b in _BASES]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def run_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of each run of k words, the same wherever the run stands."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers[which].upto(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up)])
        return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + _M1)


def seeds(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its seed, and the hash of every phrase."""
    phrase = min(PHRASE, window)
    grams = run_hashes(hashes, phrase)
    if len(hashes) < window:
        return np.zeros(0, np.int64), grams
    view = np.lib.stride_tricks.sliding_window_view(grams, window - phrase + 1)
    return view.argmin(axis=1) + np.arange(len(view)), grams


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _survey(window: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(2):
                text = text.as_py()
                words = text.split()
                at, grams = seeds(word_hashes(words), window)
                found, counts = np.unique(grams[np.unique(at)] >> np.uint64(shift), return_counts=True)
                for column, value in zip(out, (hashlib.sha256(text).hexdigest(), len(words), hashlib.sha256(b" ".join(words)).hexdigest(), _signed(found), _signed(found[counts > 1])), strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), longs, longs), strict=True))], ["doc_id", "tag", "digest", "n_words", "whole", "seeds", "again"])

    return run


def _windows(window: int, shift: int):
    """96-bit hashes, positions and seeds of the windows whose seed is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out: list[tuple] = []
                for no, text, known in zip(*(part.column(i) for i in range(3)), strict=True):
                    hashes = word_hashes(text.as_py().split())
                    at, grams = seeds(hashes, window)
                    grams = grams >> np.uint64(shift)
                    known = np.sort(known.values.to_numpy().view(np.uint64))
                    places = np.unique(at)
                    recurs = np.zeros(len(grams), dtype=bool)
                    recurs[places] = known[np.minimum(np.searchsorted(known, grams[places]), len(known) - 1)] == grams[places]
                    start = np.nonzero(recurs[at])[0]
                    out.append((run_hashes(hashes, window)[start], run_hashes(hashes, window, 1)[start] >> np.uint64(32), (no.as_py() << START_BITS) + start, grams[at[start]]))
                high, low, position, seed = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(high)), pa.array(low.astype(np.uint32).view(np.int32)), pa.array(position.astype(np.int64)), pa.array(_signed(seed))], ["high", "low", "position", "seed"])

    return run


def _passages(window: int, longest: int):
    """The words of runs of owned windows, merged where they meet; each run is given by its first start and its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for shard, no, text, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = text.as_py().split()
                merged: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"]) for r in runs.as_py()):
                    if merged and first <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                for first, last in merged:
                    for a in range(first, last + 1, longest):
                        b = min(last, a + longest - 1)
                        out.append((shard.as_py(), (no.as_py() << START_BITS) + a, b" ".join(words[a : b + window])))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "position", "words"])

    return run


class Automaton:
    """Finds the windows of some passages in texts.

    A word is three letters, digits of its number to the base 128 from an alphabet for each place:
    nodes of the automaton keep few children, which it searches in turn, and a match can only
    begin at a word.
    """

    def __init__(self, passages: dict[int, bytes], window: int = WINDOW) -> None:
        self.window, self.block = window, (window + 1) // 2
        self.letters: dict[bytes, str] = {}
        self.trie = ahocorasick.Automaton()
        sizes, positions, hashes = [], [], []
        for position, text in passages.items():
            words = text.split()
            for w in words:
                if w not in self.letters:
                    # Beyond 2 to the 21st words share letters; verification tells them apart.
                    n = len(self.letters)
                    self.letters[w] = chr(256 + (n >> 14 & 127)) + chr(512 + (n >> 7 & 127)) + chr(768 + (n & 127))
            letters = self.spell(words)
            # Any window holds one of these blocks whole.
            for k in range(0, len(words) - self.block + 1, self.block):
                self.trie.add_word(letters[3 * k : 3 * (k + self.block)], True)
            sizes.append(len(words))
            positions.append(position)
            hashes += map(xxh64_intdigest, words)
        self.trie.make_automaton()
        # All passages' windows are hashed at once, but for those that reach into the next passage.
        sizes, hashes = np.array(sizes, dtype=np.int64), np.array(hashes, dtype=np.uint64)
        each = np.maximum(sizes - window + 1, 0)
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = np.repeat(np.cumsum(sizes) - sizes, each) + inner
        high = run_hashes(hashes, window)[at]
        order = np.argsort(high, kind="stable")
        self.high = high[order]
        self.low = run_hashes(hashes, window, 1)[at][order] >> np.uint64(32)
        self.where = (np.repeat(np.array(positions, dtype=np.int64), each) + inner)[order]

    def spell(self, words: list[bytes]) -> str:
        get = self.letters.get
        return "".join([get(w, "\0\0\0") for w in words])

    def covered(self, words: list[bytes], position: int) -> np.ndarray:
        """Which words windows cover that the passages own at another position; `position` is the text's own."""
        n, w, b = len(words), self.window, self.block
        none = np.zeros(n, dtype=bool)
        if n < w or not len(self.high):
            return none
        at = np.fromiter((e for e, _ in self.trie.iter(self.spell(words))), dtype=np.int64)
        if not len(at):
            return none
        at = (at + 1) // 3 - b
        # The windows that hold a block found whole start at most window - block words before it.
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, np.maximum(at - (w - b), 0), 1)
        np.add.at(steps, at + 1, -1)
        starts = np.nonzero(np.cumsum(steps[: n - w + 1]) > 0)[0]
        hashes = word_hashes(words)
        high, low = run_hashes(hashes, w)[starts], run_hashes(hashes, w, 1)[starts] >> np.uint64(32)
        place = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        hit = (self.high[place] == high) & (self.low[place] == low) & (self.where[place] != position + starts)
        ends = np.zeros(n + 1, np.int64)
        ends[starts[hit]] += 1
        ends[starts[hit] + w] -= 1
        return np.cumsum(ends[:-1]) > 0


def _kept(words: list[bytes], gone: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()


def _stream(window: int, whole: bool):
    """What goes of each document of a shard: n_removed and kept if it met all passages at once (`whole`), else the spans.

    Rows of kind 0 are passages and come first in a chunk of a shard, which has an automaton.
    """
    spans_of = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, automaton = None, {}, None
        for batch in batches:
            out = []
            for shard, chunk, kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if (shard, chunk) != now:
                    now, passages, automaton = (shard, chunk), {}, None
                if kind == 0:
                    passages[key] = text.as_py()
                    continue
                if passages:
                    automaton, passages = Automaton(passages, window), {}
                if automaton is None:
                    continue
                words = text.as_py().split()
                gone = automaton.covered(words, key << START_BITS)
                if n := int(gone.sum()):
                    edges = np.nonzero(np.diff(np.concatenate([[False], gone, [False]])))[0]
                    out.append((key, n, _kept(words, gone)) if whole else (key, edges))
            kinds = (pa.int64(), pa.int64(), pa.string()) if whole else (pa.int64(), spans_of)
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["no", "n_removed", "kept"] if whole else ["no", "spans"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_removed and kept of documents (no, text) whose spans (lists of edges) came from several automata."""
    for batch in batches:
        out = []
        for no, text, lists in zip(*(batch.column(i) for i in range(3)), strict=True):
            words = text.as_py().split()
            gone = np.zeros(len(words), dtype=bool)
            for edges in lists.as_py():
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    gone[a:b] = True
            out.append((no.as_py(), int(gone.sum()), _kept(words, gone)))
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["no", "n_removed", "kept"])


def shard_of(no: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(no), F.lit(shards))


def _spots(x: Column, bits: int) -> list[Column]:
    """Two bits of a hash, as `_in` finds them."""
    return [F.pmod(x, F.lit(bits)), F.pmod(F.shiftright(x, 13), F.lit(bits))]


def _in(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = 64 * len(words)
    return in_filter(words, x % bits, (x >> 13) % bits)


def _surveyed(rows: DataFrame, window: int, shift: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a tag for each text, their survey, and the classes of equal texts (tag, doc_id, digest)."""
    for salt in range(8):
        keyed = rows.withColumn("tag", F.xxhash64(F.lit(salt), "text"))
        survey = stored(keyed.select("doc_id", "tag", F.col("text").cast("binary").alias("text")).mapInArrow(_survey(window, shift), "doc_id long, tag long, digest string, n_words long, whole string, seeds array<bigint>, again array<bigint>"), "survey")
        classes = durable(survey.groupBy("tag").agg(F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"), F.max("digest").alias("other")))
        if classes.where("digest <> other").isEmpty():
            return keyed, survey, classes.drop("other")
    raise RuntimeError("unequal texts share a 64-bit hash under each of eight salts")


def _recurring_texts(keyed: DataFrame, survey: DataFrame, classes: DataFrame) -> DataFrame:
    """no, text and seeds of one text for each class that has seeds which recur, those seeds."""
    spark = keyed.sparkSession
    # A seed that a text has twice counts under the complement of the text's tag too; that tag is no text's row below.
    both = F.concat(F.transform("seeds", lambda x: F.struct(x.alias("seed"), F.col("tag").alias("tag"))), F.transform("again", lambda x: F.struct(x.alias("seed"), F.bitwise_not("tag").alias("tag"))))
    named = survey.select(F.explode(both).alias("s")).select("s.seed", "s.tag")
    recurring = stored(named.groupBy("seed").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a <> b").select("seed"), "seeds")
    # Most seeds recur nowhere: a filter of bounded size holds them back before the exact join.
    bits = filter_bits(recurring.count())
    sent = spark.sparkContext.broadcast(bit_filter(recurring, _spots(F.col("seed"), bits), bits))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            hit = _in(sent.value, flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)[hit]), pa.array(flat[hit])], ["tag", "seed"])

    shared = survey.select("tag", "seeds").mapInArrow(maybe, "tag long, seed long").join(recurring, "seed").groupBy("tag").agg(F.collect_set("seed").alias("seeds"))
    shared = stored(shared.join(classes, "tag"), "shared")
    tag_bits = filter_bits(shared.count())
    tags = spark.sparkContext.broadcast(bit_filter(shared, _spots(F.col("tag"), tag_bits), tag_bits))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(tags.value, batch.column(1).to_numpy())))

    some = keyed.select("doc_id", "tag", F.col("text").cast("binary").alias("text")).mapInArrow(picked, "doc_id long, tag long, text binary")
    texts = some.join(shared, "tag").where(F.col("doc_id").eqNullSafe(F.col("first")))
    if not survey.groupBy("tag", "doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["tag"])
    return stored(texts.select("no", "text", "seeds"), "recurring")


def _owned(windows: DataFrame) -> DataFrame:
    """The owner (least position) and seed of each window that recurs; partial aggregates meet, whatever recurs how often."""
    return windows.groupBy("high", "low").agg(F.min("position").alias("owner"), F.min("seed").alias("seed"), F.count("*").alias("n")).where("n > 1").drop("n")


def _routed(texts: DataFrame, window: int, shift: int, shards: int) -> DataFrame:
    """shard, no and runs (first, last) of the owned windows around the seeds that a shard's documents have."""
    mask = (1 << START_BITS) - 1
    schema = "high long, low int, position long, seed long"
    owned = _owned(texts.mapInArrow(_windows(window, shift), schema)).select(F.shiftright("owner", START_BITS).alias("no"), F.col("owner").bitwiseAND(mask).alias("start"), "seed")
    island = F.col("start") - F.row_number().over(Window.partitionBy("no", "seed").orderBy("start"))
    runs = stored(owned.withColumn("island", island).groupBy("no", "seed", "island").agg(F.min("start").alias("first"), F.max("start").alias("last")).drop("island"), "runs")
    has = stored(texts.select(shard_of(F.col("no"), shards).alias("shard"), F.explode("seeds").alias("seed")).distinct(), "has")
    heavy = runs.groupBy("seed").count().where(f"count > {HEAVY}").select("seed").join(has.groupBy("seed").count().where(f"count > {HEAVY}").select("seed"), "seed")
    heavy = durable(heavy)
    if heavy.isEmpty():
        routed = runs.join(has, "seed").select("shard", "no", "first", "last")
    else:
        routed = runs.join(heavy, "seed", "left_anti").join(has, "seed").select("shard", "no", "first", "last")
        own = texts.select("no", F.explode("seeds").alias("seed")).join(heavy, "seed").groupBy("no").agg(F.collect_list("seed").alias("seeds"))
        windows = texts.select("no", "text").join(own, "no").mapInArrow(_windows(window, shift), schema)
        met = windows.select("high", "low", shard_of(F.shiftright("position", START_BITS), shards).alias("shard")).join(_owned(windows).select("high", "low", "owner"), ["high", "low"])
        start = F.col("owner").bitwiseAND(mask)
        routed = routed.union(met.select("shard", "owner").distinct().select("shard", F.shiftright("owner", START_BITS), start, start))
    return routed.groupBy("shard", "no").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_sha256 (of the words kept, joined by one space).

    A word goes if it is in a window of `window` words of its document that also starts earlier: in
    a smaller doc_id, or earlier in the same document.  Needs doc_id and text; other columns are
    ignored.  A null text has no words.  Null doc_ids come last; rows with the same doc_id are
    ordered by a digest of their texts, and rows equal in both count once and get the same result.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Enough bits of a seed that few differ from all of theirs and yet meet; equal ones always do.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = 64 - min(62, max(32, int(size).bit_length() + 6))
    keyed, survey, classes = _surveyed(rows, window, shift)
    # In the order of doc_id (null last) and digest.
    numbers = numbered(classes, [F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest")], "no", 1 << (63 - START_BITS))
    classes = durable(numbers.select("tag", "no", F.col("doc_id").alias("first")))
    texts = _recurring_texts(keyed, survey, classes)
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * parallelism(spark), -(-held // TEXT_BYTES))
    routed = _routed(texts, window, shift, shards)
    passages = stored(routed.join(texts.select("no", "text"), "no").select("shard", "no", "text", "runs").mapInArrow(_passages(window, LONGEST), "shard long, position long, words binary"), "passages")
    large = durable(passages.groupBy("shard").agg(F.expr(f"sum(octet_length(words)) div {SHARD_BYTES} + 1").alias("chunks")).where("chunks > 1"))
    several = not large.isEmpty()
    sent = passages.select("shard", "position", "words").withColumn("chunks", F.lit(1).cast("long"))
    streamed = texts.select(shard_of(F.col("no"), shards).alias("shard"), "no", "text").withColumn("chunks", F.lit(1).cast("long"))
    if several:
        sent, streamed = (x.drop("chunks").join(large, "shard", "left").fillna(1, ["chunks"]) for x in (sent, streamed))
    stream = sent.select("shard", F.pmod(F.xxhash64("position"), "chunks").alias("chunk"), F.lit(0).alias("kind"), F.col("position").alias("key"), F.col("words").alias("text"))
    stream = stream.union(streamed.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)), F.lit(1), "no", "text"))
    stream = stream.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "kind")
    if several:
        spans = stream.mapInArrow(_stream(window, False), "no long, spans array<bigint>").groupBy("no").agg(F.collect_list("spans").alias("lists"))
        cut = durable(texts.select("no", "text").join(spans, "no").mapInArrow(_cut, "no long, n_removed long, kept string"))
    else:
        cut = durable(stream.mapInArrow(_stream(window, True), "no long, n_removed long, kept string"))
    results = classes.join(cut, "no", "left").drop("no")
    out = survey.select("doc_id", "tag", "n_words", "whole").join(results, "tag")
    copy = ~F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("n_words") >= window)
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", "whole"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


SQL = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM d),
    k AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW} - 1], ' ') AS k FROM p),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM r WHERE n > 1),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN g USING (doc_id, i) GROUP BY 1)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN s USING (doc_id)"""
