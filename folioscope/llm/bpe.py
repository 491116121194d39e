"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are merged one at a time.  Pairs that can merge wait in buckets, one for each merge
rank, that hold linked-list positions; a bitmap of several levels says which buckets hold any, so
the next rank comes from a few find-first-set steps rather than a heap of all pairs.  Entries
whose pair has changed since are skipped when they come up.  A pre-token of n bytes costs
O(n log n) at worst (the log for the order within a bucket), however long it is.

Short pre-tokens that a batch of documents holds for the first time share one queue over one
linked list: a bucket is then taken whole, one position for each pre-token at a time, in numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Pre-tokens of more bytes aren't remembered; the memory of shorter ones is emptied when full;
#: characters whose pre-tokens are held at a time.
MEMO_BYTES, MEMO_ENTRIES, CHUNK = 64, 1_000_000, 4_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Buckets of positions by rank; `pop` gives the lowest rank and in it the lowest position.

    Two bitmap levels of 256-bit words, so 65,536 ranks need a top word of 256 bits; a larger
    vocabulary has a longer top word.
    """

    __slots__ = ("buckets", "low", "top")

    BITS = [1 << i for i in range(256)]

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.low[word] |= self.BITS[rank & 255]
        self.top |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        if not (top := self.top):
            return None
        word = (top & -top).bit_length() - 1
        low = self.low[word]
        rank = (word << 8) + (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[word] = low = low & (low - 1)
        if not low:
            self.top = top & (top - 1)
        return rank, bucket[0]

    def pop_bucket(self) -> tuple[int, np.ndarray]:
        """The lowest rank with all its positions, in no order."""
        word = (self.top & -self.top).bit_length() - 1
        low = self.low[word]
        rank = (word << 8) + (low & -low).bit_length() - 1
        self.low[word] = low = low & (low - 1)
        if not low:
            self.top &= self.top - 1
        return rank, np.array(self.buckets.pop(rank), dtype=np.int64)


class Codec:
    """Encoder and decoder for one vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.memo: dict[str, bytes] = {}
        width = self.width = len(self.pieces)
        pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                if (a := ranks.get(piece[:cut])) is not None and (b := ranks.get(piece[cut:])) is not None:
                    pairs[a * width + b] = rank
        self.pair_keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.pair_ranks = np.array([pairs.get(k, -1) for k in self.pair_keys.tolist()], dtype=np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    @classmethod
    def from_bytes(cls, file: bytes, pattern: str) -> Codec:
        rows = (line.split() for line in file.splitlines() if line.strip())
        return cls({base64.b64decode(piece): int(rank) for piece, rank in rows}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The token ids of one pre-token."""
        get, push, pop, longest = self.ranks.get, self.queue.push, self.queue.pop, self.longest
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # start of the next part; n ends the list
        before = list(range(-1, n - 1))
        # The rank of the pair that starts at each place, -1 if there is none or it was merged away.
        waiting = [get(piece[i : i + 2], -1) for i in range(n)]
        if n:
            waiting[-1] = -1
        for i, rank in enumerate(waiting):
            if rank >= 0:
                push(rank, i)
        while (top := pop()) is not None:
            rank, i = top
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            waiting[gone] = new = -1
            if end < n:
                before[end] = i
                if (stop := after[end]) - i <= longest and (new := get(piece[i:stop], -1)) >= 0:
                    push(new, i)
            waiting[i] = new
            if (left := before[i]) >= 0:
                new = get(piece[left:end], -1) if end - left <= longest else -1
                if new != waiting[left]:
                    waiting[left] = new
                    if new >= 0:
                        push(new, left)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : after[i]]))
            i = after[i]
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they can't merge or there is no right one (-1)."""
        keys = a * self.width + b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (b >= 0), self.pair_ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The packed token ids of each of many pre-tokens, none empty."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n, ends = len(flat), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        token = np.append(self.byte_ids[flat], -1)  # the last place stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - sizes] = n
        after[n] = before[n] = n
        waiting = np.append(self._pair(token[:n], token[after[:n]]), -1)
        alive = np.ones(n + 1, dtype=bool)
        queue = RankQueue(self.width)
        buckets = queue.buckets

        def push_all(positions: np.ndarray) -> None:
            new = waiting[positions]
            positions, new = positions[new >= 0], new[new >= 0]
            for rank, position in zip(new.tolist(), positions.tolist(), strict=True):
                if (bucket := buckets.get(rank)) is not None:
                    bucket.append(position)
                else:
                    queue.push(rank, position)

        push_all(np.arange(n))
        while queue.top:
            rank, at = queue.pop_bucket()
            at = at[waiting[at] == rank]  # others are stale
            if len(at) > 1:
                at = np.unique(at)
                first = np.append(True, owner[at][1:] != owner[at][:-1])
                for position in at[~first].tolist():
                    queue.push(rank, position)
                at = at[first]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            alive[gone] = False
            waiting[gone] = -1
            token[at], after[at], before[end] = rank, end, at
            before[n] = n
            waiting[at] = self._pair(token[at], token[end])
            left = before[at]
            left = left[left < n]
            was = waiting[left]
            waiting[left] = self._pair(token[left], token[after[left]])
            push_all(np.concatenate([at, left[waiting[left] != was]]))
        alive[n] = False
        packed = token[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive[:n])[ends - 1] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(self, tokens: set[str]) -> None:
        """Remember the ids of pre-tokens not seen before."""
        if len(self.memo) + len(tokens) > MEMO_ENTRIES:
            self.memo.clear()
        new = list(tokens - self.memo.keys())
        pieces = [t.encode("utf-8", "surrogatepass") for t in new]
        # A pre-token that is a token itself is that one, whether or not merges lead to it.
        whole = [self.ranks.get(piece) for piece in pieces]
        self.memo.update((t, np.uint32(rank).astype("<u4").tobytes()) for t, rank in zip(new, whole, strict=True) if rank is not None)
        short = [k for k, piece in enumerate(pieces) if whole[k] is None and 0 < len(piece) <= MEMO_BYTES]
        for start in range(0, len(short), 50_000):
            part = short[start : start + 50_000]
            for k, packed in zip(part, self.merge_all([pieces[k] for k in part]), strict=True):
                self.memo[new[k]] = packed

    def _packed(self, token: str) -> bytes:
        return np.array(self.merge(token.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.pack(self.find(text))

    def pack(self, tokens: list[str]) -> bytes:
        memo, packed = self.memo.get, self._packed
        return b"".join([memo(t) or packed(t) for t in tokens])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def packed_texts(codec: Codec, texts: pa.Array) -> Iterator[bytes]:
    """The packed ids of each text; texts of CHUNK characters are split into pre-tokens at a time."""
    held: list[list[str]] = []
    size = 0
    for text in texts:
        text = text.as_py() or ""
        held.append(codec.find(text))
        size += len(text)
        if size >= CHUNK:
            codec.learn(set().union(*held))
            yield from map(codec.pack, held)
            held, size = [], 0
    codec.learn(set().union(*held))
    yield from map(codec.pack, held)


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(file: bytes, pattern: str) -> Codec:
    key = (hash(file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec.from_bytes(file, pattern)
    return _codecs[key]


def read_vocabulary(path: str, limit: int = 64 << 20) -> bytes:
    """The vocabulary file, which is sent to the executors whole: its size is checked."""
    with open(path, "rb") as f:
        file = f.read(limit + 1)
    if len(file) > limit:
        raise ValueError(f"vocabulary file over {limit} bytes: {path}")
    return file


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Needs columns doc_id and text; others are ignored, whatever their names.  A null text counts
    as empty: no tokens, and both digests are those of no bytes.  A null doc_id stays null, and
    each of several equal rows gives its own row.  An empty table gives no rows.  `keep_ids`
    adds the column ids (array<int>).
    """
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for packed in packed_texts(codec, batch.column(1)):
                ids = np.frombuffer(packed, dtype="<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids.tolist())).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return pairs.mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
