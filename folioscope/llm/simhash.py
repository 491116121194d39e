"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree, but for at most one bit, in one of
their two halves.  So each half is indexed under its 32 one-wildcard variants (the half with one
bit deleted), equal variants are joined, and the pairs are verified.  Everything runs on distinct
fingerprints, so exact copies cost nothing.

A bucket may hold very many distinct fingerprints when a large group of near copies shares a
half.  Buckets over `bucket` fingerprints emit no pairs.  Their members take whole-fingerprint
variants instead: each is filed under itself and its 64 one-bit neighbours.  Fingerprints at
distance two share a neighbour, all that share one are within distance two, and there are at most
65 of them, so linking each to the least keeps every component whole with 65 rows a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import durable, small_batches
from .components import components

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space bytes only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), dtype="<u8", count=len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are those that over half of the unsigned 64-bit hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py() or b"", shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return pairs.mapInArrow(run, "doc_id long, fp long")


def near_pairs(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints of column fp within two bits of each other.

    Only the links' closure is promised: buckets of over `bucket` fingerprints leave the half-segment
    variants, and their members get a star of links from whole-fingerprint variants.  Both ways are
    exact, so `bucket` bounds work and changes no component.
    """
    # A key holds 32 bits of the half with one of them cleared, 5 of the wildcard's place, 1 of the half.
    half = F.col("half")
    keyed = prints.select("fp", F.explode(F.expr("array(struct(0L as h, fp & 4294967295L as half), struct(1L as h, shiftrightunsigned(fp, 32) as half))")).alias("s")).select("fp", "s.h", "s.half")
    keyed = keyed.select("fp", "h", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    cleared = half.bitwiseAND(F.expr("~shiftleft(1L, i)"))
    keyed = keyed.select("fp", (((F.col("h") * 32 + F.col("i")) * F.lit(1 << 32)) + cleared).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(keyed.join(sizes, "key"))
    few, many = members.where(F.col("n") <= bucket).select("key", "fp"), members.where(F.col("n") > bucket)
    a, b = few.select("key", F.col("fp").alias("src")), few.select("key", F.col("fp").alias("dst"))
    pairs = a.join(b, "key").where("src < dst and bit_count(src ^ dst) <= 2").select("src", "dst")
    around = many.select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    around = around.select("fp", F.expr("case when i < 0 then fp else fp ^ shiftleft(1L, i) end").alias("near"))
    stars = around.groupBy("near").agg(F.min("fp").alias("src"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("src", F.explode("all").alias("dst")).where("src < dst")
    return pairs.union(stars).distinct()


def nearest(prints: DataFrame, radius: int = 4, bucket: int = 64) -> DataFrame:
    """Of distinct fingerprints fp, each (src) with its nearest other (dst) of at most `radius` differing bits, ties to the smaller.

    The bits are cut into radius + 2 segments, two of which at least are equal in such a pair; so each pair of
    segments is a key.  In a bucket of over `bucket` fingerprints only its least one is compared with the others.
    """
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    parts = [F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(cuts, cuts[1:], strict=False)]
    two = [F.struct(F.lit(i * len(parts) + j).alias("k"), (parts[i] * (1 << 16) + parts[j]).alias("v")) for i in range(len(parts)) for j in range(i)]
    keyed = prints.select("fp", F.explode(F.array(*two)).alias("s")).select("fp", F.expr("s.v * 64 + s.k").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("fp").alias("low")).where("m > 1")
    few = keyed.join(sizes.where(F.col("m") <= bucket).select("key"), "key")
    pairs = few.select("key", F.col("fp").alias("src")).join(few.select("key", F.col("fp").alias("dst")), "key").select("src", "dst")
    stars = keyed.join(sizes.where(F.col("m") > bucket).select("key", "low"), "key").select(F.col("fp").alias("src"), F.col("low").alias("dst"))
    near = pairs.union(stars).withColumn("bits", F.expr("bit_count(src ^ dst)")).where(F.col("src") != F.col("dst")).where(F.col("bits") <= radius)
    return near.groupBy("src").agg(F.min(F.struct("bits", "dst")).alias("best")).select("src", "best.dst")


def simhash_components(docs: DataFrame, shingle: int = 3, bucket: int = 64) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Needs doc_id and text; other columns are ignored.  A null or white text has fingerprint zero
    and links like any other; a text of fewer words than a shingle is one shingle.  component_id
    is the smallest non-null doc_id that links of at most two differing bits reach; null if no
    member has one.  Equal rows give equal rows; an empty table gives none.
    """
    prints = durable(fingerprints(docs, shingle))
    least = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(least.select("fp"), bucket))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = durable(rooted.join(groups, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
