"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The words of a source are laid end to end and cut into blocks of equal size.  The highest
quotients target / (2 q + 1) over all sources get the blocks of the mix; those of a source are
dealt among its shards in the same way, by their sizes; within a shard whole rounds take every
block and a seeded order picks the rest.  Shards hold about `shard_words` words, so a hot source
has more of them and no group grows with it.

The quotients aren't all listed.  A level is searched for instead, above which about as many
quotients lie as there are blocks: how many those are is a sum over the parties, from partial
aggregates.  Only the few quotients between the last two levels are ranked.  Neither sources nor
the shards of a source ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, numbered, stored

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
BLOCK, SHARD_WORDS, SEED = 64, 1 << 18, "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> tuple[DataFrame, float]:
    """sources (source, source_size) with number, weight and target; and the sum of the targets.

    Numbers and weights follow the code points of the names, null last.  Targets share `share`
    times all words by weight; those above `limit` times their size stop there and the excess is
    shared again until none is above.
    """
    sources = numbered(sources, [F.asc_nulls_last("source")], "number").withColumn("number", (F.col("number") + 1).cast("int"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1).cast("double"))
    sources = durable(sources.withColumn("cap", F.col("source_size") * limit))
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = float(total or 0) * share
    level, capped = (whole / weight if weight else None), 0
    while level is not None:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, rest = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped:
            break
        capped, level = n, (whole - float(caps)) / rest if rest else None
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "number", "weight", target.alias("target")), float(total or 0) * limit if level is None else whole


def _places(votes: Column, level: Column) -> Column:
    """How many quotients votes / (2 q + 1) reach a level, exactly as they compare in double precision."""
    n = F.floor((votes / level + 1) / 2)
    more = F.when(votes / (2 * n + 1) >= level, 1).otherwise(0)
    less = F.when((n > 0) & (votes / (2 * n - 1) < level), 1).otherwise(0)
    return F.when(votes > 0, n + more - less).otherwise(0).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, within: list[str], order: list[str], ranked: int = 4096, cuts: int = 24) -> DataFrame:
    """Add won (long): each party's part of the whole number `seats`, the same for all of a group.

    A tie of quotients goes to the first by `order`.  Parties without votes win nothing.  With V
    votes, K seats and n parties the last quotient that wins lies between V / (2 K + n) and
    V / (2 K - n); levels between, `cuts` at a time, narrow that until at most `ranked` quotients
    of a group are left, or such as are equal; they are ranked.
    """
    voted = durable(parties.withColumn("_v", F.col(votes).cast("double")))

    def met(levels: DataFrame) -> DataFrame:
        """Parties with the levels of their group, one row for each."""
        return voted.join(levels, within) if within else voted.crossJoin(F.broadcast(levels))

    some = voted.where("_v > 0").groupBy(*within).agg(F.sum("_v").alias("_all"), F.count("*").alias("_n"), F.max("_v").alias("_top"), F.max(seats).alias("_k"))
    spare = 2 * F.col("_k") - F.col("_n")
    top = F.col("_top") * (1 + 1e-9)
    high = F.when(spare > 0, F.least(top, F.col("_all") / spare * (1 + 1e-9))).otherwise(top)
    levels = some.select(*within, "_k", (F.col("_all") / (2 * F.col("_k") + F.col("_n")) * (1 - 1e-9)).alias("_lo"), high.alias("_hi"))
    place = lambda level: F.sum(_places(F.col("_v"), level))
    levels = durable(met(levels).groupBy(*within, "_k", "_lo", "_hi").agg(place(F.col("_lo")).alias("_at_lo"), place(F.col("_hi")).alias("_at_hi")))
    for _ in range(40):
        wide = (F.col("_at_lo") - F.col("_at_hi") > ranked) & (F.col("_lo") * (1 + 1e-15) < F.col("_hi"))
        if levels.where(wide).isEmpty():
            break
        cut = lambda j: F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), F.lit(j / (cuts + 1)))
        counted = met(levels).groupBy(*within, "_k", "_lo", "_hi", "_at_lo", "_at_hi").agg(*(place(cut(j)).alias(f"_s{j}") for j in range(1, cuts + 1)))
        points = F.array(*(F.struct(cut(j).alias("l"), F.col(f"_s{j}").alias("s")) for j in range(1, cuts + 1)))
        ends = F.struct(F.col("_lo").alias("l"), F.col("_at_lo").alias("s")), F.struct(F.col("_hi").alias("l"), F.col("_at_hi").alias("s"))
        below = F.array_max(F.concat(F.array(ends[0]), F.filter(points, lambda p: p["s"] >= F.col("_k"))))
        above = F.array_min(F.concat(F.array(ends[1]), F.filter(points, lambda p: p["s"] <= F.col("_k"))))
        levels = counted.select(*within, "_k", below.alias("_b"), above.alias("_a"))
        levels = durable(levels.select(*within, "_k", F.col("_b.l").alias("_lo"), F.col("_a.l").alias("_hi"), F.col("_b.s").alias("_at_lo"), F.col("_a.s").alias("_at_hi")))
    key = [*within, *order]
    # One level that has just the seats is both ends; then nothing is open.
    held = met(levels).withColumn("_low", _places(F.col("_v"), F.col("_hi"))).withColumn("_high", F.greatest(F.col("_low"), _places(F.col("_v"), F.col("_lo")))).withColumn("_open", F.col("_k") - F.col("_at_hi"))
    places = held.where("_high > _low").select(*key, "_v", "_open", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_q"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(F.col("_v") / (2 * F.col("_q") + 1)), *order))
    more = places.withColumn("_rank", rank).where("_rank <= _open").groupBy(*key).agg(F.count("*").alias("_more"))
    low = held.select(*key, "_low")
    won = voted.join(low, key, "left").join(more, key, "left")
    return won.select(*parties.columns, (F.coalesce("_low", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("long").alias("won"))


def _pieces(docs: DataFrame, key: Column, block: int, shard_words: int, seed: str) -> DataFrame:
    """A row for each document and block of its shard that it reaches into.

    row, doc_id, source, key, size, source_size, target, number, shard, start; at and n, the
    place of the piece in the document and its words; times, how often the mix takes it.  `row`
    tells equal rows apart; it is fixed by the checkpoint, and equal rows may swap theirs.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), key.alias("key"))
    sizes = durable(sizes.withColumn("row", F.monotonically_increasing_id()))
    sources, whole = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("blocks", F.lit(int(whole / block + 0.5)).cast("long"))
    sources = apportion(sources, "target", "blocks", [], ["number"]).withColumnRenamed("won", "quota")
    sources = durable(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).drop("blocks", "weight"))
    mixed = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.number", "s.shards")
    mixed = mixed.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "doc_id")))
    mixed = mixed.withColumn("shard", F.conv(F.substring("h", 1, 7), 16, 10).cast("long") % F.col("shards"))
    line = Window.partitionBy("number", "shard").orderBy("h", F.asc_nulls_first("doc_id"), "size", "key", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = durable(mixed.withColumn("start", F.sum("size").over(line) - F.col("size")).drop("h", "shards"))
    shards = placed.groupBy("number", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(sources.select("number", "quota"), "number")
    shards = apportion(shards, "shard_size", "quota", ["number"], ["shard"]).withColumn("blocks", F.ceil(F.col("shard_size") / block)).where("blocks > 0")
    shards = shards.withColumn("won", F.least("won", F.col("blocks") * LIMIT))
    shards = durable(shards.select("number", "shard", "blocks", F.expr("won div blocks").alias("rounds"), F.expr("won % blocks").alias("extra")))
    cut = shards.where("extra > 0").select("number", "shard", "extra", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    draw = Window.partitionBy("number", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "number", "shard", "block")), "block")
    drawn = cut.withColumn("_rank", F.row_number().over(draw)).where("_rank <= extra").select("number", "shard", "block", F.lit(1).alias("drawn"))
    end = F.col("start") + F.col("size")
    reach = F.sequence(F.expr(f"start div {block}"), F.expr(f"greatest(start, start + size - 1) div {block}"))
    pieces = placed.withColumn("block", F.explode(reach))
    first = F.greatest("start", F.col("block") * block)
    pieces = pieces.withColumn("at", first - F.col("start")).withColumn("n", F.least(end, (F.col("block") + 1) * block) - first)
    pieces = pieces.join(shards.select("number", "shard", "rounds"), ["number", "shard"], "left").join(drawn, ["number", "shard", "block"], "left")
    return pieces.withColumn("times", F.coalesce("rounds", F.lit(0)) + F.coalesce("drawn", F.lit(0)))


PLACE = ["row", "doc_id", "source", "key", "size", "source_size", "target", "number", "shard", "start"]


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted).

    Needs doc_id, text and source; other columns are ignored.  A null text has no words and is
    never taken; a null source is a source of its own; a null doc_id is a document like any
    other; each of several equal rows is placed and taken by itself.  An empty table gives no rows.
    """
    pieces = _pieces(docs, F.lit(0), block, shard_words, seed)
    taken = pieces.groupBy(*PLACE).agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix_texts(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each document and pass that takes any of it.

    The first pass has the blocks taken at least once, the second those taken twice.  A pass over
    a whole document leaves its text as it is; one over a part joins the words taken by spaces and
    sets n_chars, where there is such a column.  Needs doc_id, text and source; all columns are
    kept, whatever their names.  A null or empty text is never taken; a null source is one of its
    own; a null doc_id is a document like any other; each of several rows with equal doc_id,
    source and text is taken by itself, with its own other columns.  An empty table gives no rows.
    """
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    plans = _plans(docs, key, block, shard_words, seed)
    named = docs.select(F.struct("*").alias("d"), key.alias("k"))
    if not plans.groupBy("doc_id", "source", "key").count().where("count > 1").isEmpty():
        # Equal texts need a name each; only then are the rows written once more, which fixes it.
        named = stored(named.withColumn("k", F.concat_ws(":", "k", F.monotonically_increasing_id())), "mix-rows")
        plans = _plans(named.select("d.doc_id", "d.source", "d.text", "k"), F.col("k"), block, shard_words, seed)
    p = plans.alias("p")
    same = (F.col("k") == F.col("p.key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("p.source"))
    rows = named.join(p, same).select("d", F.col("p.size").alias("size"), F.col("p.parts").alias("parts"), F.explode(F.sequence(F.lit(1), F.lit(LIMIT))).alias("pass"))
    rows = rows.withColumn("parts", F.filter("parts", lambda x: x["times"] >= F.col("pass"))).where(F.size("parts") > 0)
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    found = F.regexp_extract_all("d.text", F.lit(WORD), F.lit(0))
    rows = rows.select("d", "parts", F.when(taken < F.col("size"), found).alias("words"))
    cut = F.array_join(F.flatten(F.transform("parts", lambda x: F.slice(F.col("words"), (x["at"] + 1).cast("int"), x["n"].cast("int")))), " ")
    rows = rows.select("d", F.when(F.col("words").isNull(), F.col("d.text")).otherwise(cut).alias("t"))
    changed = {"text": F.col("t").alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("t").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*(changed[c] if c in changed else F.col("d").getField(c).alias(c) for c in docs.columns))


def _plans(docs: DataFrame, key: Column, block: int, shard_words: int, seed: str) -> DataFrame:
    """doc_id, source, key, size and parts (at, n, times) of each document that the mix takes any of."""
    pieces = _pieces(docs, key, block, shard_words, seed).where("n > 0 and times > 0")
    parts = pieces.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("at", "n", "times"))).alias("parts"))
    return durable(parts.select("doc_id", "source", "key", "size", "parts"))


SQL = rf"""
    WITH d AS (
        SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
               md5('{SEED}' || coalesce(':' || doc_id, '')) AS h FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
    s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s0),
    s2 AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(number - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, source_size * {LIMIT} AS cap FROM s1),
    s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} - CAST(sum(cap) OVER o - cap AS DOUBLE)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
           FROM s2 WINDOW o AS (ORDER BY cap / weight, number ROWS UNBOUNDED PRECEDING)),
    s4 AS (SELECT source, source_size, number,
                  least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN cap > level * weight THEN level END) OVER () * weight, CAST(cap AS DOUBLE))) AS target FROM s3),
    k AS (SELECT CAST(floor(sum(target) / {BLOCK} + 0.5) AS BIGINT) AS blocks, max(source_size) AS top FROM s4),
    q1 AS (SELECT number, target / (2 * q + 1) AS quotient FROM s4, k, range(0, CAST(ceil(2.0 * k.top / {BLOCK}) AS BIGINT) + 3) t(q) WHERE target > 0),
    q2 AS (SELECT number, row_number() OVER (ORDER BY quotient DESC, number) AS r FROM q1),
    q3 AS (SELECT number, count(*) AS quota FROM q2, k WHERE r <= blocks GROUP BY 1),
    s5 AS (SELECT s4.*, coalesce(quota, 0) AS quota, greatest(1, CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT)) AS shards FROM s4 LEFT JOIN q3 USING (number)),
    p AS (SELECT d.*, source_size, target, number, CAST('0x' || left(h, 7) AS BIGINT) % shards AS shard FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
    l AS (SELECT *, CAST(sum(size) OVER (PARTITION BY number, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM p),
    g1 AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM l GROUP BY 1, 2),
    g2 AS (SELECT g1.*, quota FROM g1 JOIN s5 USING (number) WHERE shard_size > 0),
    g3 AS (SELECT number, shard, quota, shard_size / (2 * q + 1) AS quotient FROM g2, range(0, CAST(ceil(2 * shard_size / {BLOCK}) AS BIGINT) + 3) t(q)),
    g4 AS (SELECT number, shard, quota, row_number() OVER (PARTITION BY number ORDER BY quotient DESC, shard) AS r FROM g3),
    g5 AS (SELECT number, shard, count(*) AS won FROM g4 WHERE r <= quota GROUP BY 1, 2),
    g6 AS (SELECT number, shard, CAST(ceil(shard_size / {BLOCK}) AS BIGINT) AS blocks, coalesce(won, 0) AS won FROM g2 LEFT JOIN g5 USING (number, shard)),
    g7 AS (SELECT number, shard, blocks, least(won, {LIMIT} * blocks) // blocks AS rounds, least(won, {LIMIT} * blocks) % blocks AS extra FROM g6),
    b AS (SELECT number, shard, block, rounds + CASE WHEN row_number() OVER (PARTITION BY number, shard ORDER BY md5('{SEED}:' || number || ':' || shard || ':' || block), block) <= extra THEN 1 ELSE 0 END AS times
          FROM g7, range(0, blocks) t(block)),
    t AS (SELECT l.number, l.shard, l.start, l.doc_id, l.size, sum((least(l.start + l.size, (b.block + 1) * {BLOCK}) - greatest(l.start, b.block * {BLOCK})) * b.times) AS taken
          FROM l JOIN b ON l.number = b.number AND l.shard = b.shard AND b.block BETWEEN l.start // {BLOCK} AND (l.start + l.size - 1) // {BLOCK}
          WHERE l.size > 0 GROUP BY ALL)
    SELECT l.doc_id, l.size, l.source_size, l.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
    FROM l LEFT JOIN t ON l.number = t.number AND l.shard = t.shard AND l.start = t.start AND l.size = t.size AND l.doc_id IS NOT DISTINCT FROM t.doc_id"""
