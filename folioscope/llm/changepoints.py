"""Penalised change points of daily series by memoised depth-first branch-and-bound.

Rows are summed by series and day first, so a series is one short row whatever number of rows it
comes from, and series are shared out over the tasks.  Within a series the search begins at its end.
A subproblem is a prefix; its last segment may begin at any start that leaves it long enough, and
starts are taken in the order of lower bounds: the segment's own cost, the penalty and what the
prefix before it costs at least.  That last part follows from sums of squared errors, which never
fall as a span grows and of which a span has at least the sum of its parts.  A start whose bound is
strictly above the best found is cut; a prefix is solved once and kept with its lexicographic key
(cost, segments, last start), which settles ties without looking at earlier starts again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DAYS, PENALTY, SCALE = 7, 20_000, 1000
#: Days of the blocks that bound prefixes; each width gives a valid bound and the largest holds.
BLOCKS = (2, 3, 4, 5)
#: Series of up to so many days have the costs of all their segments computed at once.
TABLE_DAYS = 512
SEGMENTS = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def prefix_sums(values: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of squares of each prefix; Python's integers where 64 bits might not hold what spreads are made of."""
    n, most = len(values), max((abs(int(v)) for v in values), default=0)
    kind = np.int64 if (n + 1) ** 2 * (most + 1) ** 2 < 1 << 62 else object
    v = np.array([int(x) for x in values], dtype=kind)
    zero = np.zeros(1, dtype=kind)
    return np.concatenate([zero, np.cumsum(v)]), np.concatenate([zero, np.cumsum(v * v)])


def spreads(sums: np.ndarray, squares: np.ndarray, starts: np.ndarray, end: int | np.ndarray) -> np.ndarray:
    """V of the segments from each start to end."""
    n = (end - starts).astype(sums.dtype)
    s, q = sums[end] - sums[starts], squares[end] - squares[starts]
    return 1 + (n * q - s * s) // (n * n)


def costs(spread: np.ndarray, days: np.ndarray) -> np.ndarray:
    return days * np.floor(SCALE * np.log(spread.astype(np.float64))).astype(np.int64)


def prefix_bounds(sums: np.ndarray, squares: np.ndarray, penalty: int) -> np.ndarray:
    """What each prefix costs at least, by blocks of a few days.

    A segment of m days with x, its squared error a day, costs at least m * (SCALE * f(x) - 1), where
    f(x) is ln x from 1 on and x - 1 below.  f is concave and rises, so m * f(error / m) of a
    segment is at least the sum of that of its parts.  A block that no cut meets counts so; a block
    that is cut costs a penalty, less SCALE for each of its days, which lie apart then (f(0) is -1).
    """
    n = len(sums) - 1
    out = np.zeros(n + 1)
    for width in BLOCKS:
        ends = np.arange(width, n + 1, width)
        if not len(ends):
            continue
        starts = ends - width
        s, q = (sums[ends] - sums[starts]), (squares[ends] - squares[starts])
        x = ((width * q - s * s) / (width * width)).astype(np.float64)
        own = width * SCALE * np.where(x >= 1, np.log(np.maximum(x, 1)), x - 1)
        upto = np.concatenate([[0.0], np.cumsum(np.minimum(own, penalty - SCALE * width))])
        t = np.arange(n + 1)
        out = np.maximum(out, upto[t // width] - (t % width) * SCALE - t)
    return np.floor(out * (1 - 1e-9) - 1e-6).clip(0).astype(np.int64)


def segment(values: Sequence[int], least: int = LEAST_DAYS, penalty: int = PENALTY) -> tuple[list[int], int, int]:
    """Starts of the best segments, their cost with penalties, and the number of prefixes that had to be solved.

    The least sum of costs and penalties; of equal ones the fewest segments, then the earliest
    starts, the last segment's first.  A series of fewer than `least` values is one segment; one
    without values has none.
    """
    n = len(values)
    if not n:
        return [], 0, 0
    sums, squares = prefix_sums(values)
    known = prefix_bounds(sums, squares, penalty)  # exact where solved
    solved, parts, last = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    known[0], solved[0], opened = 0, True, 0

    def one(end: int) -> np.ndarray:
        starts = np.arange(end)
        return costs(spreads(sums, squares, starts, end), end - starts)

    if n <= TABLE_DAYS and n >= 2 * least:  # all of the costs at once
        ends, starts = np.triu_indices(n + 1, 1)[::-1]
        own = np.zeros((n + 1, n), dtype=np.int64)
        own[ends, starts] = costs(spreads(sums, squares, starts, ends), ends - starts)
        one = own.__getitem__

    stack = [(n, one(n))]
    while stack:
        end, own_costs = stack[-1]
        best, pick, count = own_costs[0], 0, 1  # the one segment from 0, then the starts that leave both sides long enough
        if end >= 2 * least:
            bound = own_costs[least : end - least + 1] + known[least : end - least + 1]
            low = bound[first := int(bound.argmin())] + penalty
            if low < best:  # one segment wins ties; whatever lies strictly above the lowest is cut
                at = first + least if solved[first + least] else None
                if at is not None and (ties := np.flatnonzero(bound == low - penalty) + least).size > 1:
                    todo = ties[~solved[ties]]
                    at = None if todo.size else int(ties[parts[ties].argmin()])
                    first = int(todo[0]) - least if todo.size else first
                if at is None:
                    stack.append((first + least, one(first + least)))
                    continue
                best, pick, count = low, at, parts[at] + 1
        known[end], parts[end], last[end], solved[end] = best, count, pick, True
        opened += 1
        stack.pop()
    found, end = [], n
    while end:
        end = int(last[end])
        found.append(end)
    return found[::-1], int(known[n]), opened


def segments(first_day: int, values: Sequence[int], least: int = LEAST_DAYS, penalty: int = PENALTY) -> list[tuple[int, ...]]:
    """A tuple as SEGMENTS has it for each segment of a series."""
    starts, best, _ = segment(values, least, penalty)
    sums, squares = prefix_sums(values)
    out = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(values)], strict=True), 1):
        v = spreads(sums, squares, np.array([a]), b)
        out.append((k, first_day + a, b - a, int(sums[b] - sums[a]), int(v[0]), int(costs(v, np.array([b - a]))[0]), len(starts), best))
    return out


def change_points(rows: DataFrame, series: str, day: Column, value: Column, least: int = LEAST_DAYS, penalty: int = PENALTY) -> DataFrame:
    """series and SEGMENTS, a row for each segment of each series.

    A series is the sum of value by day (a date), from its first to its last day with rows, 0 on
    days between without any; repeated rows count as often as they are there.  Rows without day or
    value take no part, and a series of only such rows has no segments.  A null series is a series
    like any other.  Only the columns named are read, so further ones can't clash.  Totals and
    spreads that a long can't hold fail the sum or the write rather than wrap.
    """
    taken = rows.select(F.col(series).alias("_series"), F.unix_date(day).alias("_day"), value.cast("long").alias("_value")).where("_day IS NOT NULL AND _value IS NOT NULL")
    daily = taken.groupBy("_series", "_day").agg(F.sum("_value").alias("_value"))
    lists = daily.groupBy("_series").agg(F.array_sort(F.collect_list(F.struct("_day", "_value"))).alias("_l")).select("_series", F.col("_l._day").alias("_days"), F.col("_l._value").alias("_values"))
    kind = rows.schema[series].dataType

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for key, days, values in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                days, values = days.values.to_numpy(), values.values.to_pylist()
                filled = [0] * (int(days[-1]) - int(days[0]) + 1)
                for d, v in zip((days - days[0]).tolist(), values, strict=True):
                    filled[d] = v
                mine = segments(int(days[0]), filled, least, penalty)
                names += [key] * len(mine)
                found += mine
            columns = list(zip(*found, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in names], type=batch.schema.field(0).type), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["_series", *(c.split()[0] for c in SEGMENTS.split(", "))])

    out = lists.mapInArrow(solve, f"_series {kind.simpleString()}, {SEGMENTS}")
    return out.withColumnRenamed("_series", series)


def vendor_segments(lines: DataFrame) -> DataFrame:
    """The segments of each vendor's daily quantity over kept lines."""
    return change_points(lines.where("flag = 'kept'"), "vendor_id", F.to_date("shipped_at"), F.col("quantity"))


#: The plain recursion over ends, in lists; a struct's order is that of its fields.
SQL = f"""WITH RECURSIVE d AS (SELECT vendor_id, CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, sum(quantity) AS q FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT row_number() OVER () AS r, vendor_id, min(day) AS a, CAST(max(day) - min(day) + 1 AS BIGINT) AS n FROM d GROUP BY vendor_id),
    f AS (SELECT e.r, g.i, coalesce(d.q, 0) AS q FROM (SELECT r, vendor_id, a, unnest(range(n)) AS i FROM e) g JOIN e USING (r) LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM g.vendor_id AND d.day = g.a + g.i),
    p AS (SELECT r, list_prepend(CAST(0 AS HUGEINT), list(s ORDER BY i)) AS s, list_prepend(CAST(0 AS HUGEINT), list(q ORDER BY i)) AS q FROM (SELECT r, i, CAST(sum(q) OVER w AS HUGEINT) AS s, CAST(sum(q * q) OVER w AS HUGEINT) AS q FROM f WINDOW w AS (PARTITION BY r ORDER BY i)) GROUP BY r),
    b AS (SELECT e.r, n, s, q, CAST(0 AS BIGINT) AS t, [{{'c': CAST(0 AS HUGEINT), 'k': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT)}}] AS best FROM e JOIN p USING (r)
        UNION ALL SELECT r, n, s, q, t + 1, list_append(best, CASE WHEN t + 1 >= {LEAST_DAYS} OR t + 1 = n THEN list_min(list_transform(list_filter(range(t + 1), lambda x: x = 0 OR (x >= {LEAST_DAYS} AND t + 1 - x >= {LEAST_DAYS})),
            lambda x: {{'c': best[x + 1].c + CASE WHEN x > 0 THEN {PENALTY} ELSE 0 END + (t + 1 - x) * CAST(floor({SCALE} * ln(1 + ((t + 1 - x) * (q[t + 2] - q[x + 1]) - (s[t + 2] - s[x + 1]) * (s[t + 2] - s[x + 1])) // ((t + 1 - x) * (t + 1 - x)))) AS HUGEINT), 'k': best[x + 1].k + 1, 's': x}})) END) FROM b WHERE t < n),
    z AS (SELECT r, n, s, q, best, best[n + 1].s AS x, n AS y FROM b WHERE t = n UNION ALL SELECT r, n, s, q, best, best[x + 1].s, x FROM z WHERE x > 0),
    w AS (SELECT r, x, y, best[n + 1] AS h, s[y + 1] - s[x + 1] AS total, 1 + ((y - x) * (q[y + 1] - q[x + 1]) - (s[y + 1] - s[x + 1]) * (s[y + 1] - s[x + 1])) // ((y - x) * (y - x)) AS v FROM z)
    SELECT vendor_id, CAST(row_number() OVER (PARTITION BY r ORDER BY x) AS INTEGER) AS segment_no, a + x AS first_day, y - x AS n_days, CAST(total AS BIGINT) AS total, CAST(v AS BIGINT) AS spread,
        CAST((y - x) * CAST(floor({SCALE} * ln(v)) AS BIGINT) AS BIGINT) AS cost, h.k AS n_segments, CAST(h.c AS BIGINT) AS best_cost FROM w JOIN e USING (r)"""
