"""Communities of a small weighted graph, as for the twenty most frequent keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame


def communities(edges: DataFrame, most: int = 2000) -> DataFrame:
    """node and community of edges (source, target, weight) by greedy modularity.

    Two communities are joined while that raises modularity, the best pair first, ties by name;
    numbers go by size and then by name.  The graph is drawn, so it is small: more than `most`
    edges are refused.
    """
    rows = edges.select("source", "target", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} edges")
    degree: dict[str, float] = {}
    between: dict[frozenset, float] = {}
    for a, b, w in rows:
        degree[a] = degree.get(a, 0.0) + w
        degree[b] = degree.get(b, 0.0) + w
        between[frozenset((a, b))] = between.get(frozenset((a, b)), 0.0) + w
    total = sum(degree.values())
    groups = {n: [n] for n in sorted(degree)}
    while True:
        gains = [(2 * (w / total - degree[a] * degree[b] / total**2), a, b) for pair, w in between.items() if len(pair) == 2 for a, b in [sorted(pair)]]
        best = max(gains, key=lambda g: (round(g[0], 12), [-ord(c) for c in g[1] + g[2]]), default=None)
        if best is None or best[0] <= 1e-12:
            break
        _, a, b = best
        groups[a] = sorted(groups[a] + groups.pop(b))
        degree[a] += degree.pop(b)
        moved: dict[frozenset, float] = {}
        for pair, w in between.items():
            pair = frozenset(a if n == b else n for n in pair)
            moved[pair] = moved.get(pair, 0.0) + w
        between = {p: w for p, w in moved.items() if len(p) == 2}
    ordered = sorted(groups.values(), key=lambda g: (-len(g), g))
    return edges.sparkSession.createDataFrame([(n, k) for k, g in enumerate(ordered) for n in g], "node string, community int")
