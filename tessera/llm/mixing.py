"""Mixing sources to target weights: a min-cost flow from membership patterns to sources, then seeded selection.

A document belongs to one source or several.  Documents with equal memberships form a pattern; its words may flow to any
of its sources, the first time at no cost and each further time at a rising one, and each source takes up to its target.
The flow of least cost says how many words each pattern gives; its documents are then taken in the order of a seeded
hash: all of them for every full repetition, and for the rest those whose hash bucket ends nearest to the words wanted.

Only totals by pattern reach the driver (max_patterns of them at most, else ValueError); the selection adds up 65536
hash buckets of each pattern in Spark.

Defined results.  Null or empty text: size 0, taken 0.  Null source: a source of its own, the last.  Equal rows have the
same hash and are taken together; unequal rows that share an id are taken apart.  Extra columns are ignored.  The result
depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

BUCKETS = 1 << 16


def targets_by_weight(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """share times all words, over the sources by weight; what exceeds `most` times a source's words is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, list(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in set(over)]
    return target


def min_cost_flow(supply: dict[tuple, int], targets: dict[str | None, float], passes: int) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern gives to each of its sources.  A pattern's p-th pass through its words costs p-1 a word."""
    names = ["from", "to", *(("p", k) for k in supply), *(("s", s) for s in targets)]
    at = {x: i for i, x in enumerate(names)}
    edges: list[list[int]] = []  # to, capacity, cost
    out: list[list[int]] = [[] for _ in names]

    def edge(a: object, b: object, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out[at[x]].append(len(edges))
            edges.append([at[y], c, w])
        return len(edges) - 2

    flows = {}
    for k, size in supply.items():
        for p in range(passes):
            edge("from", ("p", k), size, p)
        for s in k:
            flows[k, s] = edge(("p", k), ("s", s), passes * size, 0)
    for s, t in targets.items():
        edge(("s", s), "to", round(t), 0)
    potential = [0] * len(names)
    while True:
        dist, via, heap = [float("inf")] * len(names), [-1] * len(names), [(0, 0)]
        dist[0] = 0
        while heap:
            d, u = heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                v, cap, cost = edges[e]
                if cap > 0 and (n := d + cost + potential[u] - potential[v]) < dist[v]:
                    dist[v], via[v] = n, e
                    heappush(heap, (n, v))
        if via[1] < 0:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    got: dict[tuple, dict[str | None, int]] = {k: {} for k in supply}
    for (k, s), e in flows.items():
        got[k][s] = edges[e ^ 1][1]
    return got


def mix(
    docs: DataFrame,
    memberships: str = "sources",
    targets: Callable[[dict[str | None, int]], dict[str | None, float]] = targets_by_weight,
    passes: int = 2,
    seed: int = 1,
    max_patterns: int = 1_000_000,
) -> DataFrame:
    """docs (doc_id, text, and an array of sources) as doc_id, sources, size, source_size and target (of its first
    source), taken (words that the mix takes of it, repeats counted)."""
    key = F.xxhash64("doc_id", "text")
    bucket = lambda k: F.pmod(F.xxhash64(key, F.lit(seed + k)), F.lit(BUCKETS))
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(memberships), F.array(F.lit(None).cast("string")))))
    narrow = written(docs.select("doc_id", pattern.alias("sources"), n_words(F.col("text")).alias("size"), bucket(0).alias("bucket")), "mix")
    sizes = narrow.groupBy("sources").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(sizes) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    supply = {tuple(r["sources"]): r["n"] for r in sorted(sizes, key=lambda r: [(s is None, s or "") for s in r["sources"]])}
    by_source: dict[str | None, int] = {}
    for k, n in supply.items():
        for s in k:
            by_source[s] = by_source.get(s, 0) + n
    target = targets(by_source)
    flow = min_cost_flow(supply, target, passes)
    spark = docs.sparkSession
    rows = []
    for k, n in supply.items():
        full, rest = divmod(sum(flow[k].values()), n) if n else (0, 0)
        rows.append((list(k), by_source[k[0]] if k else 0, float(target[k[0]]) if k else 0.0, full, rest))
    plan = spark.createDataFrame(rows, "of array<string>, source_size long, target double, full long, rest long")
    plan = F.broadcast(plan) if len(rows) <= 10_000 else plan
    same = F.col("sources").eqNullSafe(F.col("of"))
    sums = narrow.groupBy("sources", "bucket").agg(F.sum("size").alias("n")).join(plan.select("of", "rest"), same)
    upto = F.sum("n").over(Window.partitionBy("sources").orderBy("bucket"))
    # a bucket is in if more than half of it lies below the words wanted
    edge = sums.withColumn("upto", upto).where(F.col("upto") - F.col("n") / 2 <= F.col("rest")).groupBy("sources").agg(F.max("bucket").alias("last")).select(F.col("sources").alias("with"), "last")
    edge = F.broadcast(edge) if len(rows) <= 10_000 else edge
    chosen = narrow.join(plan, same).join(edge, F.col("sources").eqNullSafe(F.col("with")), "left")
    taken = F.col("size") * (F.col("full") + F.when((F.col("rest") > 0) & (F.col("bucket") <= F.col("last")), 1).otherwise(0))
    return chosen.select("doc_id", "sources", "size", "source_size", "target", taken.alias("taken"))
