import math
import random

import pyarrow as pa
import pytest

from tessera import queries as Q
from tessera.functions import grid as G
from tessera.functions import hdc, scan
from tessera.operators import lookup as lk

SETS = {i: sorted(random.Random(i).sample(range(200), i % 30)) for i in range(120)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block,name", [(16_384, int), (16_384, str), (3, int)])
def test_best_of_each_query_in_blocks(spark, monkeypatch, block, name):
    monkeypatch.setattr(scan, "BLOCK", block)
    kind = "long" if name is int else "string"
    memory = spark.createDataFrame([(name(i), p) for i, p in SETS.items()] + [(name(500), [3, 900]), (name(501), None)], f"name {kind}, positions array<int>")
    queries = spark.createDataFrame([(i, p) for i, p in SETS.items() if i % 10 < 2] + [(700, [5, 199])], "query long, positions array<int>")
    found = hdc.query_top_k(queries, memory, 4)
    want = {}
    for q in queries.collect():
        near = [(len(set(q["positions"]) & set(m["positions"])) / min(len(q["positions"]), len(m["positions"])), m["name"]) for m in memory.collect() if q["positions"] and m["positions"] and set(q["positions"]) & set(m["positions"])]
        want |= {(q["query"], r): (x, n) for r, (x, n) in enumerate(sorted(near, key=lambda t: (-t[0], t[1]))[:4], 1)}
    assert {(r["query"], r["rank"]): (r["similarity"], r["name"]) for r in found.collect()} == want and len(want) > 80
    assert "Generate" not in plan(found)


def test_pieces_of_a_batch(monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array(list(SETS)), pa.array(list(SETS.values()), pa.list_(pa.int32()))], ["name", "positions"])
    both = pa.RecordBatch.from_arrays([rows.column(0), rows.column(0), rows.column(1), rows.column(1).take(pa.array([*range(1, 120), 0]))], ["a", "b", "pa", "pb"])
    asked = [rows.column(x).slice(0, 40) for x in (0, 1)]

    def each():
        for run, batch in ((scan.overlaps(*asked, 3), rows), (scan.jaccards(*asked, 0.1), rows), (scan.smoothed(16, G.kernel(7, 1.5)), both)):
            yield sorted((x["query" if "query" in x else "a"], x["name" if "name" in x else "b"], round(x["similarity"], 9)) for b in run(iter([batch])) for x in b.to_pylist())

    whole = list(each())
    monkeypatch.setattr(scan, "HITS", 60)
    assert list(each()) == whole and all(map(len, whole))


def test_shared_places_do_not_move(spark):
    d = "/root/testdata/sf0.001"
    for name in ("item_memory_top_k", "hdc_analogy", "smoothed_similarity"):
        assert "Generate" not in plan(Q.QUERIES[name](spark, d)), name


def test_smoothed_where_pairs_meet(spark):
    sets = {1: [0, 5, 16 * 15], 2: [1, 250], 3: [136], 4: list(range(256)), 5: []}
    rows = spark.createDataFrame(list(sets.items()), "id long, positions array<int>")
    pairs = [(a, b) for a in (*sets, 9) for b in sets if a != b]
    got = {(r["a"], r["b"]): (r["similarity"], r["met"]) for r in lk.smoothed_similarity(spark.createDataFrame(pairs, "a long, b long"), rows, 16).collect()}

    def dense(p):
        v = [0.0] * 256
        for x in p:
            for r, c, w in G.kernel(7, 1.5):
                v[(x // 16 + r) % 16 * 16 + (x % 16 + c) % 16] += w
        return v

    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    for a, b in pairs:
        x, y = dense(sets.get(a, [])), dense(sets[b])
        p = dot(x, y)
        assert got[a, b] == (pytest.approx(p / math.sqrt(dot(x, x) * dot(y, y)) if p else 0.0, abs=1e-6), p > 0)
    assert len(got) == len(pairs)
