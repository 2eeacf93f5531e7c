import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import min_cost_flow, mix, targets_by_weight
from tessera.llm.queries import op3_source_mixing


def test_targets():
    t = targets_by_weight({"b": 100, "a": 10, None: 90, "c": 0})
    assert t["a"] == 20 and t["c"] == 0  # capped at twice its size
    assert t[None] == 180 and t["b"] == pytest.approx(100)  # so is the null source, the last


def test_flow_prefers_first_passes():
    flow = min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15}, 2)
    assert sum(sum(x.values()) for x in flow.values()) == 30
    assert all(sum(x.values()) == 10 for x in flow.values())  # nothing is repeated while new words are left
    flow = min_cost_flow({("a",): 10, ("b",): 10}, {"a": 18, "b": 5}, 2)
    assert flow[("a",)]["a"] == 18 and flow[("b",)]["b"] == 5


def test_whole_table(spark):
    got = op3_source_mixing(spark, "/root/testdata/sf0.01").toPandas()
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").toPandas()
    import re

    src["n"] = src.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    m = got.merge(src, on="doc_id")
    assert len(m) == len(src) and (m["size"] == m.n).all() and (m.taken <= 2 * m["size"]).all()
    by = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), s=("source_size", "first"), big=("size", "max"))
    assert (by["size"] == by.s).all() and ((by.taken - by.target).abs() <= by.big).all()
    assert by.target.sum() == pytest.approx(1.5 * m["size"].sum())
    again = op3_source_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert (again.sort_values("doc_id").taken.values == got.sort_values("doc_id").taken.values).all()


def test_edges(spark):
    rows = [(1, "a b", ["x"]), (1, "a b", ["x"]), (None, None, ["x"]), (3, "", None), (4, "one two three", None), (5, "q r s t", ["x", "y"])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, sources array<string>, taken int")
    got = mix(df).collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mix(df, max_patterns=1)


def test_flow_against_all_flows():
    rng = random.Random(4)
    for _ in range(25):
        supply = {("a",): rng.randrange(1, 3), ("a", "b"): rng.randrange(1, 3), ("b", "c"): rng.randrange(0, 2)}
        targets = {s: float(rng.randrange(0, 4)) for s in "abc"}
        edges = [(k, s) for k in supply for s in k]
        best = None
        for flow in itertools.product(*(range(2 * supply[k] + 1) for k, _ in edges)):
            by, into = Counter(), Counter()
            for (k, s), f in zip(edges, flow, strict=True):
                by[k] += f
                into[s] += f
            if all(by[k] <= 2 * supply[k] for k in supply) and all(into[s] <= targets[s] for s in targets):
                cost = sum(max(0, by[k] - supply[k]) for k in supply)
                best = max(best or (-1, 0), (sum(flow), -cost))
        got = min_cost_flow(supply, targets, 2)
        words = {k: sum(v.values()) for k, v in got.items()}
        assert (sum(words.values()), -sum(max(0, words[k] - supply[k]) for k in supply)) == best


def test_mix_against_a_plain_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(9)), rng.choice([["a"], ["b"], ["a", "b"], [None], ["c"]])) for i in range(80)] + [(80, None, ["a"]), (81, "", ["b"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sources array<string>, size int")
    place = {r["doc_id"]: r["b"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(1)), F.lit(1 << 16)).alias("b")).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    pattern = {i: tuple(s) for i, _, s in rows}
    supply, sizes = Counter(), Counter()
    for i, _, s in rows:
        supply[tuple(s)] += size[i]
        for x in s:
            sizes[x] += size[i]
    target = targets_by_weight(dict(sizes))
    flow = min_cost_flow(dict(sorted(supply.items(), key=lambda x: [(s is None, s or "") for s in x[0]])), target, 2)
    want = {}
    for k, n in supply.items():
        full, rest = divmod(sum(flow[k].values()), n)
        mine = sorted((place[i], i) for i in size if pattern[i] == k)
        last = -1
        for b in sorted({p for p, _ in mine}):
            upto = sum(size[i] for p, i in mine if p <= b)
            if upto - sum(size[i] for p, i in mine if p == b) / 2 <= rest:
                last = b
        for p, i in mine:
            want[i] = (size[i], sizes[k[0]], pytest.approx(target[k[0]]), size[i] * (full + (rest > 0 and p <= last)))
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mix(df).collect()}
    assert got == want
