"""Decontamination and the Jaccard join against brute force, and the queries against their SQL."""

import random
import re

import duckdb
import pytest

from tessera.llm.decontaminate import contained, without_leaks
from tessera.llm.jaccard import components, near_duplicates, one_of_each
from tessera.llm.queries import ORACLE_SQL, QUERIES


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(w, k, short=True):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w and short else set())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 9, 13, 40, 200]))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += rng.choice(bases)[: rng.randrange(9)]
        docs.append((i + 5, " ".join(w).title() if rng.random() < 0.3 else " ".join(w)))
    return docs


def test_jaccard_against_brute_force(spark):
    docs = corpus(random.Random(8), 150) + [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "One  two"), (400, "w1 w2"), (None, "one two"), (500, "one two"), (3, "one two")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, class string")
    sets = [shingles(words(t), 5) for _, t in docs]
    link = [[bool(i != j and a and 100 * len(a & b) >= 90 * len(a | b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = []
    for i, (d, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            for j, x in enumerate(link[todo.pop()]):
                if x and j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        want.append((d, len(sets[i]), sum(link[i]), min(ids, default=None)))
    got = [tuple(r) for r in near_duplicates(df).drop("text_key").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = one_of_each(df).collect()
    n_components = len({(w[3], w[3] is None and i) for i, w in enumerate(want) if w[1]}) + sum(1 for w in want if not w[1])
    assert len(left) == n_components
    assert near_duplicates(df.limit(0)).collect() == []


def test_long_chains(spark):
    nodes = spark.createDataFrame([(i, 1000 - i if i % 3 else None) for i in range(60)], "node long, value long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(49)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(nodes, edges).collect()}
    assert all(got[i] == 951 for i in range(50)) and got[50] == 950 and got[51] is None


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    docs = corpus(rng, 80) + [(900, None), (901, ""), (903, "dup"), (902, "a b c"), (None, "x A b c y")]
    items = [(i, " ".join(t.split()[: rng.choice([6, 12, 40])])) for i, (_, t) in enumerate(docs[:25])] + [(50, "a B c"), (51, None), (52, ""), (53, "w1"), (50, "a B c")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int")
    it = spark.createDataFrame([(*d, 1) for d in items], "item_id long, text string, n_item int")
    want = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            s = shingles(v, 5)
            c = len(s & shingles(w, min(5, len(v)), False)) if v else 0
            if s and 2 * c >= len(s):
                want.add((d, i, len(s), c, c / len(s)))
    for rows in (500_000, 0):
        got = [tuple(r) for r in contained(df, it, broadcast_rows=rows).drop("key").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["doc_id"] for r in without_leaks(df, it).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert contained(df.limit(0), it).collect() == [] and contained(df, it.limit(0)).collect() == []
