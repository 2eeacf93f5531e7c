import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tessera.llm import substring
from tessera.llm.bytewords import FACTOR, blocks, mix64, sequence_hashes, word_hashes
from tessera.llm.substring import remove_repeats


def brute(rows, n):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - n + 1):
            at = (i is None, i or 0, s)
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, at), at)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (i is None, i or 0, s):
                gone.update(range(s, s + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ß#", " ", "日本"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([20, 21, 30, 60]))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(30))]
        rows.append((i * 7, rng.choice([" ", "\n", "\t ", " \x0b"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "x " * 50), (1004, " x" * 19), (None, rows[3][1]), (None, "y " * 45), (7, rows[1][1]), rows[2]]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, n_words int").repartition(5)
    got = [tuple(r) for r in remove_repeats(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 20), key=key)
    got = [tuple(r) for r in remove_repeats(df, window=6, anchor=3).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 6), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []


def test_words_that_a_polynomial_hash_confuses(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, " ".join([a] + ["x"] * 19)), (2, " ".join([b] + ["x"] * 19)), (3, " ".join(["x"] * 19 + [a]))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_very_long_text(spark):
    w = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(w)), (2, " ".join(["new", *w[10_000:], *w[:10_000]]))]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 30_000, 0), (2, 30_001, 30_000)]


def test_edges_are_made_and_moved_once(spark):
    """One scan of the texts for the anchors, one for the edges, which one exchange brings together."""
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(20)], "doc_id long, text string")
    scans, map_in_arrow = [], DataFrame.mapInArrow

    def counted(self, function, *args):
        scans.append(function.__qualname__.partition(".")[0])
        return map_in_arrow(self, function, *args)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", counted)
        edges = substring.repeated_edges(df)
    assert scans == ["path_rows", "edge_rows"]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert edges.count() > 0


def test_anchors_and_hashes_against_their_definition():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 3, 40, 9, 200)]
    (b,) = blocks(pa.array(texts))
    h = word_hashes(b)[:, 0]
    words = [int(x) for x in h]
    for window, anchor in ((20, 10), (6, 3), (5, 5), (7, 1)):
        g = [sum(x * FACTOR ** (anchor - 1 - j) for j, x in enumerate(words[i : i + anchor])) % (1 << 64) for i in range(len(words) - anchor + 1)]
        g = mix64(np.array(g, np.uint64)).tolist()
        assert sequence_hashes(h, anchor).tolist() == g
        want = []
        for s in range(len(words) - window + 1):
            if b.doc[s] == b.doc[s + window - 1]:
                at = min(range(s, s + window - anchor + 1), key=lambda i: (g[i], i))
                want.append((s, at, g[at]))
        assert list(zip(*(x.tolist() for x in substring.anchored_windows(b, h, window, anchor)), strict=True)) == want
    assert sequence_hashes(h[:3], 4).tolist() == []


def test_an_anchor_with_its_least_and_greatest_path():
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(w), " ".join(w), " ".join([*w[:25], "x", "y"])]
    whole = list(substring.path_rows(20, 10)(iter([pa.record_batch([pa.array(texts)], ["text"]), pa.record_batch([pa.array([], pa.string())], ["text"])])))
    assert len(whole) == 2 and whole[1].num_rows == 0
    (b,) = blocks(pa.array(texts))
    _, _, best, path, *_ = substring.paths(b, 20, 10)
    want = {}
    for k, p in zip(best.view(np.int64).tolist(), path.view(np.int64).tolist(), strict=True):
        n, low, high = want.get(k, (0, p, p))
        want[k] = (min(n + 1, 2), min(low, p), max(high, p))
    assert {r["anchor"]: (r["n"], r["low"], r["high"]) for r in whole[0].to_pylist()} == want
    assert {n for n, *_ in want.values()} == {1, 2}
