import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffixlm
from tessera.llm.common import LEAN, shared_dir, written
from tessera.llm.language import held_out
from tessera.llm.queries import op8_lm_scoring
from tessera.llm.suffixlm import LEAST, STRENGTH, score


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows, is_train):
    train = [toks(t) for i, t in rows if is_train(i)]
    uni = {}
    for d in train:
        for w in d:
            uni[w] = uni.get(w, 0) + 1
    n = sum(uni.values())
    grams = {}
    for d in train:
        for i in range(len(d)):
            for s in range(i):
                g = grams.setdefault(tuple(d[s:i]), {})
                g[d[i]] = g.get(d[i], 0) + 1
    out = []
    for doc, t in rows:
        d, base, total = toks(t), 0.0, 0.0
        for i, w in enumerate(d):
            p = b = (uni.get(w, 0) + 0.1) / (n + 0.1 * (len(uni) + 1))
            for s in range(i):
                if g := grams.get(tuple(d[s:i])):
                    a = max(STRENGTH / 2 ** min(i - s - 1, 60), LEAST)
                    p = (g.get(w, 0) + a * b) / (sum(g.values()) + a)
                    break
            base += math.log10(b)
            total += math.log10(p)
        out.append((doc, not is_train(doc), len(d), sum(w in uni for w in d), n, pytest.approx(base, abs=1e-6), pytest.approx(total, abs=1e-6)))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    train = {r["doc_id"] for r in df.where(~held_out(F.col("doc_id"), 10, 0)).collect()}
    got = [tuple(r) for r in score(df, held_out(F.col("doc_id"), 10, 0), **options).collect()]
    want = {r[0]: r for r in brute(rows, lambda i: i in train)}
    assert len(got) == len(rows)
    for g in got:
        assert g == want[g[0]], (g, want[g[0]])
    assert len(train) < len({r[0] for r in rows})


@pytest.mark.parametrize("options", [{}, {"block_words": 60, "shard_words": 10, "hot": 2}])
def test_against_brute_force(spark, options):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)] + ["É", "x,"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(25)))) for i in range(50)]
    rows += [(100, rows[7][1].upper()), (101, None), (102, ""), (None, "w1 w2"), (103, rows[9][1] + " w3")]
    check(spark, rows, **options)


@pytest.mark.parametrize("options", [{}, {"block_words": 100, "shard_words": 20, "hot": 3}])
def test_copies_and_patchworks(spark, options):
    """Near copies of each other, patchworks of their pieces, and long repetitions: runs that more than one match covers."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(60)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
        a, b = sorted(rng.sample(range(len(w)), 2))
        rows.append((i, " ".join(rng.choice([w, w[a:b], w[b:] + w[:a], w[:a]]))))
    rows += [(i, " ".join(["so"] * rng.randrange(40))) for i in range(60, 90)]
    check(spark, rows, **options)


def test_words_that_a_polynomial_hash_confuses(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(out, a), (out + 1, a.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in score(df, held_out(F.col("doc_id"), 10, 0)).collect()}
    assert got == {out: 1, out + 1: 2}


def test_very_long_text_and_empty_table(spark):
    text = " ".join(f"x{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([(i, text) for i in range(12)] + [(12, None)], "doc_id long, text string")
    got = score(df, F.col("doc_id") == 3, block_words=100_000).toPandas().set_index("doc_id")
    assert got.n_tokens[3] == 60_001 and (got.score.drop(12) - got.score[0]).abs().max() < 0.01
    assert score(df.limit(0), F.lit(False)).collect() == []


def test_held_out_documents_of_the_table(spark):
    got = op8_lm_scoring(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 200 and np.isfinite(got.score).all() and (got.score < 0).all()
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()  # better than the unigrams on what it has not seen


def test_a_message_is_compressed_once():
    arrays = [np.arange(10) * 70 ** k for k in range(5)] + [np.zeros(0, np.int64), np.array([1 << 40])]
    blob = suffixlm.pack(*arrays)
    assert blob.count(b"\x28\xb5\x2f\xfd") == 1  # frames of zstd
    assert [a.tolist() for a in suffixlm.unpack(blob)] == [a.tolist() for a in arrays]


def test_bytes_of_words_sort_as_their_numbers():
    for top in (0, 254, 255, 65_279, 65_280, 1 << 40):
        width = suffixlm.width_of(top)
        numbers = sorted({0, top // 3, max(0, top - 1), top})
        words = [suffixlm.spelled(np.array([x]), width) for x in numbers]
        assert words == sorted(words) and {len(w) for w in words} == {width} and all(w[0] < 255 for w in words)


def test_spent_tables_are_gone_when_runs_are_matched(spark, monkeypatch):
    left, match_runs = [], suffixlm.match_runs
    root = shared_dir(spark).removeprefix("file://")

    def seen(*args):
        left.extend(x.name for d in os.scandir(root) if d.name.startswith("score-") for x in os.scandir(d) if x.is_dir())
        return match_runs(*args)

    monkeypatch.setattr(suffixlm, "match_runs", seen)
    df = spark.createDataFrame([(i, f"a b c d e f g{i % 3}") for i in range(40)], "doc_id long, text string")
    assert score(df, F.col("doc_id") % 10 == 0).count() == 40
    assert {x.rsplit("-", 1)[0] for x in left} == {"unique", "runs", "documents"}


def test_tables_on_the_way_are_few_files(spark, monkeypatch):
    """Data files alone, and no more in a table than tasks: an executor starts processes for each file."""
    left, match_runs = {}, suffixlm.match_runs
    root = shared_dir(spark).removeprefix("file://")

    def seen(*args):
        left.update({x.path: os.listdir(x.path) for d in os.scandir(root) if d.name.startswith("score-") for x in os.scandir(d) if x.is_dir()})
        return match_runs(*args)

    monkeypatch.setattr(suffixlm, "match_runs", seen)
    df = spark.createDataFrame([(i, f"a b c d e f g{i % 3}") for i in range(400)], "doc_id long, text string").repartition(16)
    assert score(df, F.col("doc_id") % 10 == 0, block_words=200, shard_words=50).count() == 400
    assert len(left) == 3
    for files in left.values():
        assert 0 < len(files) <= 4 and all(f.endswith(".parquet") and not f.startswith(".") for f in files), files


def test_a_flipped_bit_on_the_way_is_an_error(spark):
    df = written(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1), "flipped", **LEAN)
    assert df.where("length(h) = 64").count() == 20_000
    path = df.inputFiles()[0].removeprefix("file:")
    path = "/" + path.lstrip("/")
    with open(path, "r+b") as f:
        f.seek(os.path.getsize(path) // 2)
        byte = f.read(1)[0]
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte ^ 1]))
    with pytest.raises(Exception, match="CRC checksum verification failed"):
        df.agg(F.sum(F.hash("id", "h"))).collect()


def test_runs_are_scored_together(monkeypatch):
    """Runs of a batch, some of whose suffixes are in parts, against the definition; no call for each run."""
    rng = random.Random(3)
    rows = []
    for run in range(40):
        tokens, matches, reach = rng.randrange(12), [], 0
        for s in sorted({0, *(rng.randrange(1, 6) for _ in range(rng.randrange(3)))}):
            reach = max(reach, s + rng.randrange(4, 9))
            for _ in range(rng.randrange(1, 3)):
                lens = sorted({reach - s, *(rng.randrange(4, reach - s + 1) for _ in range(2))}, reverse=True)
                matches.append({"s": s, "len": lens, "n": sorted(rng.sample(range(1, 99), len(lens)))})
        rng.shuffle(matches)
        rows.append((run, run % 2 == 0, [rng.randrange(50) for _ in range(tokens)], matches))

    def upto(matches, s, words):
        return sum(max((n for k, n in zip(m["len"], m["n"], strict=True) if k >= words), default=0) for m in matches if m["s"] == s)

    want = []
    for _, chain, more, matches in rows:
        total = 0.0
        for i, u in enumerate(more):
            at, base = suffixlm.DEPTH + i, (u + 0.1) / (1000 + 0.1 * 101)
            s = min((m["s"] for m in matches if m["s"] + m["len"][0] >= at), default=None)
            length, c, both = (0, 0, 0) if s is None else (at - s, upto(matches, s, at - s), upto(matches, s, at - s + 1))
            a = max(STRENGTH / 2 ** max(length - 1, 0), LEAST)
            total += math.log10((max(both, chain) + a * base) / (max(c, chain) + a) if length else base)
        want.append(total)
    called, log_p = [], suffixlm.log_p
    monkeypatch.setattr(suffixlm, "log_p", lambda *x: called.append(1) or log_p(*x))
    match = pa.struct([("s", pa.int32()), ("len", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(match)), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["run", "chain", "more", "matches"])
    (got,) = suffixlm.run_scores(1000, 100)(iter([batch]))
    assert got.column(1).to_pylist() == pytest.approx(want) and len(called) == 1
    monkeypatch.setattr(suffixlm, "TOKENS", 20)
    (got,) = suffixlm.run_scores(1000, 100)(iter([batch, batch[:0]][:1]))
    assert got.column(1).to_pylist() == pytest.approx(want)
    assert [len(x) for x in suffixlm.run_scores(1000, 100)(iter([batch[:0]]))] == [0]


def test_distinct_values():
    rng = np.random.default_rng(1)
    for top in (1, 50, 1 << 40, (1 << 62)):
        keys = rng.integers(0, top, 300)
        for a, b in zip(suffixlm.distinct(keys), np.unique(keys, return_inverse=True), strict=True):
            assert a.tolist() == b.tolist()
    assert [len(x) for x in suffixlm.distinct(keys[:0])] == [0, 0]


def test_words_go_to_all_shards():
    words = pa.array([b"", *(b"w%d" % i for i in range(2000)), b"ab", b"ba"], pa.large_binary())
    shard = suffixlm.shard_of_words(words, 8)
    assert np.bincount(shard, minlength=8).min() > 150
    assert suffixlm.shard_of_words(words[700:900], 8).tolist() == shard[700:900].tolist()
    assert suffixlm.shard_of_words(words[-2:], 1 << 40)[0] != suffixlm.shard_of_words(words[-2:], 1 << 40)[1]
