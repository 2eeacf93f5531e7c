from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions import text as T
from tessera.operators import fingerprints as fp
from tessera.operators import vocabulary as vo

ODD = ["", None, "lonely", "ΑΣ..Β ΟΔΟΣ ος it's a.b_c 3.14 İstanbul", "one two", "the cat " * 700 + "end", "x", " a:b ’ l’été"]


def old_tokens(text):
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: T.normalise(t)), lambda t: t.isNotNull())


def test_tokens_are_normalised_one_by_one(spark):
    docs = spark.createDataFrame([(t,) for t in ODD], "text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    assert docs.where(~T.tokens(F.col("text")).eqNullSafe(old_tokens(F.col("text")))).count() == 0


@pytest.mark.parametrize("held", [4_000_000, 500])
def test_fingerprints_in_one_pass(spark, monkeypatch, held):
    monkeypatch.setattr(vo, "TOKENS", 1000)
    monkeypatch.setattr(vo, "HELD", held)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in ODD], "text string"))
    tables = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in docs.select(T.tokens(F.col("text"))).collect()], pa.list_(pa.string()))], ["t"])]
    counted = pa.Table.from_batches(list(vo.counter(256, 2)(iter(tables)))).sort_by("word")
    got = pa.Table.from_batches(list(vo.merger(256, 12)(counted.to_batches(max_chunksize=70)))).to_pylist()
    want = {r["word"]: r for r in fp.word_fingerprints(fp.context_hits(docs, 256), 12).collect()}
    assert {r["word"]: r["positions"] for r in got} == {w: r["positions"] for w, r in want.items()} and len(got) == len(want)
    total = sum(r["hits"] for r in got)
    assert all(r["hits"] / total == want[r["word"]]["frequency"] and r["cardinality"] == len(r["positions"]) for r in got)


def test_hits_move_as_counts(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 20) for i in range(200)], "doc_id long, text string").coalesce(2)
    plan = vo.word_fingerprints(docs, 16384, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") - plan.count("ReusedExchange") == 1


def test_word_counts_of_rows_that_share_an_id(spark, tmp_path):
    rows = [(1, "red fish red"), (1, "red bird"), (2, "red"), (None, "red fish"), (None, "fish"), (3, None)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    n, df = Counter(), {}
    for i, t in rows:
        for w in (t or "").split():
            n[w] += 1
            df.setdefault(w, set()).update({i} - {None})
    assert {r["word"]: (r["n"], r["df"]) for r in Q.word_counts(spark, str(tmp_path)).collect()} == {w: (n[w], len(df[w])) for w in n}
    pq.write_table(pa.table({"item_id": [1], "text": ["red fish"]}), tmp_path / "benchmark.parquet")
    assert {r["word"]: r["df"] for r in Q.frequencies(spark, str(tmp_path)).collect()} == {w: len(x) for w, x in df.items()}
