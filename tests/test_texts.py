import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions import scan
from tessera.operators import fingerprints as fp
from tessera.operators import index as ix
from tessera.operators import texts as tx

ODD = [(None, "the cat"), (None, "and the dog"), (10_001, None), (10_002, ""), (3, "shares an id with another"), (10_003, "the of " * 20_000)]


def rows_of(df, key):
    return sorted(tuple(r) for r in df.select(key, "positions").collect() if r[0] is not None), [tuple(r) for r in df.where(F.col(key).isNull()).select(key, "positions").collect()]


@pytest.mark.parametrize("common,how", [(100, "weighted"), (100, "tfidf"), (3, "union"), (1 << 17, "tfidf"), (1, "weighted")])
def test_common_and_rare_words_as_one(spark, monkeypatch, tmp_path, common, how):
    monkeypatch.setattr(tx, "COMMON", common)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    pq.write_table(pa.Table.from_pylist([r.asDict() for r in docs.collect()]), tmp_path / "documents.parquet")
    d = str(tmp_path)
    docs = spark.read.parquet(d + "/documents.parquet")
    words = Q.vocabulary(spark, d)
    more = {"df": Q.frequencies(spark, d), "n_docs": docs.count()} if how == "tfidf" else {}
    new = tx.text_fingerprints(docs, words, Q.GRID, how, 100, **more)
    old = fp.text_fingerprints(docs, words, how, 100, **more)
    assert rows_of(new, "doc_id") == rows_of(old, "doc_id") and len(rows_of(new, "doc_id")[0]) > 150


def test_places_of_words_are_not_exploded(spark):
    d = "/root/testdata/sf0.001"
    for name in ("doc_fp_union", "doc_fp_weighted", "doc_fp_tfidf"):
        assert "Generate" not in Q.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString(), name


def test_similar_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 2)
    sets = {i: list(range(i, i + 9)) for i in range(30)} | {99: []}
    rows = spark.createDataFrame(list(sets.items()), "name long, positions array<int>")
    got = {(r["query"], r["name"]): r["similarity"] for r in ix.similar_to(rows.where("name < 7").withColumnRenamed("name", "query"), rows, 0.2, "query", "name").collect()}
    assert got == {(a, b): round(x, 9) for a in range(7) for b in sets if (x := len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))) >= 0.2}
