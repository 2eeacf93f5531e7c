import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_pairs import shingles, words


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name != "mixture":
            assert docs.columns == columns
        if name == "language":
            assert ids == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
        if name == "near_duplicates":
            sets = {r["doc_id"]: shingles(words(r["text"]), 5) for r in before}
            near = lambda a, b: a and 100 * len(a & b) >= 90 * len(a | b)
            assert not any(near(sets[a], sets[b]) for a in ids for b in ids if a < b)
            assert all(any(near(sets[a], sets[b]) for b in sets if b != a) for a in sets if a not in ids)
        if name == "decontaminate":
            sets = [shingles(words(r["text"]), 5) for r in items]
            leaks = {r["doc_id"] for r in before if any(2 * len(s & shingles(words(r["text"]), 5)) >= len(s) for s in sets)}
            assert ids == {r["doc_id"] for r in before} - leaks and leaks
        if name == "personal_data":
            assert ids == {r["doc_id"] for r in before}
            assert not any(re.search(r"[\w.]@[\w-]+\.\w|password=[0-9a-f]{8}", r["text"]) for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "mixture":
            assert ids == {r["doc_id"] for r in before} and all(r["taken"] <= 2 * r["size"] for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Each stage: nulls in any column, repeated rows, ties, a long text and an empty table; other columns come back as they were."""
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "12 34", None, "src0", 5), (9003, "x" * 50_000 + " mail@a.org " + "y z " * 20_000, None, None, None), (None, "a text of some words", "en", None, 1), some[0], some[0]]
    names = ["lang_pred", "lang_score", "_text", "_lettered", "_key", "_id", "key", "row", "pii", "pii_base", "class", "text_key", "leak", "gone", "n"]
    docs = spark.createDataFrame([*some, *odd], spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce("source", F.lit("-"))).alias(c) for c in names))
    before = None
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []
        got = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "mixture":
            assert got.count() == before
            break
        assert got.columns == docs.columns
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        before = len(rows)
        assert rows and all(r[c] == f"{c}:{r['source'] or '-'}" for r in rows for c in names)
        if name == "language":
            assert not {9001, 9002} & {r["doc_id"] for r in rows} and sum(r["doc_id"] is None for r in rows) == 1
        if name == "near_duplicates":
            assert sum(r["doc_id"] == some[0]["doc_id"] for r in rows) == 1
        if name == "personal_data":
            assert "[EMAIL]" in next(r["text"] for r in rows if r["doc_id"] == 9003)
