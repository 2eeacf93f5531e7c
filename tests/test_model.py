import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import NoIndex, SomConfig, WordNotFound
from tessera.operators import fingerprints as fp
from tessera.operators import index as ix
from tessera.operators import lookup as lk
from tessera.operators import vectors as V
from tessera.plans.retina import Retina
from tessera.sources.tables import lines
from tessera.streaming.fingerprints import fingerprint_stream

WORDS = {"king": [1, 2, 3, 100, 101], "queen": [1, 2, 4, 100, 102], "prince": [1, 2, 5, 100, 103], "car": [50, 51, 52, 200, 201]}
CORPUS = ["Our king met a queen near the old harbour", "Another queen and her king crossed the harbour by boat", "Sailors repair every boat before winter", "Winter keeps the boat and its sailors at home", "At home the king reads, and sailors sing"]


@pytest.fixture(scope="module")
def royal(spark):
    rows = [(w, p, len(p), float(len(p))) for w, p in WORDS.items()]
    return Retina(spark.createDataFrame(rows, "word string, positions array<int>, cardinality int, frequency double"), 16)


def test_hits_and_texts(spark):
    hits = spark.createDataFrame([("test", p) for p in (1, 1, 2, 3, 3, 3, 4)], "word string, position int")
    assert fp.word_fingerprints(hits, 3).collect()[0]["positions"] == [1, 2, 3]
    words = spark.createDataFrame([("the", [1, 2, 3]), ("quick", [10, 11, 12]), ("fox", [3, 30])], "word string, positions array<int>")
    docs = spark.createDataFrame([(1, "the quick the fox"), (2, "unknown words"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["positions"] for r in fp.text_fingerprints(docs, words, "weighted", 3).collect()}
    assert got == {1: [1, 2, 3]}
    cov = {r["doc_id"]: (r["known"], r["total"], r["ratio"]) for r in fp.coverage(docs, words).collect()}
    assert cov == {1: (4, 4, 1.0), 2: (0, 2, 0.0), 3: (0, 0, 1.0)}


def test_questions(royal):
    near = [r["word"] for r in royal.similar_words("king", 3).orderBy("rank").collect()]
    assert near[:2] == ["prince", "queen"] and "king" not in near
    assert royal.word_similarity("king", "queen") == pytest.approx(0.6)
    assert royal.center(["king", "queen"]) == [1, 2, 100] and royal.difference("king", "queen") == [3, 101]
    assert royal.analogy("king", "queen", "prince", 1).collect() == []  # none but the operands share a position
    assert royal.analogy("car", "king", "queen", 2).collect()[0]["word"] == "prince"
    with pytest.raises(WordNotFound):
        royal.positions("nobody")
    with pytest.raises(NoIndex):
        Retina(royal.word_fp, 16, indexed=False).similar_indexed([1], 2)
    assert [r["word"] for r in ix.words_at_position(royal.postings, 4).collect()] == ["queen"]
    assert royal.text_similarity("king queen", "queen king") == pytest.approx(1.0)


def test_save_load_and_stream(spark, royal, tmp_path):
    royal.save(str(tmp_path / "m"))
    back = Retina.load(spark, str(tmp_path / "m"))
    assert back.dim == 16 and {r["word"]: r["positions"] for r in back.word_fp.collect()} == WORDS
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "king car"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in" / "a"))
    fingerprint_stream(stream, back, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_training(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join(CORPUS * 3) + "\n\n")
    docs = lines(spark, str(tmp_path / "c.txt"))
    assert docs.count() == 15
    model = Retina.train(docs, SomConfig(dimension=8, weight_dimension=16), epochs=3)
    assert model.contains("king") and model.similar_words("king", 3).count() > 0
    x = np.random.default_rng(0).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    w, m = V.train_batch(df, "v", SomConfig(dimension=6), 5)
    assert m[-1]["qe"] < m[0]["qe"]
    units = {r["id"]: r["unit"] for r in V.assign_units(df, w, "id", "v").collect()}
    assert all(units[i] == int(((w - x[i]) ** 2).sum(1).argmin()) for i in range(0, 400, 7))
    a = V.train_online(x, SomConfig(dimension=4, radius=(2.0, 1.0)), 200)
    assert (a == V.train_online(x, SomConfig(dimension=4, radius=(2.0, 1.0)), 200)).all()
    r, books = V.train_rotation(x, 4, 8, 2)
    assert np.allclose(r @ r.T, np.eye(8)) and len(books) == 4


def test_clusters(spark):
    assert lk.centroid(np.array([0, 1, 127, 128, 128 * 127]), 128) in (0, 127, 128 * 127, 128 * 128 - 1)
    posts = spark.createDataFrame([(p, "w") for p in (0, 1, 16, 120, 121, 136)], "position int, word string")
    got = {r["position"]: r["cluster"] for r in lk.clusters(posts, 16, 2).collect()}
    assert got[0] == got[1] == got[16] != got[120] and got[120] == got[121] == got[136]


def test_command_line(spark, royal, tmp_path, capsys):
    from tessera.__main__ import main

    royal.save(str(tmp_path / "m"))
    main(["similar", str(tmp_path / "m"), "king", "--count", "1"])
    assert "prince" in capsys.readouterr().out
    main(["positions", str(tmp_path / "m"), "4,102"])
    assert "queen" in capsys.readouterr().out
    main(["lookup", str(tmp_path / "m"), "4", "--count", "2"])
    main(["info", str(tmp_path / "m")])
    assert "256" in capsys.readouterr().out
