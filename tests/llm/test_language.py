from tessera.llm.language import WINDOW, fit, held_out, identify, log_probabilities, train
from tessera.llm.queries import op9_language_id


def test_held_out_accuracy_and_agreement_with_a_direct_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert len(got) > 150 and right / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_windows_are_all_used():
    import numpy as np

    net = train([b"aaaa", b"zzzz", b"abab", b"zyzy"] * 8, ["x", "y"] * 16, epochs=5)
    texts = [b"", b"a", b"az" * 700, b"z" * WINDOW, b"b" * (WINDOW - 1)]
    got = log_probabilities(net, texts, chunk=2)

    def direct(t):
        rows = []
        for s in range(0, len(t) + 3, WINDOW):
            f = []
            for table in net.tables:
                w = len(table)
                sym = [*t, *[256] * (2 * WINDOW)]
                f += list(np.maximum(np.max([sum(table[j][sym[p + j]] for j in range(w)) for p in range(s, s + WINDOW)], 0), 0))
            z = np.array(f) @ net.weights + net.bias
            rows.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        return np.mean(rows, 0)

    for t, row in zip(texts, got, strict=True):
        if t:
            assert np.allclose(row, direct(t), atol=1e-4)


def test_edge_cases(spark):
    rows = [(1, "le chat et le chien", "fr"), (2, "the cat and the dog", "en"), (3, None, "en"), (4, "", "en"), (5, "12 34 !?", "en"), (None, "the dog", None), (2, "the cat and the dog", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = identify(df, fit(df), ["doc_id", "lang"]).collect()
    assert len(got) == 7
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5)) for r in got)
    empty = df.limit(0)
    assert fit(empty) is None and identify(empty, None, ["doc_id"]).collect() == []
    assert df.where(held_out(df.doc_id, 4, 2)).count() >= 0
