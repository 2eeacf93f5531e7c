import hashlib
import math
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from tessera import queries as Q

DIM, BITS = 2000, 20


def item(name):
    return {int(hashlib.md5(f"{name}:{b}".encode()).hexdigest()[:15], 16) % DIM for b in range(BITS)}


def elected(vectors, fraction):
    votes = Counter(p for v in vectors for p in v)
    return ",".join(str(p) for p in sorted(votes) if votes[p] >= math.ceil(len(vectors) * fraction))


def turn(v, by):
    return {(p + by) % DIM for p in v}


def trigram(x):
    return item(x[0]) ^ turn(item(x[1]), 1) ^ turn(item(x[2]), 2)


def test_whole_sequences_and_texts(spark, tmp_path):
    users = {1: ["a"], 2: ["a", "b"], 3: ["a"] * 3, 4: ["a", "b", "c"] * 40, 5: list("abcabdabc"), 6: ["b"] * 300}
    rows = [(u, 1_000_000 * 40_000 * (k // 2), e) for u, x in users.items() for k, e in enumerate(x)]
    ids = range(len(rows))
    pq.write_table(pa.table({"event_id": pa.array(ids), "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "user_id": [r[0] for r in rows], "event_type": [r[2] for r in rows]}), tmp_path / "events.parquet")
    got = {r["user_id"]: r["value"] for r in Q.hdc_sequence_whole(spark, str(tmp_path)).collect()}
    assert got == {u: elected([turn(item(e), len(x) - 1 - i) for i, e in enumerate(x)], 0.5) for u, x in users.items()}
    assert "" in got.values() and any(got.values())
    got = {r["user_id"]: r["value"] for r in Q.hdc_ngram_text(spark, str(tmp_path)).collect()}
    assert got == {u: elected([trigram(x[i : i + 3]) for i in range(len(x) - 2)], 0.3) for u, x in users.items()}
    assert got[4] and got[6]


def test_dense_roundtrip_of_the_grid(spark):
    d = "/root/testdata/sf0.001"
    whole = {r["id"]: ",".join(map(str, r["a"])) for r in Q.pairs(spark, d).collect()}
    assert {r["id"]: r["value"] for r in Q.QUERIES["sdr_dense_roundtrip_grid"](spark, d).collect()} == whole


def test_fingerprints_of_all_documents(spark, tmp_path):
    texts = {1: "red fish blue fish one fish", 2: "one red bird sings and one blue bird sings", 3: None, 4: "", 5: "red fish blue fish one fish", 6: "the cat and the dog and the bird " * 40, 7: "lonely"}
    items = {10: "red fish blue fish", 11: "nothing known here"}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": list(items), "text": list(items.values())}), tmp_path / "benchmark.parquet")
    d = str(tmp_path)
    vocabulary = {r["word"]: r["positions"] for r in Q.vocabulary(spark, d).collect()}
    df = Counter(w for t in texts.values() for w in set((t or "").split()))

    def brute(text, how):
        tf, weight = Counter((text or "").split()), Counter()
        for w, n in tf.items():
            for p in vocabulary.get(w, ()):
                weight[p] += 0 if how == "union" else n if how == "weighted" else n * round(math.log(len(texts) / df[w]) * 1_000_000)
        return sorted(sorted(weight, key=lambda p: (-weight[p], p))[: Q.TEXT_BITS])

    for how in ("union", "weighted", "tfidf"):
        got = {r["doc_id"]: r["positions"] for r in Q.QUERIES[f"doc_fp_{how}"](spark, d).collect()}
        assert got == {k: ",".join(map(str, b)) for k, t in texts.items() if (b := brute(t, how))}
    assert {1, 2, 5, 6} <= set(got)
    docs, asked = ({k: set(brute(t, "weighted")) for k, t in x.items()} for x in (texts, items))
    close = {(i, k): round(len(a & b) / len(a | b), 9) for i, a in asked.items() for k, b in docs.items() if a and b and len(a & b) / len(a | b) >= 0.1}
    assert {(r["item_id"], r["doc_id"]): r["similarity"] for r in Q.doc_similarity_pairs(spark, d).collect()} == close and close


def test_equal_ngrams_are_counted_before_their_places(spark):
    plan = Q.hdc_ngram_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    places = next(i for i, line in enumerate(plan) if "Generate explode" in line and "md5" in line)
    assert any("Aggregate" in line and "_items" in line for line in plan[places:])  # below the places
