import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm.pii import digest, find, redacted
from tessera.llm.queries import op2_pii

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for k, (kind, r) in enumerate((("email", E), ("ip", I), ("card", C), ("phone", P))):
        for m in r.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_base_on_the_table_and_discoveries(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    secrets = 0
    for r in op2_pii(spark, "/root/testdata/sf0.01").collect():
        t = docs[r["doc_id"]]
        want = base(t)
        assert r["base_sha256"] == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
        got = set(r["spans"].split(",")) if r["spans"] else set()
        assert {x for x in text_of(want).split(",") if x} <= got
        for x in got:
            k, s, e = x.split(":")
            if k == "secret":
                secrets += 1
                assert re.search(r"(?i)(password=|token = \")$", t[: int(s)]), t[int(s) - 20 : int(e)]
        planted = [m.span(1) for m in re.finditer(r'(?:password=|token = ")([0-9a-f]{8,})', t)]
        assert all(f"secret:{s}:{e}" in got or any(b[0] < e and b[2] > s for b in want) for s, e in planted)
    assert secrets > 5


def test_hard_texts(spark):
    texts = [None, "", "a@b.c_x@d.e@f.g", "a@b", "1.2.3.4.5.6.7.8", "1.2.3.400", "0001.02.3.4", "\U0001f600é x@y.zz 4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111", "+1 (988) 555-2485 +1+123456789012 +1 234", "9" * 2000, "a" * 2000, "1 " * 3000, "a@b.c " * 1000, "99999999999.1.1.1", "+1.2.3.4 56789012 x@1.2.3.4", "7 4111111111111111", "x@@y.z @a.b a@b..c a@-.-"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    got = find(df).select("doc_id", digest(F.col("pii_base")).alias("d"), redacted(F.col("text"), F.col("pii")).alias("r")).collect()
    for r in got:
        assert r["d"] == text_of(base(texts[r["doc_id"]])), texts[r["doc_id"]][:60]
        t = texts[r["doc_id"]]
        if t is not None and not base(t):
            assert r["r"] == t
    long = spark.createDataFrame([("9" * 300_000,), ("a" * 300_000,), ("1 " * 100_000,)], "text string")  # linear time
    assert [r["pii"] for r in find(long).collect()] == [[], [], []]
    assert find(df.limit(0)).collect() == []
    assert next(r["r"] for r in got if r["doc_id"] == 7) == "\U0001f600é [EMAIL] [CARD]"


def test_bootstrap_needs_evidence(spark):
    seeded = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"' for i in range(30)] + [f"password={hashlib.md5(str(i).encode()).hexdigest()[:18]} x" for i in range(30)]
    plain = [f"chapter: section{i}0 of year=2024{i:04d}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(seeded + plain)), "doc_id long, text string")
    n = {r["doc_id"]: len(r["pii"]) for r in find(df).collect()}
    assert all(n[i] == 1 for i in range(60)) and not any(n[i] for i in range(60, 90))
    alone = df.where("doc_id >= 30")  # without the seeds nothing is learnt
    assert not any(r["pii"] for r in find(alone).collect())
