import random
import re

import public_tokenizers
from tokenizers import Tokenizer, models

from tessera.llm.tokencount import MARK, count_one, count_trie, piece_table, token_counts, vocabulary

FILE = public_tokenizers.path("piece_bpe_32k.model")


def hf(pieces, byte):
    items = list(pieces.items()) + [(f"<0x{i:02X}>", byte) for i in range(256)]
    return Tokenizer(models.Unigram([("<unk>", 0.0), *items], unk_id=0, byte_fallback=True))


def sample_words(n):
    rng = random.Random(3)
    syll = ["th", "er", "tion", "eau", "é", "ß", "zz", "q", "0", "##", "日", "\U0001f600", "a", "e"]
    return sorted({MARK + "".join(rng.choice(syll) for _ in range(rng.randrange(1, 9))) for _ in range(n)})


def test_trie_equals_single_words():
    pieces, byte = vocabulary(FILE)
    words = sample_words(1500)
    table = piece_table(pieces)
    got = count_trie(words, table, byte)
    assert got.tolist() == [count_one(w, pieces, byte, table[2]) for w in words]


def test_against_another_unigram_implementation():
    pieces, byte = vocabulary(FILE)
    t = hf(pieces, byte)
    for w in sample_words(600):
        if all(c in pieces for c in w):  # characters without a piece are priced otherwise there
            assert count_one(w, pieces, byte, 40) == len(t.encode(w).ids), w


def test_documents(spark):
    pieces, byte = vocabulary(FILE)
    rows = [(1, "The cat the cat\nsat"), (2, None), (3, ""), (4, " \t\x0b "), (None, "é" * 300 + " x"), (1, "The cat the cat\nsat"), (5, "straße 日本 " * 50)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    want = [(i, len(w := re.findall(r"[^\x20\x09-\x0D]+", t or "")), sum(count_one(MARK + x, pieces, byte, 40) for x in w)) for i, t in rows]
    assert sorted(map(tuple, token_counts(df, FILE).collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0), FILE).collect() == []
