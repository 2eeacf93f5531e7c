"""Token counts under a unigram vocabulary: one forward pass over a trie of the distinct pre-tokens of a batch.

Sorted pre-tokens spell their trie in preorder: a word opens new nodes only past the prefix it shares with the word
before.  The forward (best-path) score of a node is computed once, from the scores of its last max-piece-length
ancestors, for all nodes of one depth together; every word reads its count at its terminal node.  Documents then add up
the counts of their words, so no row leaves its partition and nothing is shuffled.

A pre-token is U+2581 and one word.  Pieces come from a public vocabulary file, whose merge ranks give each piece the
Zipf log-probability -log((rank + 1) * H); nothing is trained.  A character without a piece costs one byte piece for
each of its UTF-8 bytes.  Between segmentations of equal score the one with the longest last piece stands.

Defined results.  Null or empty text: no pre-tokens and no tokens.  Rows are independent, so repeated rows and ids do
not matter.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytewords import blocks, mix64, word_hashes

MARK = "▁"
LONG_WORD = 64  # characters; longer words go one by one through the same recurrence
_SALT = np.uint64(0x2545F4914F6CDD1D)


def vocabulary(model_file: str) -> tuple[dict[str, float], float]:
    """Zipf log-probability of each piece of a SentencePiece file, and that of a byte piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.vocab_size()
    h = math.log(sum(1 / (r + 1) for r in range(size)))
    pieces = {sp.id_to_piece(i): -math.log(i + 1) - h for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    byte = -math.log(size) - h
    return pieces, byte


def piece_table(pieces: dict[str, float]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (right to left) of the pieces, sorted, with their scores; the longest piece's length."""
    longest = max(map(len, pieces), default=1)
    key = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h = 0
        for t, c in enumerate(reversed(p)):
            h = (h + (ord(c) + 1) * pow(int(_SALT), t + 1, 2**64)) % 2**64
        key[i] = h
    key = mix64(key)
    order = np.argsort(key)
    return key[order], np.fromiter(pieces.values(), float, len(pieces))[order], longest


def count_one(word: str, pieces: dict[str, float], byte: float, longest: int) -> int:
    """The recurrence for a single pre-token."""
    best, count = [0.0], [0]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        s, c = best[e - 1] + n * byte, count[e - 1] + n
        for size in range(1, min(longest, e) + 1):
            p = pieces.get(word[e - size : e])
            if p is not None and best[e - size] + p >= s:
                s, c = best[e - size] + p, count[e - size] + 1
        best.append(s)
        count.append(c)
    return count[-1]


def count_trie(words: list[str], table: tuple[np.ndarray, np.ndarray, int], byte: float) -> np.ndarray:
    """Tokens of each of these distinct pre-tokens, which are sorted by code point."""
    key, score, longest = table
    seen = np.zeros(1 << 20, bool)
    seen[(key >> np.uint64(44)).astype(np.int64)] = True
    power = np.array([pow(int(_SALT), t + 1, 2**64) for t in range(longest)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    n_bytes = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    cell = cp.astype(np.uint64) + np.uint64(1)
    slot = base + np.arange(len(words))  # of each word's empty prefix
    best, count = np.zeros(len(cp) + len(words)), np.zeros(len(cp) + len(words), np.int64)
    shared = np.ones(len(words), bool)  # does the word still share its prefix with the one before
    shared[:1] = False
    active = np.arange(len(words))
    for d in range(int(size.max(initial=0))):
        live = size[active] > d
        # a word that follows one too short to share this depth opens a node
        follows = np.concatenate([[False], live[:-1]])[live]
        active = active[live]
        share = shared[active] & follows
        if len(active) > 1:
            at = base[active] + d
            share[1:] &= cp[at[1:]] == cp[at[:-1]]
        shared[active] = share
        node = np.cumsum(~share) - 1
        rep = active[~share]
        end = base[rep] + d
        s = best[slot[rep] + d] + n_bytes[end] * byte
        c = count[slot[rep] + d] + n_bytes[end]
        h = np.zeros(len(rep), np.uint64)
        for back in range(min(longest, d + 1)):
            h = h + cell[end - back] * power[back]
            q = mix64(h)
            maybe = np.flatnonzero(seen[(q >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            found = np.searchsorted(key, q[maybe])
            hit = key[np.minimum(found, len(key) - 1)] == q[maybe]
            maybe, found = maybe[hit], found[hit]
            from_ = slot[rep[maybe]] + d - back
            v = best[from_] + score[found]
            better = v >= s[maybe]
            maybe = maybe[better]
            s[maybe] = v[better]
            c[maybe] = count[from_[better]] + 1
        best[slot[active] + d + 1] = s[node]
        count[slot[active] + d + 1] = c[node]
    return count[slot + size]


def counter(pieces: dict[str, float], byte: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(pieces)
        for batch in batches:
            hashes, texts, doc, n_words, counts = [], [], [], [], []
            known: np.ndarray = np.zeros(0, np.uint64)
            for b in blocks(batch.column(0)):
                h, first, of = np.unique(word_hashes(b)[:, 0], return_index=True, return_inverse=True)
                new = first[~np.isin(h, known)]
                data = b.data.tobytes()
                texts += [MARK + data[s:e].decode() for s, e in zip(b.start[new].tolist(), b.end[new].tolist(), strict=True)]
                hashes.append(h[~np.isin(h, known)])
                known = np.union1d(known, h)
                doc.append((h, of, b.doc, len(b.n_words)))
                n_words.append(b.n_words)
            short = sorted((t, i) for i, t in enumerate(texts) if len(t) <= LONG_WORD)
            n_of = np.zeros(len(texts), np.int64)
            n_of[[i for _, i in short]] = count_trie([t for t, _ in short], table, byte)
            for i, t in enumerate(texts):
                if len(t) > LONG_WORD:
                    n_of[i] = count_one(t, pieces, byte, table[2])
            all_h = np.concatenate(hashes) if hashes else known
            order = np.argsort(all_h)
            for h, of, d, rows in doc:
                n = n_of[order[np.searchsorted(all_h[order], h)]] if len(h) else np.zeros(0, np.int64)
                counts.append(np.bincount(d, weights=n[of] if len(of) else None, minlength=rows).astype(np.int64))
            none = [np.zeros(0, np.int64)]
            yield pa.record_batch([batch.column(1), pa.array(np.concatenate(n_words or none)), pa.array(np.concatenate(counts or none))], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, n_words (pre-tokens), n_tokens."""
    pieces, byte = vocabulary(model_file)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("text", "doc_id").mapInArrow(counter(pieces, byte), f"doc_id {kind}, n_words long, n_tokens long")
