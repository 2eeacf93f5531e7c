"""Words and word sequences of Arrow text columns in numpy: every step is one vector operation over a block of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 4 << 20
FACTOR = 0xD6E8FEB86659FD93


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Block:
    """Consecutive texts: rows first..first+len(n_words)-1 of the batch, their bytes, and where each word lies in them."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, of the texts in data
    start: np.ndarray  # int64, of each word in data
    end: np.ndarray
    doc: np.ndarray  # int64, text of each word, from 0
    n_words: np.ndarray  # int64, of each text
    word0: np.ndarray  # int64, first word of each text


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts (null: empty) in blocks of about `limit` bytes, one whole text at least.  lower: A-Z to a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may span bytes; give it none
        return (yield from blocks(texts.fill_null(b""), lower, limit))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        data, offsets = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if lower:
            data = fold[data]
        ink = ~space[data]
        before = np.empty(len(data) + 1, bool)  # is there ink before, in the same text
        before[0] = False
        before[1:] = ink
        first = offsets[:-1][offsets[:-1] < len(data)]
        before_start = before[:-1].copy()
        before_start[first] = False
        start = np.flatnonzero(ink & ~before_start)
        after = np.empty(len(data), bool)  # is there ink after, in the same text
        after[:-1] = ink[1:]
        after[-1:] = False
        after[first[first > 0] - 1] = False
        end = np.flatnonzero(ink & ~after) + 1
        doc = np.searchsorted(offsets, start, side="right") - 1
        n = np.bincount(doc, minlength=j - i).astype(np.int64)
        yield Block(i, data, offsets, start, end, doc, n, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64))
        i = j


def hashes_of(words: pa.Array) -> np.ndarray:
    """128-bit hashes (XXH3) of binary words, as two columns of 64 bits."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, words.to_pylist())), np.uint64).reshape(-1, 2)


def word_hashes(b: Block) -> np.ndarray:
    """The hashes of all words of a block: each distinct word is hashed once."""
    ink = np.zeros(len(b.data) + 1, np.int8)
    ink[b.start] += 1
    ink[b.end] -= 1
    offsets = np.concatenate([[0], np.cumsum(b.end - b.start)]).astype(np.int64)
    letters = b.data[np.cumsum(ink[:-1], dtype=np.int8) > 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(b.start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return hashes_of(words.dictionary)[words.indices.to_numpy()]


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (one column of their hashes), whatever text they are in: the caller keeps those inside one."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h, size = words, 1
    for bit in bin(k)[3:]:  # of `size` words, then of twice as many, then of one more
        h = h[:-size] * np.uint64(pow(FACTOR, size, 1 << 64)) + h[size:]
        size *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(FACTOR) + words[size:]
            size += 1
    return mix64(h)
