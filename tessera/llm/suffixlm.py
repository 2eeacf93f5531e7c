"""Language-model scores from n-grams of any length: binary search in a suffix array that is cut into shards by content.

A token's context is the text before it, as far back as it still occurs in training.  Then

    p(w | context) = (count(context, w) + a * p0(w)) / (count(context) + a),   a = STRENGTH / 2 ** (length - 1), at least LEAST

with the smoothed unigram p0(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)).  p sums to one over words, end and unknown word.

If d[i:] is the longest match that starts at i and ends before e(i), the context of token p is d[i:p] for the least i with
e(i) >= p, and count(context, w) is count(d[i:p+1]): counts of prefixes of suffixes are all that is asked for.  A document
of the training corpus matches itself from its start, so it asks for its first suffix alone; others ask for all of theirs.
Every word of the corpus moves a fixed number of times:

1. Documents become blocks of about `block_words` word codes.  Each block's vocabulary goes to shards by hash of the word,
   which number the words by frequency and return their counts.
2. Each block's suffixes, cut to DEPTH words and with equal ones counted, go sorted to the shard of their first two words:
   together the shards are the corpus's suffix array.  The suffixes asked for are looked up there by binary search, word
   after word, and the counts of their first two to DEPTH words return; training suffixes learn whether they were met.
3. What matches DEPTH words or more is a few runs of text; equal ones (by SHA-256) are matched once.  A run's first suffix is sought among the training suffixes
   with the same DEPTH words, which are now sent with as much text as can match; these are sorted, and binary search gives
   the longest match and the count of each length.  Where the match ends before the run does, e(i) of further suffixes is
   found by dividing the run (by WAYS in a round): between two suffixes with equal e there is none to ask for.  Rounds are
   logarithmic in the length of a run.

A first pair of words is one shard's, with equal suffixes counted once for each block; the suffixes of DEPTH words that are
many (`hot`) are dealt to parts, each asked for the same text, and their counts add up.

Defined results.  Null or empty text: one token, the end.  Rows are scored one by one, and count in training as often as
they occur.  A null id counts as the text "".  No training documents: p0 alone, with N = V = 0.  Words are compared as
they are, runs as well.  Extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .bytewords import blocks, mix64
from .common import LEAN, keyed, removed, scratched, written

STRENGTH, LEAST = 200.0, 0.05
DEPTH = 4
WAYS = 16  # parts into which a round divides what is left of a run
TOKENS = 1 << 16  # tokens of runs that are scored at once
NONE = np.zeros(0, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on, byte by byte, compressed as one: messages are many and short."""
    head, planes = [bytes([len(arrays)])], []
    for a in arrays:
        top = int(a.max(initial=0))
        size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        head.append(struct.pack("<BQ", size, len(a)))
        a = a.astype(f"<u{size}", copy=False)
        planes += [(a >> 8 * k).astype(np.uint8).tobytes() for k in range(size)]
    return b"".join([*head, pa.compress(b"".join(planes), "zstd", asbytes=True)])


def unpack(blob: bytes) -> list[np.ndarray]:
    start = 1 + 9 * blob[0]
    shapes = list(struct.iter_unpack("<BQ", blob[1:start]))
    raw = pa.decompress(blob[start:], sum(size * n for size, n in shapes), "zstd", asbytes=True)
    out, at = [], 0
    for size, n in shapes:
        planes = np.frombuffer(raw, np.uint8, size * n, at)
        out.append((np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").reshape(n) if size > 1 else planes).astype(np.int64))
        at += size * n
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else NONE


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted keys, or -1."""
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values (from 0 on) and the place of each key among them: one sort of numbers that hold key and place."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> 63 - bits:
        return np.unique(keys, return_inverse=True)
    both = keys << bits | np.arange(len(keys))
    both.sort()
    at = both & (1 << bits) - 1
    both >>= bits
    new = np.concatenate([[True], both[1:] != both[:-1]])
    out = np.empty(len(keys), np.int64)
    out[at] = np.cumsum(new) - 1
    return both[new], out


def by_shard(shard: np.ndarray) -> np.ndarray:
    """Places in the order of their shards (small numbers are sorted by radix)."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")


def spelled(words: np.ndarray, width: int) -> bytes:
    """Numbers of words as bytes that sort as they do."""
    return words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def width_of(top: int) -> int:
    """Bytes of a word number up to top, of which the first is never 255."""
    return next(w for w in range(1, 9) if top < 255 << 8 * (w - 1))


def trimmed() -> None:
    """What a block or a shard took goes back to the system: the workers stay, and share their memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


# 1. blocks and the vocabulary


def shard_of_words(words: pa.LargeBinaryArray, shards: int) -> np.ndarray:
    """A shard for each word: its letters are hashed with their places, and added up."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    size = np.diff(ends)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64((place << 8 | data).astype(np.uint64) + np.uint64(1)))])
    return (mix64(total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]) % np.uint64(shards)).astype(np.int64)


def encoder(block_words: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns text, doc_id, held to one row for each block of documents; the empty word stands for a document's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], []
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24

        def row(ids: list[pa.Array]) -> pa.RecordBatch:
            data, lens, n_words = (np.concatenate([b[k] for b in block]) for k in range(3))
            offsets = np.concatenate([[0], np.cumsum(np.insert(lens, np.cumsum(n_words), 0))])
            words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            codes, spelt = words.indices.to_numpy().astype(np.int64), words.dictionary
            out = np.concatenate(held)
            order = np.argsort(-np.bincount(codes, minlength=len(spelt)), kind="stable")
            codes, spelt = np.argsort(order)[codes], spelt.take(pa.array(order))
            n = np.bincount(codes[np.repeat(~out, n_words + 1)], minlength=len(spelt))
            shard = shard_of_words(spelt, shards)
            sent = []
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                take = spelt.take(pa.array(mine))
                o = np.frombuffer(take.buffers()[1], np.int64, len(take) + 1)
                sent.append({"shard": s, "blob": pack(np.diff(o), n[mine], np.frombuffer(take.buffers()[2], np.uint8) if take.buffers()[2] else NONE)})
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([pack(out, n_words)]), pa.array([pack(codes)]), pa.array([pack(shard)]),
                    pa.array([int((n_words[~out] + 1).sum())], pa.int64()), pa.array([sent], pa.list_(pa.struct([("shard", pa.int32()), ("blob", pa.binary())]))),
                ],
                ["block", "ids", "docs", "codes", "of", "n_train", "sent"],
            )

        ids, size = [], 0
        for batch in batches:
            flags = np.array(batch.column(2).to_pylist(), bool)
            for b in blocks(batch.column(0), lower=True):
                lens = b.end - b.start
                ink = np.zeros(len(b.data) + 1, np.int8)
                ink[b.start] += 1
                ink[b.end] -= 1
                block.append((b.data[np.cumsum(ink[:-1], dtype=np.int8) > 0], lens, b.n_words))
                held.append(flags[b.first : b.first + len(b.n_words)])
                ids.append(batch.column(1).slice(b.first, len(b.n_words)))
                size += len(lens) + len(b.n_words)
                if size >= block_words:
                    yield row(ids)
                    block, held, ids, size, number = [], [], [], 0, number + 1
                    trimmed()
        if block:
            yield row(ids)
            block, held, ids = [], [], []
            trimmed()

    return run


def numbered(shards: int) -> Callable[[pa.Table], pa.Table]:
    """Words of a shard from all blocks to their numbers (from 1, frequent ones first) and counts, for each block."""

    def run(rows: pa.Table) -> pa.Table:
        sent = [unpack(b) for b in rows["blob"].to_pylist()]
        lens, n, letters = (joined(list(x)) for x in zip(*sent, strict=True))
        offsets = np.concatenate([[0], np.cumsum(lens)])
        words = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(letters.astype(np.uint8))]).dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        total = np.bincount(code, weights=n, minlength=len(words.dictionary)).astype(np.int64)
        rank = np.argsort(np.argsort(-total, kind="stable"))
        number = 1 + rank * shards + rows["shard"][0].as_py()
        ends = np.cumsum([len(x[0]) for x in sent])
        out = [pack(number[c], total[c]) for c in np.split(code, ends[:-1])]
        known = [int((total > 0).sum())] + [0] * (len(out) - 1)
        return pa.table({"block": rows["block"], "shard": rows["shard"], "blob": pa.array(out, pa.binary()), "known": pa.array(known, pa.int64()), "top": pa.array([int(number.max(initial=0))] * len(out), pa.int64())})

    return run


def messages(said: pa.Table, kind: int) -> dict[int, bytes]:
    """What the shards say to a block, by shard (kinds 0, 1: of its suffixes; 2: of its words)."""
    rows = said.filter(pa.array([k == kind for k in said["kind"].to_pylist()], pa.bool_()))
    return dict(zip(rows["shard"].to_pylist(), rows["blob"].to_pylist(), strict=True))


def suffixes_of(codes: np.ndarray, left: np.ndarray, top: int) -> np.ndarray:
    """A number for each suffix cut to DEPTH words, in their order.  left: tokens from here to the document's end; codes are below top."""
    n = len(codes)
    code = np.concatenate([codes + 1, np.zeros(DEPTH, np.int64)])
    at = lambda j: np.where(left > j, code[j : j + n], 0)
    pair = distinct(np.append(at(0) * (top + 2) + at(1), 0))[1]
    later = np.where(left > 2, np.concatenate([pair[2:n], [pair[n]] * min(n, 2)]), pair[n])
    return distinct(pair[:n] * (n + 2) + later)[1]


class Block:
    """A block of documents with the numbers and counts of its words, and the distinct starts of its suffixes."""

    def __init__(self, row: pa.Table, said: pa.Table) -> None:
        self.key, self.ids = row["block"][0].as_py(), row["ids"].combine_chunks().flatten()
        held, n_words = unpack(row["docs"][0].as_py())
        (codes,), (of,) = unpack(row["codes"][0].as_py()), unpack(row["of"][0].as_py())
        blobs = messages(said, 2)
        ids, c = (joined(list(x)) for x in zip(*(unpack(blobs[s]) for s in sorted(blobs)), strict=True))
        place = np.argsort(by_shard(of))  # sent shard by shard, in the order of the codes
        small = np.int32 if ids.max(initial=0) < 1 << 31 else np.int64
        self.x, self.c = ids[place].astype(small)[codes], c[place][codes]
        self.held, self.size = held > 0, n_words + 1
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        n = len(codes)
        self.left = ((self.first + self.size)[self.doc] - np.arange(n)).astype(np.int32)  # tokens from here to the document's end
        self.suffix = suffixes_of(codes, self.left, len(of))

    def starts(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct suffixes (cut to DEPTH) among these positions: one position of each, the suffix of each position, counts."""
        of = self.suffix[positions]
        n = np.bincount(of)
        first = np.zeros(len(n), np.int64)
        first[of[::-1]] = positions[::-1]
        met = np.flatnonzero(n)
        return first[met], (np.cumsum(n > 0) - 1)[of], n[met]

    def words(self, at: np.ndarray, j: int) -> np.ndarray:
        if j < 2:  # all that is sent or asked for has two words
            return self.x[at + j]
        return np.where(self.left[at] > j, self.x[np.minimum(at + j, len(self.x) - 1)], 0)

    def training(self) -> np.ndarray:
        return np.flatnonzero(~self.held[self.doc] & (self.left > 1))

    def asked(self) -> np.ndarray:
        start = np.zeros(len(self.x), bool)
        start[self.first] = True
        return np.flatnonzero((self.held[self.doc] | start) & (self.left > 1))


def sender(shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's training suffixes (kind 0) and those asked for (kind 1), by shard."""

    def run(row: pa.Table, said: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(row):
            b = Block(row, said)
            for kind, positions in enumerate((b.training(), b.asked())):
                at, which, n = b.starts(positions)
                if kind:
                    n = np.bincount(which, weights=b.held[b.doc[positions]], minlength=len(at)) > 0  # not only for its own start
                words = [b.words(at, j) for j in range(DEPTH)]
                shard = shard_of(words[0], words[1], shards)
                order = by_shard(shard)
                sent = [x[order] for x in (*words, n)]
                ends = [*(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)] if len(order) else []
                for start, end in zip([0, *ends], ends):  # noqa: B905
                    out[0].append(int(shard[order[start]]))
                    out[1].append(b.key)
                    out[2].append(kind)
                    out[3].append(pack(*(x[start:end] for x in sent)))
            del b, positions, at, which, n, words, shard, order, sent
            trimmed()
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["shard", "block", "kind", "blob"])

    return run


def shard_of(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    pair = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    return (mix64(pair) % np.uint64(shards)).astype(np.int64)


def searcher(rows: pa.Table) -> pa.Table:
    """A shard's sorted suffixes; those asked for get the counts of their first 2 to DEPTH words, training ones a mark:
    1 if someone asks for them, 2 if they are asked for or occur twice."""
    kinds, blobs = rows["kind"].to_pylist(), [unpack(b) for b in rows["blob"].to_pylist()]
    side = [[joined([x[j] for k, x in zip(kinds, blobs, strict=True) if k == kind]) for j in range(DEPTH + 1)] for kind in (0, 1)]
    (train, n), (asked, held) = ((s[:DEPTH], s[DEPTH]) for s in side)
    counts, top = [], max((int(a.max(initial=0)) for a in (*train, *asked)), default=0)
    if top >= 1 << 31:  # small numbers in place of large ones
        seen = np.unique(joined(train))
        train, asked = [find(seen, a) for a in train], [np.where((p := find(seen, a)) < 0, len(seen), p) for a in asked]
        top = len(seen)
    place, wanted = train[0], asked[0]
    for j in range(1, DEPTH):
        keys, place = distinct(place * (top + 1) + train[j])
        wanted = np.where(wanted < 0, -1, find(keys, wanted * (top + 1) + asked[j]))
        total = np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)
        counts.append(np.where(wanted < 0, 0, total[wanted] if len(total) else 0))
    met = np.zeros(len(keys), bool)
    met[wanted[(wanted >= 0) & ((held > 0) | (counts[-1] > 1))]] = True
    mark = (met[place].astype(np.int64) + (met[place] | (total[place] > 1))) if len(place) else NONE
    out, at = [], [0, 0]
    for k, x in zip(kinds, blobs, strict=True):
        part = slice(at[k], at[k] + len(x[0]))
        out.append(pack(*(c[part] for c in counts)) if k else pack(mark[part]))
        at[k] = part.stop
    return pa.table({"block": rows["block"], "shard": rows["shard"], "kind": rows["kind"], "blob": pa.array(out, pa.binary())})


# 2. what a block knows then


def smoothing(length: np.ndarray) -> np.ndarray:
    return np.maximum(STRENGTH / 2.0 ** np.minimum(np.maximum(length - 1, 0), 60), LEAST)


def log_p(length: np.ndarray, count: np.ndarray, both: np.ndarray, base: np.ndarray) -> np.ndarray:
    a = smoothing(length)
    return np.log10(np.where(length > 0, (both + a * base) / (count + a), base))


def resolver(shards: int, n: int, v: int, width: int, doc_id: DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block with what its shards say, to rows of three kinds: documents (0: scores of all tokens but those of runs), runs
    (1: words from `at` on, counts of the words from the first deep token on) and training segments (2: words, starts asked for).
    A word is `width` bytes."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("doc", pa.int64()), ("doc_id", to_arrow_type(doc_id)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("chain", pa.bool_()), ("same", pa.binary()), ("words", pa.binary()), ("more", pa.list_(pa.int64()))])

    def run(row: pa.Table, said: pa.Table) -> pa.Table:
        if not len(row):
            return schema.empty_table()
        b = Block(row, said)
        size = len(b.x)
        count = [b.c] + [np.zeros(size, np.int64) for _ in range(DEPTH - 1)]  # count[j][i]: of the j + 1 words from i on
        mark = np.zeros(size, np.int8)
        for kind, positions in enumerate((b.training(), b.asked())):
            at, which, _ = b.starts(positions)
            order = by_shard(shard_of(b.words(at, 0), b.words(at, 1), shards))
            got = messages(said, kind)
            values = [joined(list(x)) for x in zip(*(unpack(got[s]) for s in sorted(got)), strict=True)]
            for to, value in zip(count[1:] if kind else [mark], values, strict=bool(values)):
                back = np.empty(len(at), np.int64)
                back[order] = value
                to[positions] = back[which]
        del positions, at, which, order, got, values
        base = (b.c + 0.1) / (n + 0.1 * (v + 1))
        pos = np.arange(size)
        p = pos - b.first[b.doc]  # place in the document
        length, c, both = np.zeros(size, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
        trained = ~b.held[b.doc]
        for j in range(1, DEPTH):  # contexts of j words
            start = np.maximum(pos - j, 0)
            ok = (p >= j) & (count[j - 1][start] > 0) & (~trained | (p == j))
            length[ok], c[ok], both[ok] = j, count[j - 1][start[ok]], count[j][start[ok]]
        deep_train = trained & (p >= DEPTH)
        length[deep_train], c[deep_train], both[deep_train] = p[deep_train], 1, 1
        deep = (b.left >= DEPTH) & (count[DEPTH - 1] > 0) & ~trained  # suffixes of DEPTH words or more
        token = np.zeros(size, bool)  # tokens that a run scores
        runs: list[tuple[int, int, int, bool]] = []  # first suffix, number of words, number of tokens to score, is it a training document
        first = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1] & (b.doc[1:] == b.doc[:-1])]))
        last = np.flatnonzero(deep & ~np.concatenate([deep[1:] & (b.doc[1:] == b.doc[:-1]), [False]]))
        for s, e in zip(first.tolist(), last.tolist(), strict=True):
            runs.append((s, e - s + DEPTH, e - s + 1 - int(b.left[e] == DEPTH), False))
        more = np.append(np.flatnonzero((mark == 0) | (b.left < DEPTH)), size)  # a training suffix that occurs once, or is too short
        for s in b.first[(~b.held) & (b.size >= DEPTH)].tolist():
            if count[DEPTH - 1][s] > 1:
                e = int(more[np.searchsorted(more, s)])  # suffixes s to e - 1 occur twice
                words = e - s + DEPTH - 1
                runs.append((s, words, min(words - DEPTH + 1, int(b.left[s]) - DEPTH), True))
        for s, _, tokens, _ in runs:
            token[s + DEPTH : s + DEPTH + tokens] = True
        score = np.zeros(size)
        for s in range(0, size, 1 << 16):
            part = slice(s, s + (1 << 16))
            score[part] = np.where(token[part], 0.0, log_p(length[part], c[part], both[part], base[part]))
        del length, c, both, p, pos
        per = lambda w: np.bincount(b.doc, weights=w, minlength=len(b.size))
        docs = len(b.size)
        on = (mark > 0) & (b.left >= DEPTH) & trained
        seg_first = np.flatnonzero(on & ~np.concatenate([[False], on[:-1] & (b.doc[1:] == b.doc[:-1])]))
        seg_last = np.flatnonzero(on & ~np.concatenate([on[1:] & (b.doc[1:] == b.doc[:-1]), [False]]))
        segments = []
        starts = np.flatnonzero(on & (mark == 2))
        low, high = np.searchsorted(starts, seg_first).tolist(), np.searchsorted(starts, seg_last, "right").tolist()
        for s, e, i, j in zip(seg_first.tolist(), seg_last.tolist(), low, high, strict=True):
            if i < j:
                segments.append((s, e, starts[i:j] - s))
        k = docs + len(runs) + len(segments)
        letters = spelled(b.x, width)
        words = [letters[s * width : (s + w) * width] for s, w, _, _ in runs] + [letters[s * width : (e + DEPTH) * width] for s, e, _ in segments]
        more = [b.c[s + DEPTH : s + DEPTH + t] for s, _, t, _ in runs] + [x for _, _, x in segments]
        whole = lambda values, rest: pa.array([*values, *([None] * rest)])
        columns = [
            pa.array([0] * docs + [1] * len(runs) + [2] * len(segments), pa.int32()), pa.array([b.key] * k, pa.int64()),
            pa.array([*range(docs), *(r[0] for r in runs), *(s[0] for s in segments)], pa.int64()), pa.array([*range(docs), *(int(b.doc[r[0]]) for r in runs), *(int(b.doc[s[0]]) for s in segments)], pa.int64()),
            pa.concat_arrays([b.ids, pa.nulls(k - docs, b.ids.type)]), whole(b.held.tolist(), k - docs), whole(b.size.tolist(), k - docs), whole(per(b.c > 0).astype(np.int64).tolist(), k - docs),
            whole(per(np.log10(base)).tolist(), k - docs), whole(per(score).tolist(), k - docs), pa.array([False] * docs + [r[3] for r in runs] + [False] * len(segments), pa.bool_()),
            pa.array([None] * docs + [hashlib.sha256(struct.pack("<Q", len(x)) + x + y.tobytes()).digest() for x, y in zip(words, more, strict=True)], pa.binary()), pa.array([b""] * docs + words, pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([0] * docs + [len(x) for x in more])]), pa.int32()), pa.array(joined(more), pa.int64())),
        ]
        result = pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
        del b, count, mark, base, score, token, letters, words, columns
        trimmed()
        return result

    return run


# 3. runs


def as_bytes(column: pa.ChunkedArray) -> Iterator[bytes]:
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        ends = np.frombuffer(chunk.buffers()[1], np.int64, len(chunk) + 1, chunk.offset * 8).tolist()
        data = chunk.buffers()[2].to_pybytes() if ends[-1] else b""
        yield from (data[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True))


def common(a: bytes, b: bytes, width: int) -> int:
    """Number of words with which both begin."""
    low, high = 0, min(len(a), len(b)) // width
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: width * mid] == b[: width * mid] else (low, mid - 1)
    return low


def lengths(query: bytes, suffixes: list[bytes], upto: list[int], width: int) -> tuple[list[int], list[int]]:
    """The longest match (DEPTH words at least) of the query with one of the sorted suffixes, and each shorter one that more of
    them have, with their counts."""
    at = bisect_left(suffixes, query)
    match = max((common(query, suffixes[i], width) for i in (at - 1, at) if 0 <= i < len(suffixes)), default=0)
    out: tuple[list[int], list[int]] = ([], [])
    low = high = at
    while match >= DEPTH:
        prefix = query[: width * match]
        low, high = bisect_left(suffixes, prefix, 0, low), bisect_left(suffixes, prefix + b"\xff", high)
        out[0].append(match)
        out[1].append(upto[high] - upto[low])
        match = max((common(query, suffixes[i], width) for i in (low - 1, high) if 0 <= i < len(suffixes)), default=0)
    return out


def matcher(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Suffixes asked for and those of training, of some keys and parts, to the matches."""

    def run(train: pa.Table, asked: pa.Table) -> pa.Table:
        by: dict[int, dict[bytes, int]] = {}
        for part, words, n in zip(train["part"].to_numpy().tolist(), as_bytes(train["words"]), train["n"].to_numpy().tolist(), strict=True):
            same = by.setdefault(part, {})
            same[words] = same.get(words, 0) + n
        arrays = {k: ((order := sorted(rows)), [0, *accumulate(map(rows.__getitem__, order))]) for k, rows in by.items()}
        none: tuple[list[bytes], list[int]] = ([], [0])
        got = [lengths(q, *arrays.get(part, none), width) for part, q in zip(asked["part"].to_numpy().tolist(), as_bytes(asked["words"]), strict=True)]
        return pa.table({"run": asked["run"], "low": asked["low"], "s": asked["s"], "len": pa.array([x for x, _ in got], pa.list_(pa.int64())), "n": pa.array([x for _, x in got], pa.list_(pa.int64()))})

    return run


def run_scores(n: int, v: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs (words, counts of the tokens, and the matches of some of their suffixes) to the sum of their tokens' scores."""

    def sums(chain: pa.Array, more: pa.Array, matches: pa.Array) -> np.ndarray:
        size, met = (x.value_lengths().to_numpy().astype(np.int64) for x in (more, matches))
        first, runs, unigram = np.cumsum(size) - size, np.arange(len(size)), more.flatten().to_numpy()
        s, lens, counts = matches.flatten().flatten()
        s, entries = s.to_numpy().astype(np.int64), lens.value_lengths().to_numpy().astype(np.int64)
        length, count = lens.flatten().to_numpy(), counts.flatten().to_numpy()
        above = np.concatenate([[0], count[:-1]])[: len(count)]
        above[(np.cumsum(entries) - entries)] = 0
        big = int(s.max(initial=0)) + int(length.max(initial=0)) + 2
        # parts of a suffix add up
        keys, of = np.unique(np.repeat(runs, met) * big + s, return_inverse=True)
        run, s = np.divmod(keys, big)
        group = np.arange(len(keys))
        at = np.repeat(of, entries) * big + length
        order = np.argsort(at)
        at, total = at[order], np.concatenate([[0], np.cumsum((count - above)[order])])
        ends = np.searchsorted(at, (group + 1) * big)
        end = s + at[ends - 1] - group * big
        done = np.maximum.accumulate(run * big + end) - run * big  # tokens so far that a suffix of the run has scored
        before = np.where(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)], 0, np.concatenate([[0], done[:-1]])[: len(run)])
        low = np.maximum(before + 1, DEPTH)
        tokens = np.maximum(np.minimum(end, size[run] + DEPTH - 1) - low + 1, 0)
        g = np.repeat(group, tokens)
        place = np.arange(len(g)) - (np.cumsum(tokens) - tokens - low)[g]
        to, words = first[run[g]] + place - DEPTH, place - s[g]
        context, c, both = np.zeros(len(unigram), np.int64), np.zeros(len(unigram), np.int64), np.zeros(len(unigram), np.int64)
        context[to] = words
        c[to], both[to] = (total[ends[g]] - total[np.searchsorted(at, g * big + words + more)] for more in (0, 1))
        own = np.repeat(chain.to_numpy(zero_copy_only=False).astype(np.int64), size)  # the document itself goes on
        p = log_p(context, np.maximum(c, own), np.maximum(both, own), (unigram + 0.1) / (n + 0.1 * (v + 1)))
        return np.bincount(np.repeat(runs, size), weights=p, minlength=len(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy().astype(np.int64))
            deep, i = [np.zeros(0)], 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOKENS, "right")))
                deep.append(sums(*(batch.column(k).slice(i, j - i) for k in (1, 2, 3))))
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(deep))], ["run", "deep"])

    return run


def table(df: DataFrame, label: str, tasks: int) -> DataFrame:
    """df written by so many tasks at most, one after the other what each holds: few files, and few processes for them."""
    return written(df.coalesce(tasks), label, **LEAN)


def match_runs(runs: DataFrame, segments: DataFrame, width: int, hot: int, tasks: int) -> list[DataFrame]:
    """run, low, s, len, n: for suffixes s of the runs (run, chain, words), as many as it takes, their matches among the segments
    (of, words, more, times).  A word is `width` bytes."""
    spark = runs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = lambda words, at=0: F.xxhash64(F.substring(words, F.lit(at) * width + 1, F.lit(DEPTH * width)))
    size = F.expr(f"cast(length(words) div {width} as int)")
    segments = keyed(segments.repartition(buckets, "of"), "segments", "of", buckets, **LEAN)
    starts = segments.select("of", F.explode(F.col("more").cast("array<int>")).alias("start"), "words")
    active = keyed(starts.select(key(F.col("words"), F.col("start")).alias("key"), "of", "start").repartition(buckets, "key"), "active", "key", buckets, **LEAN)
    often = table(active.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("parts")), "often", tasks)
    text = segments.select("of", F.col("words").alias("text"), F.col("times").alias("n"))

    def match(asked: DataFrame) -> DataFrame:
        """asked: run, low, s, words."""
        asked = table(asked.withColumn("key", key(F.col("words"))).join(often, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), "asked", tasks)
        wants = asked.groupBy("key").agg(F.max(F.length("words")).alias("want"), F.max("parts").alias("parts"))
        found = active.join(wants, "key").join(text, "of").select("key", "parts", F.expr(f"substring(text, start * {width} + 1, want)").alias("words"), "n")
        part = F.pmod(F.xxhash64("words"), F.col("parts").cast("long")).cast("int")
        group = F.pmod(F.hash("key", "part"), F.lit(16 * buckets)).alias("group")
        suffixes = found.select("key", part.alias("part"), "words", "n").select(group, "part", "words", "n")
        each = asked.select("run", "low", "s", "words", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(group, "part", "run", "low", "s", "words")
        out = "run long, low int, s int, len array<long>, n array<long>"
        matches = table(suffixes.groupBy("group").cogroup(each.groupBy("group")).applyInArrow(matcher(width), out), "matches", tasks)
        removed(asked)
        return matches

    last = F.when(F.col("chain"), F.lit(0)).otherwise(size - DEPTH)
    ends = F.explode(F.array_distinct(F.array(F.lit(0), last))).alias("s")
    # the last suffix of a run matches DEPTH words
    done = [match(runs.select("run", F.lit(0).alias("low"), ends, "words").withColumn("words", F.expr(f"substring(words, s * {width} + 1, length(words))")))]
    reach = lambda m: m.where(F.size("len") > 0).groupBy("run", "low", "s").agg((F.col("s") + F.max(F.element_at("len", 1))).cast("int").alias("end"))
    first = reach(done[0]).where("s = 0").select("run", F.col("end").alias("low_end"))
    # suffixes between low and high whose matches end between low_end and high_end; words: from low to high_end
    todo = runs.where("not chain").join(first, "run").select("run", F.lit(0).alias("low"), "low_end", last.alias("high"), size.alias("high_end"), "words")
    while True:
        todo = table(todo.where("high - low > 1 and low_end < high_end"), "intervals", tasks)
        if todo.limit(1).count() == 0:
            return done
        probes = F.array_distinct(F.array(*(F.col("low") + F.ceil((F.col("high") - F.col("low")) * (q / WAYS)).cast("int") for q in range(1, WAYS))))
        asked = todo.select("run", "low", "high", "words", F.explode(probes).alias("s")).where("s < high")
        done.append(match(asked.select("run", "low", "s", F.expr(f"substring(words, (s - low) * {width} + 1, length(words))").alias("words"))))
        met = reach(done[-1]).groupBy("run", "low").agg(F.collect_list(F.struct("s", "end")).alias("met"))
        points = F.array_sort(F.concat(F.array(F.struct(F.col("low").alias("s"), F.col("low_end").alias("end"))), "met", F.array(F.struct(F.col("high").alias("s"), F.col("high_end").alias("end")))))
        pairs = F.expr("transform(sequence(1, size(p) - 1), i -> struct(element_at(p, i) as a, element_at(p, i + 1) as b))")
        split = todo.join(met, ["run", "low"]).withColumn("p", points).select("run", F.col("low").alias("was"), "words", F.explode(pairs).alias("x"))
        todo = split.select("run", F.col("x.a.s").alias("low"), F.col("x.a.end").alias("low_end"), F.col("x.b.s").alias("high"), F.col("x.b.end").alias("high_end"), F.expr(f"substring(words, (x.a.s - was) * {width} + 1, (x.b.end - x.a.s) * {width})").alias("words"))


@scratched
def score(docs: DataFrame, held_out: Column, block_words: int = 1_000_000, shard_words: int = 1_000_000, hot: int = 10_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0  # a word has some six bytes
    vocabulary_shards, shards = max(1, -(-total // (24 * shard_words))), max(1, -(-total // (6 * shard_words)))
    buckets = max(many, -(-total // (6 * block_words)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (36 * block_words)))  # six blocks each
    shape = f"block long, ids array<{kind.simpleString()}>, docs binary, codes binary, of binary, n_train long, sent array<struct<shard:int,blob:binary>>"
    columns = docs.select("text", "doc_id", F.coalesce(held_out, F.lit(False)).alias("held"))
    rows = keyed(columns.mapInArrow(encoder(block_words, vocabulary_shards), shape), "blocks", "block", buckets, **LEAN)
    sent = rows.select("block", F.explode("sent").alias("m")).select("block", "m.shard", "m.blob")
    vocabulary = table(sent.groupBy("shard").applyInArrow(numbered(vocabulary_shards), "block long, shard int, blob binary, known long, top long"), "vocabulary", tasks)
    n = rows.agg(F.sum("n_train")).collect()[0][0] or 0
    v, top = vocabulary.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.max("top"), F.lit(0))).collect()[0]
    width = width_of(top)
    said = vocabulary.select("block", "shard", F.lit(2).alias("kind"), "blob")
    rows = rows.select("block", "ids", "docs", "codes", "of")
    suffixes = rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(sender(shards), "shard int, block long, kind int, blob binary")
    answers = written(suffixes.groupBy("shard").applyInArrow(searcher, "block long, shard int, kind int, blob binary"), "answers", **LEAN)
    said = said.unionByName(answers)
    out = f"kind int, block long, at long, doc long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, chain boolean, same binary, words binary, more array<long>"
    known = table(rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(resolver(shards, n, v, width, kind), out), "resolved", tasks)
    removed(rows, vocabulary, answers)
    # what several documents have is matched and scored once
    unique = known.where("kind > 0").groupBy("kind", "chain", "same").agg(F.first("words").alias("words"), F.first("more").alias("more"), F.count("*").alias("times"))
    unique = table(unique.coalesce(tasks).withColumn("of", F.monotonically_increasing_id()), "unique", tasks)
    once, segments = unique.where("kind = 1").withColumnRenamed("of", "run"), unique.where("kind = 2").select("of", "words", "more", "times")
    runs = table(known.where("kind = 1").select("block", "doc", "chain", "same").join(once.select("chain", "same", "run"), ["chain", "same"]).select("block", "doc", "run"), "runs", tasks)
    whole = table(known.where("kind = 0").select("block", "doc", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), "documents", tasks)
    removed(known)
    done = match_runs(once, segments, width, hot, tasks)
    matches = reduce(DataFrame.unionByName, done).where(F.size("len") > 0).groupBy("run").agg(F.collect_list(F.struct("s", "len", "n")).alias("matches"))
    deep = once.select("run", "chain", "more").join(matches, "run").mapInArrow(run_scores(n, v), "run long, deep double")
    deep = runs.join(deep, "run").groupBy("block", "doc").agg(F.sum("deep").alias("deep"))
    scored = whole.join(deep, ["block", "doc"], "left")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"))
