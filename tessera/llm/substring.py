"""Removal of long repeated spans: a de Bruijn graph of word k-mers whose edges carry their source coordinates.

Edges are the windows of `window` consecutive words.  Writing all of them out would move many times the corpus, so the
graph is compacted before its edges meet.  Each window hangs on its smallest-hash `anchor`-word k-mer (a minimizer:
equal windows choose equal anchors at equal offsets), and consecutive windows on one anchor are a path.

1. Anchors seen once in the corpus: nothing on them repeats; their paths go no further.
2. Repeated anchors on which all paths in the corpus are equal do not branch: the path is one compacted edge.
3. Repeated anchors with unequal paths branch: each of their windows is an edge of its own.

One scan of the texts finds the anchors, with the least and the greatest path on each; a second one gives the compacted
edges.  These meet in Spark once: the least coordinate (doc_id, start) of each is its source, and each document is rewritten
once without the words of the windows at other places.

The sets of repeated and of branching anchors reach the tasks as bit maps of at most 32 MB.  A false hit, or a map that
is full, costs work alone: edges are equal only by their own hashes, two of 64 bits each over two independent hashes of the
words, so that no pair of different edges is taken as equal even among 10^13 of them.

Defined results.  Null text: no words.  Rows with equal doc_id count as the same place: equal rows keep what each would
keep alone, and unequal texts are compared by start.  A null doc_id comes after all others.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import Block, blocks, mix64, sequence_hashes, word_hashes
from .common import scratched, written

MAX_BITS = 1 << 28
SHIFT = 128  # a path has fewer windows than this
PAGE = 1 << 16  # cells of 64 bits: half a megabyte


def anchored_windows(b: Block, h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word of each window of the block that lies in one text, and the place and hash of its anchor."""
    m = len(h) - window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    best = sequence_hashes(h, anchor)
    at, span, spans = np.arange(len(best)), 1, window - anchor + 1
    while span < spans:  # the least hash (the first of equal ones) of `span` anchors, then of twice as many
        step = min(span, spans - span)
        less = best[step:] < best[:-step]
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        span += step
    starts = np.flatnonzero(b.doc[:m] == b.doc[window - 1 :])
    return starts, at[starts], best[starts]


def in_map(bitmap: tuple[int, bytes], anchors: np.ndarray) -> np.ndarray:
    bits, data = bitmap
    bit = (anchors & np.uint64(bits - 1)).astype(np.int64)
    return (np.frombuffer(data, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def paths(b: Block, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Paths of a block: first window, number of windows, anchor, two hashes of the path's words; and two of all windows."""
    h, other = word_hashes(b).T
    starts, at, best = anchored_windows(b, h, window, anchor)
    edges, checks = sequence_hashes(h, window), sequence_hashes(other, window)
    if not len(starts):
        return starts, starts, best, best, best, edges, checks
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    n = np.diff(np.append(head, len(starts)))
    first = starts[head]
    # the first and the last window cover all words of a path
    path, check = (mix64(e[first] * np.uint64(0x9FB21C651E98DF25) + mix64(e[first + n - 1] + n.astype(np.uint64))) for e in (edges, checks))
    return first, n, best[head], path, check, edges, checks


def path_rows(window: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors with the number (2: more than one) of places, and the least and the greatest path on them, for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for b in blocks(batch.column(0)):
                _, _, best, path, *_ = paths(b, window, anchor)  # an anchor's place has one path
                keys.append(best)
                values.append(path)
            key, value = np.concatenate(keys), np.concatenate(values).view(np.int64)
            order = np.argsort(key)
            key, value = key[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            n = np.minimum(np.diff(np.append(first, len(key))), 2)
            low, high = (f.reduceat(value, first) if len(key) else value for f in (np.minimum, np.maximum))
            yield pa.record_batch([pa.array(key[first].view(np.int64)), pa.array(n), pa.array(low), pa.array(high)], ["anchor", "n", "low", "high"])

    return run


def edge_rows(window: int, anchor: int, known: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (n windows from `start` on) of each text: compacted paths, or single windows on branching anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, branching = known.value
        for batch in batches:
            doc_id, tag = batch.column(1), batch.column(2)
            for b in blocks(batch.column(0)):
                first, n, best, path, check, edges, checks = paths(b, window, anchor)
                hit = in_map(repeated, best)
                single = in_map(branching, best[hit])
                first, n, path, check = first[hit], n[hit], path[hit], check[hit]
                some, count = first[single], n[single]
                windows = np.repeat(some, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.concatenate([first[~single], windows])
                edge, check = (np.concatenate([p[~single], e[windows]]).view(np.int64) for p, e in ((path, edges), (check, checks)))
                n = np.concatenate([n[~single], np.ones(len(windows), np.int64)]).astype(np.int8)
                if len(start):
                    doc = b.doc[start]
                    row = pa.array(doc + b.first)
                    yield pa.record_batch([pa.array(edge), pa.array(check), doc_id.take(row), tag.take(row), pa.array((start - b.word0[doc]).astype(np.int32)), pa.array(n)], ["edge", "check", "doc_id", "tag", "start", "n"])

    return run


def rewrite(window: int, text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns text, doc_id, starts (start * SHIFT + number of windows; null: none) to the document without those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, shas = [], [], [], []
            for b in blocks(batch.column(0)):
                starts = batch.column(2).slice(b.first, len(b.n_words))
                edge = np.zeros(len(b.start) + 1, np.int64)
                lens = np.diff(starts.offsets.to_numpy()) * starts.is_valid().to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
                at, n_windows = np.divmod(starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), SHIFT)
                at += np.repeat(b.word0, lens)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n_windows - 1 + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                data = b.data.tobytes()
                for i, (first, count) in enumerate(zip(b.word0.tolist(), b.n_words.tolist(), strict=True)):
                    k = np.flatnonzero(keep[first : first + count]) + first
                    words = b" ".join([data[s:e] for s, e in zip(b.start[k].tolist(), b.end[k].tolist(), strict=True)])
                    n.append(count)
                    gone.append(count - len(k))
                    kept.append(words.decode() if text else None)
                    shas.append(hashlib.sha256(words).hexdigest())
            yield pa.record_batch([batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def bitmap_of(anchors: DataFrame) -> tuple[int, bytes]:
    """Bits of the repeated anchors, at most MAX_BITS of them, and their number.  Built by an aggregation; 32 MB reach the driver at most."""
    n = anchors.count()
    bits = 1 << 20
    while bits < MAX_BITS and bits < 32 * n:
        bits <<= 1
    bit = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    cells = anchors.select((bit / 64).cast("long").alias("cell"), F.expr(f"shiftleft(1L, cast((anchor & {bits - 1}) % 64 as int))").alias("one"))
    whole = cells.groupBy("cell").agg(F.bit_or("one").alias("bits")).withColumn("page", (F.col("cell") / PAGE).cast("long"))
    out = bytearray(bits // 8)
    for r in whole.groupBy("page").applyInArrow(page_bytes, "page long, bytes binary").toLocalIterator():
        out[r["page"] * PAGE * 8 : (r["page"] + 1) * PAGE * 8] = r["bytes"][: len(out)]
    return bits, bytes(out)


def page_bytes(cells: pa.Table) -> pa.Table:
    """The cells of a page (PAGE of them at most) as its bytes."""
    out = np.zeros(PAGE, np.int64)
    out[cells["cell"].to_numpy() % PAGE] = cells["bits"].to_numpy()
    return pa.table({"page": cells["page"][:1], "bytes": pa.array([out.tobytes()], pa.binary())})


def repeated_edges(docs: DataFrame, window: int = 20, anchor: int = 10) -> DataFrame:
    """Rows (doc_id, tag, start, n): n windows from `start` on whose words also start at a smaller (doc_id, start); tag: a
    hash of the text, which tells rows of one doc_id apart."""
    context = docs.sparkSession.sparkContext
    keyed = docs.select("text", "doc_id", F.hash("text").alias("tag"))
    on = keyed.select("text").mapInArrow(path_rows(window, anchor), "anchor long, n long, low long, high long")
    several = on.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1")
    anchors = written(several.select("anchor", (F.col("low") < F.col("high")).alias("branches")), "anchors")
    repeated, branching = bitmap_of(anchors.select("anchor")), bitmap_of(anchors.where("branches").select("anchor"))
    kind = dict(docs.dtypes)["doc_id"]
    edges = keyed.mapInArrow(edge_rows(window, anchor, context.broadcast((repeated, branching))), f"edge long, check long, doc_id {kind}, tag int, start int, n byte")
    # equal places have one rank: those after the first are not its source
    rank = F.rank().over(Window.partitionBy("edge", "check").orderBy(F.col("doc_id").isNull(), "doc_id", "start"))
    return edges.withColumn("rank", rank).where("rank > 1").select("doc_id", "tag", "start", "n")


@scratched
def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = 10, text: bool = True) -> DataFrame:
    """Each document (doc_id, n_words, n_removed, kept: its kept words joined by one space, kept_sha256) without repeated windows.  text=False: kept is null."""
    per_doc = repeated_edges(docs, window, anchor).groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_set(F.col("start").cast("long") * SHIFT + F.col("n")).alias("starts"))
    whole = docs.select("text", "doc_id", F.hash("text").alias("tag"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag"))
    joined = whole.join(per_doc, same, "left").select("text", "doc_id", "starts")
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(rewrite(window, text), f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
