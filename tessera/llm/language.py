"""Language identification by a convolutional network over bytes, trained and applied in numpy.

The network reads windows of WINDOW bytes.  For each width it has a bank of filters over one-hot bytes (so a filter is a
table of 256 values for each of its places); the largest response of a filter in the window, or zero if none is
positive, is a feature; one softmax layer turns the features into probabilities.  Whole texts are applied as consecutive
windows (filters look past a window's end, so no n-gram is lost), and a text's probabilities are the normalised
geometric mean over its windows.

The classifier is fitted on a bounded sample: `per_language` documents of each language, chosen by a hash of doc_id, at
most `max_rows` in all, `spans` spans of each.  Everything else covers all rows and bytes.

Defined results.  Null text, or one without a letter (category L): `und`, score 0.  No labelled rows: every document is
`und`.  Rows are independent, so repeated rows and null ids do not matter (a null id counts as the text "").  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, WIDTHS, FILTERS, PAD = 256, (2, 3, 4), 16, 256
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # one per width: (width, 257, FILTERS); the last byte value is padding, and stays 0
    weights: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    bias: np.ndarray


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of these texts on end, as symbols, and the number of windows of each text."""
    n = np.array([-(-(len(t) + max(WIDTHS) - 1) // WINDOW) if t else 0 for t in texts], np.int64)
    out = np.full(int(n.sum()) * WINDOW + max(WIDTHS), PAD, np.int32)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += k * WINDOW
    return out, n


def train(spans: list[bytes], labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the cross entropy; each max-pooling passes its gradient to the place of its maximum."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        [np.concatenate([rng.normal(0, 0.3, (w, PAD, FILTERS)), np.zeros((w, 1, FILTERS))], 1).astype(np.float32) for w in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    y = np.array([languages.index(x) for x in labels])
    x = np.full((len(spans), WINDOW + max(WIDTHS)), PAD, np.int32)
    for i, s in enumerate(spans):
        s = s[:WINDOW]
        x[i, : len(s)] = np.frombuffer(s, np.uint8)
    params = [*net.tables, net.weights, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            pick = order[i : i + batch]
            xb, rows = x[pick], np.arange(len(pick))
            pooled, places = [], []
            for w, t in zip(WIDTHS, net.tables, strict=True):
                r = sum(t[j][xb[:, j : j + WINDOW]] for j in range(w))
                p = r.argmax(1)
                places.append(p)
                pooled.append(np.maximum(np.take_along_axis(r, p[:, None, :], 1)[:, 0], 0))
            f = np.concatenate(pooled, 1)
            z = f @ net.weights + net.bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[rows, y[pick]] -= 1
            z /= len(pick)
            df = (z @ net.weights.T) * (f > 0)
            grads = []
            for k, (w, t) in enumerate(zip(WIDTHS, net.tables, strict=True)):
                g, d = np.zeros_like(t), df[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, places[k] + j, 1), np.arange(FILTERS)[None, :]), d)
                g[:, PAD] = 0
                grads.append(g)
            grads += [f.T @ z, z.sum(0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def log_probabilities(net: Network, texts: list[bytes], chunk: int = 512) -> np.ndarray:
    """Mean log-probabilities of each text over its windows (0 for an empty one), a chunk of windows at a time."""
    symbols, n = padded(texts)
    # a filter's response to a pair of bytes is one look-up
    pairs = []
    for t in net.tables:
        t = t.copy()
        t[0, PAD] = -1e9  # what starts in the padding may end in the next text: it never is a maximum
        for j in range(0, len(t) - 1, 2):
            pairs.append(np.ascontiguousarray((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS).T))
        pairs += [np.ascontiguousarray(t[-1].T)] if len(t) % 2 else []
    total = int(n.sum())
    out = np.zeros((total, len(net.languages)), np.float32)
    for i in range(0, total, chunk):
        k = min(chunk, total - i)
        s = symbols[i * WINDOW : (i + k) * WINDOW + max(WIDTHS)]
        code = s[:-1] * (PAD + 1) + s[1:]
        size, at = k * WINDOW, 0
        f = np.empty((len(WIDTHS) * FILTERS, k), np.float32)
        for q, w in enumerate(WIDTHS):
            look = [(pairs[at + j // 2], code[j : j + size]) for j in range(0, w - 1, 2)] + ([(pairs[at + w // 2], s[w - 1 : w - 1 + size])] if w % 2 else [])
            at += len(look)
            for c in range(FILTERS):
                r = look[0][0][c].take(look[0][1])
                for t, x in look[1:]:
                    r += t[c].take(x)
                f[q * FILTERS + c] = r.reshape(k, WINDOW).max(1)
        z = np.maximum(f, 0).T @ net.weights + net.bias
        z -= z.max(1, keepdims=True)
        out[i : i + k] = z - np.log(np.exp(z).sum(1, keepdims=True))
    doc = np.repeat(np.arange(len(texts)), n)
    return np.stack([np.bincount(doc, out[:, c], len(texts)) for c in range(out.shape[1])], 1) / np.maximum(n, 1)[:, None]


def predictor(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            lettered = np.array(batch.column(1).to_pylist(), bool)
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            i = 0
            while i < len(texts):  # about 4 MB at once
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 4 << 20):
                    size += len(texts[j])
                    j += 1
                p = log_probabilities(net, [t if k else b"" for t, k in zip(texts[i:j], lettered[i:j], strict=True)])
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for d, (best, value) in enumerate(zip(p.argmax(1).tolist(), p.max(1).tolist(), strict=True)):
                    if lettered[i + d]:
                        pred[i + d], score[i + d] = net.languages[best], value
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(pred), pa.array(score)], [*batch.schema.names[2:], "lang_pred", "lang_score"])

    return run


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def fit(docs: DataFrame, per_language: int = 400, spans: int = 2, max_rows: int = 20_000) -> Network | None:
    """A network for the languages of docs (columns doc_id, text, lang); None without labelled text."""
    length = F.char_length("text")
    cuts = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(length - WINDOW, F.lit(0)) + 1) + 1).cast("int"), F.lit(WINDOW)) for k in range(spans)]
    some = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id").alias("h"), F.array(*cuts).alias("cuts"))
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "cuts"))).where(F.col("r") <= per_language)
    rows = ranked.orderBy("r", "lang").limit(max_rows).collect()
    pairs = [(s.encode(), r["lang"]) for r in rows for s in r["cuts"] if s]
    return train([s for s, _ in pairs], [x for _, x in pairs]) if pairs else None


def identify(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred and lang_score (in place of columns of these names), from the column text alone."""
    return predicted(docs, net).select(*(F.col("row")[c].alias(c) for c in keep if c not in ("lang_pred", "lang_score")), "lang_pred", "lang_score")


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred, lang_score."""
    if net is None:
        return docs.select(F.struct("*").alias("row"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    source = docs.select("text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.struct("*").alias("row"))
    schema = source.select("row").withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema
    return source.mapInArrow(predictor(net), schema)
