"""Benchmark decontamination: exact prefix filter on shingle sets, verified exactly.  DataFrame functions only.

An item is contained in a document if `percent` of its distinct k-word shingles, or more, are among the document's.
The filter replaces size-partitioned MinHash, whose recall is below one: documents get no sketch.  An item of
n shingles keeps the s = n - ceil(percent * n) + 1 least hashes of its set: so many that a containing document must hold one of them, however long it is, because at
most n - ceil(percent * n) shingles can be missing.  A document looks its shingles up in the sketches (those above the
largest sketch value are dropped before any join); the pairs found are counted exactly on the full sets.

An item of fewer than k words is one shingle of all its words, and documents are cut to that length for it too.

The sketches, and the documents found, are broadcast while they number at most `broadcast_rows`, and shuffled beyond.
Hashes are 64 bits.

Defined results.  Null or empty text or item: contained in nothing, contains nothing.  Rows with equal id and text count
as one document (one item).  Null ids stay null.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratched, words, written
from .shingles import shingle_hashes


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


@scratched
def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 50, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, key (hash of the document's row), item_id, n_item, n_common (shingles), containment: all pairs that reach `percent`."""
    text = F.col("text")
    lengths = items.select(F.size(words(text)).alias("n")).where(F.col("n").between(1, k - 1)).distinct().collect()
    item = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), F.least(F.size(words(text)), F.lit(k)).alias("cut"), shingle_hashes(text, k).alias("set"))
    item = item.where(F.size("set") > 0).dropDuplicates(["item_key"])
    n = F.size("set")
    need = F.ceil(n * percent / 100).cast("int")
    sketch = F.slice(F.sort_array("set"), F.lit(1), n - need + 1)
    item = written(item.select("item_id", "item_key", "cut", "set", n.alias("n_item"), need.alias("need"), sketch.alias("sketch")), "items")
    top = item.agg(F.max(F.element_at("sketch", -1)).alias("top")).collect()[0]["top"]
    out = "doc_id {}, key long, item_id {}, n_item int, n_common long, containment double".format(dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"])
    if top is None:
        return docs.sparkSession.createDataFrame([], out)

    cuts = [k, *(r["n"] for r in lengths)]

    def rows_of(d: DataFrame, below: int | None) -> DataFrame:
        """(…, cut, h): the shingles of documents, for every length that an item has."""
        parts = [shingle_hashes(text, c, False) for c in cuts]
        parts = [F.filter(p, lambda h: h <= F.lit(below)) if below is not None else p for p in parts]
        cells = F.array(*(F.struct(F.lit(c).alias("cut"), p.alias("set")) for c, p in zip(cuts, parts, strict=True)))
        if len(cuts) == 1:
            return d.select("doc_id", "key", F.lit(k).alias("cut"), F.explode(parts[0]).alias("h"))
        return d.select("doc_id", "key", F.explode(cells).alias("c")).select("doc_id", "key", "c.cut", F.explode("c.set").alias("h"))

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    sketches = _sized(item.select("cut", "item_key", F.explode("sketch").alias("h")), broadcast_rows)
    pairs = written(rows_of(keyed, top).join(sketches, ["cut", "h"]).select("key", "item_key").distinct(), "pairs")
    hit = _sized(pairs.select("key").distinct(), broadcast_rows)
    found = keyed.join(hit, "key", "left_semi").dropDuplicates(["key"])
    full = _sized(item.select("cut", "item_key", F.explode("set").alias("h")), broadcast_rows)
    common = rows_of(found, None).join(full, ["cut", "h"]).groupBy("doc_id", "key", "item_key").agg(F.count("*").alias("n_common"))
    checked = common.join(pairs, ["key", "item_key"]).join(item.select("item_id", "item_key", "n_item", "need"), "item_key").where("n_common >= need")
    return checked.select("doc_id", "key", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    leaks = contained(docs, items, **options).select(F.col("key").alias("leak")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return own.join(leaks, F.col("key") == F.col("leak"), "left_anti").select("row.*")
