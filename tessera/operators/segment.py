"""Topic segmentation: blocks of sentences, similarities of neighbours, depths, boundaries, segments; windows throughout."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SegmentationConfig
from ..functions import sdr


def blocks(units: DataFrame, block: int, id_col: str = "doc_id") -> DataFrame:
    """(id, block, positions) from units (id, idx, positions): unions of `block` consecutive ones; an incomplete last block is left out."""
    b = F.floor(F.col("idx") / block).cast("int")
    long = units.select(id_col, b.alias("block"), F.explode("positions").alias("position"))
    full = units.groupBy(id_col, b.alias("block")).agg(F.count("*").alias("n")).where(F.col("n") == block)
    sets = long.groupBy(id_col, "block").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    return full.join(sets, [id_col, "block"], "left").select(id_col, "block", F.coalesce("positions", sdr.empty()).alias("positions"))


def gaps(blocked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, gap, similarity) between block gap and block gap + 1."""
    w = Window.partitionBy(id_col).orderBy("block")
    nxt = blocked.withColumn("next", F.lead("positions").over(w)).where(F.col("next").isNotNull())
    return nxt.select(id_col, F.col("block").alias("gap"), F.round(sdr.cosine(F.col("positions"), F.col("next")), 6).alias("similarity"))


def depths(g: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How far a gap lies below the best similarity before it, and after it."""
    w = Window.partitionBy(id_col).orderBy("gap")
    left = F.max("similarity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.max("similarity").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return g.withColumn("depth", F.round(left + right - 2 * F.col("similarity"), 6))


def smoothed(d: DataFrame, sigma: float, id_col: str = "doc_id") -> DataFrame:
    """Depths under a Gaussian kernel, clamped at the ends; unchanged below three gaps."""
    k = math.ceil(3 * sigma)
    weights = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-k, k + 1)]
    w = Window.partitionBy(id_col).orderBy("gap")
    whole = Window.partitionBy(id_col)
    first, last = F.first("depth").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("depth").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = F.lit(0.0)
    for i, x in zip(range(-k, k + 1), weights, strict=True):
        total = total + x / sum(weights) * F.coalesce(F.lag("depth", -i).over(w), first if i < 0 else last)
    return d.withColumn("smooth", F.round(F.when(F.count("*").over(whole) < 3, F.col("depth")).otherwise(total), 6))


def boundaries(s: DataFrame, config: SegmentationConfig = SegmentationConfig(), id_col: str = "doc_id") -> DataFrame:
    """Gaps deeper than mean + depth * deviation of their text."""
    whole = Window.partitionBy(id_col)
    limit = F.avg("smooth").over(whole) + config.depth * F.stddev_pop("smooth").over(whole)
    return s.withColumn("is_boundary", F.col("smooth") > F.round(limit, 6))


def segments(units: DataFrame, marked: DataFrame, block: int, id_col: str = "doc_id") -> DataFrame:
    """(id, segment, first, last, text) from units (id, idx, sentence) and marked gaps; the rest joins the last segment."""
    cuts = marked.where("is_boundary").select(id_col, ((F.col("gap") + 1) * block).cast("int").alias("idx"), F.lit(1).alias("cut"))
    w = Window.partitionBy(id_col).orderBy("idx")
    numbered = units.join(cuts, [id_col, "idx"], "left").withColumn("segment", F.sum(F.coalesce("cut", F.lit(0))).over(w).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda x: x["sentence"]), " ")
    return numbered.groupBy(id_col, "segment").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), text.alias("text"))


def min_size(marked: DataFrame, config: SegmentationConfig = SegmentationConfig(), id_col: str = "doc_id") -> DataFrame:
    """(id, kept): boundary gaps, left to right, at least min_sentences // block blocks apart (0: all)."""
    least = config.min_sentences // config.block
    found = marked.where("is_boundary").groupBy(id_col).agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    if not least:
        return found.withColumnRenamed("gaps", "kept")
    step = lambda acc, g: F.when((F.size(acc) == 0) | (g - F.element_at(acc, -1) >= least), F.concat(acc, F.array(g))).otherwise(acc)
    return found.select(id_col, F.aggregate("gaps", F.array().cast("array<int>"), step).alias("kept"))


def spaced(marked: DataFrame, config: SegmentationConfig = SegmentationConfig(), id_col: str = "doc_id") -> DataFrame:
    """marked with those boundaries alone that leave segments of min_sentences or more."""
    if not config.min_sentences // config.block:
        return marked
    kept = min_size(marked, config, id_col)
    return marked.join(kept, id_col, "left").withColumn("is_boundary", F.coalesce(F.array_contains("kept", F.col("gap")), F.lit(False))).drop("kept")
