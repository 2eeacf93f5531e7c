"""Fingerprints of words and texts.  Long form (key, position) while rows meet, arrays at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hdc
from ..functions import text as T


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, token), idx from 0 over the tokens that survive."""
    return docs.select(id_col, F.posexplode(T.tokens(F.col(text_col))).alias("idx", "token"))


def context_hits(docs: DataFrame, grid: int, half: int = 2, text_col: str = "text") -> DataFrame:
    """(word, position): one hit for each context word of each occurrence, at a place that its hash gives."""
    windows = docs.select(F.explode(T.context_windows(T.tokens(F.col(text_col)), half)).alias("w"))
    pairs = windows.select(F.col("w.center").alias("word"), F.explode("w.context").alias("c"))
    return pairs.select("word", F.pmod(hdc.hashed(F.col("c")), F.lit(grid)).cast("int").alias("position"))


def top_positions(weighted: DataFrame, keys: list[str], weight: str, most: int) -> DataFrame:
    """The `most` heaviest positions of each key (ties: lower position), in long form with their weight."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), "position"))
    return weighted.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def as_arrays(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("position")).alias("positions"))


def word_fingerprints(hits: DataFrame, most: int = 328) -> DataFrame:
    """word, positions, cardinality, frequency (share of all hits) from hits (word, position)."""
    counts = hits.groupBy("word", "position").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    mine = F.sum("n").over(Window.partitionBy("word"))
    kept = top_positions(counts.withColumn("mine", mine), ["word"], "n", most)
    out = kept.groupBy("word").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("mine").alias("mine"))
    return out.crossJoin(F.broadcast(total)).select("word", "positions", F.size("positions").alias("cardinality"), (F.col("mine") / F.col("total")).alias("frequency"))


def weighted_fingerprints(hits: DataFrame, frequencies: DataFrame | None = None, most: int = 328) -> DataFrame:
    """The same from hits (word, position, weight); frequencies (word, frequency), 0 where missing."""
    kept = top_positions(hits.groupBy("word", "position").agg(F.sum("weight").alias("w")), ["word"], "w", most)
    out = as_arrays(kept, ["word"])
    if frequencies is None:
        return out.withColumn("frequency", F.lit(0.0))
    return out.join(frequencies, "word", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))


def upsert(fps: DataFrame, new: DataFrame) -> DataFrame:
    return fps.join(new.select("word"), "word", "left_anti").unionByName(new)


def _token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return token_rows(docs, id_col, text_col).groupBy(id_col, F.col("token").alias("word")).agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def text_fingerprints(docs: DataFrame, fps: DataFrame, how: str = "weighted", most: int = 328, id_col: str = "doc_id", text_col: str = "text", df: DataFrame | None = None, n_docs: int = 0) -> DataFrame:
    """(id, positions) of each text with a known word.

    union: the lowest of all positions; weighted: those that most token occurrences cover; tfidf (and idf, which is the
    same sum): by the sum of tf * ln(n_docs / df) (df 1 where missing).  Tokens are counted before the vocabulary join,
    and positions are added up before any array is made.
    """
    counts = _token_counts(docs, id_col, text_col)
    if how in ("idf", "tfidf"):
        # millionths, so that sums don't depend on their order
        idf = F.round(F.log(F.lit(float(n_docs)) / F.coalesce("df", F.lit(1))) * 1_000_000).cast("long")
        counts = counts.join(df, "word", "left").withColumn("w", F.col("tf") * idf)
    else:
        counts = counts.withColumn("w", F.col("tf"))
    spread = counts.join(fps.select("word", "positions"), "word").select(id_col, "w", F.explode("positions").alias("position"))
    if how == "union":
        low = spread.select(id_col, "position").distinct().withColumn("w", F.lit(0))
        return as_arrays(top_positions(low, [id_col], "w", most), [id_col])
    added = spread.groupBy(id_col, "position").agg(F.sum("w").alias("w"))
    return as_arrays(top_positions(added, [id_col], "w", most), [id_col])


def coverage(docs: DataFrame, fps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, known, total, ratio): tokens in the vocabulary; ratio 1 without tokens."""
    counts = _token_counts(docs, id_col, text_col)
    known = counts.join(fps.select("word", F.lit(1).alias("hit")), "word", "left").groupBy(id_col).agg(F.sum(F.when(F.col("hit") == 1, F.col("tf")).otherwise(0)).alias("known"), F.sum("tf").alias("total"))
    out = docs.select(id_col).join(known, id_col, "left").select(id_col, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("known", "total")))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("known") / F.col("total")))


def stopword_scores(fps: DataFrame, sample: int = 100) -> DataFrame:
    """word, score in [0, 1]: short words, apostrophes, frequent words, and words whose fingerprints overlap (by more than
    0.3 of the smaller) with many of a sample of `sample` words, those of the least MD5."""

    def steps(x: Column, *cases: tuple[float, float]) -> Column:
        out = F.when(x > cases[0][0], cases[0][1])
        for limit, value in cases[1:]:
            out = out.when(x > limit, value)
        return out.otherwise(0.0)

    some = fps.orderBy(F.md5("word"), "word").limit(sample).select(F.col("word").alias("other"), F.size("positions").alias("no"), F.col("positions").alias("op"))
    n = F.broadcast(some.agg(F.count("*").alias("n")))
    bits = some.select("other", "no", F.explode("op").alias("p"))  # sample * bits rows at most
    met = fps.select("word", F.size("positions").alias("nw"), F.explode("positions").alias("p")).join(F.broadcast(bits), "p").where(F.col("word") != F.col("other"))
    close = met.groupBy("word", "nw", "other", "no").agg(F.count("*").alias("i")).where(F.col("i") / F.least("nw", "no") > 0.3).groupBy("word").agg(F.count("*").alias("close"))
    joined = fps.select("word", "frequency").join(close, "word", "left").join(F.broadcast(some.select("other")), F.col("word") == F.col("other"), "left").crossJoin(n)
    others = F.col("n") - F.when(F.col("other").isNull(), 0).otherwise(1)
    ratio = F.when(others > 0, F.coalesce("close", F.lit(0)) / others).otherwise(0.0)
    size = F.octet_length("word")
    short = F.when(size == 1, 0.5).when(size == 2, 0.4).when(size == 3, 0.25).when(size == 4, 0.1).otherwise(0.0)
    mark = F.when(F.col("word").rlike("['’]"), 0.2).otherwise(0.0)
    often = steps(F.col("frequency"), (0.005, 0.4), (0.002, 0.3), (0.001, 0.2), (0.0005, 0.1))
    score = short + mark + often + steps(ratio, (0.5, 0.3), (0.3, 0.2), (0.15, 0.1))
    return joined.select("word", F.round(F.least(score, F.lit(1.0)), 6).alias("score"))
