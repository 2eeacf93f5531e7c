"""Locality-sensitive signatures of fingerprints, and the bucket join over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hdc import hashed
from ..functions.vectors import uniform


def minhash(sets: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """(id, h, value): least hash of each set under n hash functions; partial minima meet, not sets."""
    seeds = F.array(*map(F.lit, range(n)))
    rows = sets.select(id_col, F.explode("positions").alias("p")).select(id_col, "p", F.explode(seeds).alias("h"))
    value = hashed(F.concat_ws(":", F.col("h").cast("string"), F.col("p").cast("string")))
    return rows.select(id_col, "h", value.alias("v")).groupBy(id_col, "h").agg(F.min("v").alias("value"))


def signatures(values: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, signature): the values as an array in the order of h."""
    rows = F.array_sort(F.collect_list(F.struct("h", "value")))
    return values.groupBy(id_col).agg(F.transform(rows, lambda x: x["value"]).alias("signature"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def bands(values: DataFrame, rows: int, id_col: str = "id") -> DataFrame:
    """(id, band, bucket): hash of each `rows` consecutive values."""
    band = F.floor(F.col("h") / rows).cast("int")
    parts = F.array_sort(F.collect_list(F.struct("h", "value")))
    joined = F.array_join(F.transform(parts, lambda x: x["value"].cast("string")), ",")
    return values.groupBy(id_col, band.alias("band")).agg(F.md5(joined).alias("bucket"))


def candidate_pairs(buckets: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs (a < b) that share a bucket."""
    a, b = (buckets.select(F.col(id_col).alias(c), "band", "bucket") for c in "ab")
    return a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def bucket_stats(buckets: DataFrame) -> DataFrame:
    sizes = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("buckets"), F.sum("n").alias("items"), F.max("n").alias("largest"), F.avg("n").alias("average"))


def sampled_places(grid: int, n: int, seed: int = 42) -> list[int]:
    return [int(uniform(seed, i) * grid) for i in range(n)]


def bit_sample(positions: Column, places: list[int]) -> Column:
    """Bit i: is place i active (at most 63 places)."""
    total = F.lit(0).cast("long")
    for i, p in enumerate(places):
        total = total + F.when(F.array_contains(positions, p), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return total


def bit_sample_words(positions: Column, places: list[int], word: int = 32) -> Column:
    """The same for any number of places, as an array of numbers of `word` bits each."""
    return F.array(*(bit_sample(positions, places[i : i + word]) for i in range(0, len(places), word)))


def multiprobe(hashes: DataFrame, queries: DataFrame, probes: int, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """(query, id): rows whose hash equals a query's, or differs in one of its first `probes` bits."""
    ways = F.concat(F.array(F.col(hash_col)), F.array(*(F.col(hash_col).bitwiseXOR(F.lit(1 << i)) for i in range(probes))))
    q = queries.select(F.col(id_col).alias("query"), F.explode(ways).alias(hash_col))
    return q.join(hashes.select(id_col, hash_col), hash_col).where(F.col("query") != F.col(id_col)).select("query", id_col).distinct()
