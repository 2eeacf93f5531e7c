"""Algebra of sparse fingerprints.  A fingerprint is a sorted array<int> of distinct positions; all functions give Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

EMPTY = "array<int>"


def empty() -> Column:
    return F.array().cast(EMPTY)


def from_positions(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c.cast(EMPTY)))


def checked(c: Column, size: int) -> Column:
    """Like from_positions, without positions outside [0, size)."""
    return from_positions(F.filter(c, lambda p: (p >= 0) & (p < size)))


def cardinality(a: Column) -> Column:
    return F.size(a)


def sparsity(a: Column, size: int) -> Column:
    return F.size(a) / F.lit(float(size))


def contains(a: Column, position: Column | int) -> Column:
    return F.array_contains(a, position)


def insert(a: Column, position: int, size: int) -> Column:
    return F.array_sort(F.array_union(a, F.array(F.lit(position)))) if 0 <= position < size else a


def remove(a: Column, position: int) -> Column:
    return F.array_remove(a, position)


def overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def xor(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def from_counts(kind: str, i: Column, na: Column, nb: Column) -> Column:
    """A similarity from the overlap and both cardinalities; 0 where it isn't defined."""
    below = {"jaccard": na + nb - i, "overlap": F.least(na, nb), "cosine": F.sqrt(na * nb)}[kind]
    return F.when(below > 0, i / below).otherwise(F.lit(0.0))


def similarity(kind: str, a: Column, b: Column) -> Column:
    return from_counts(kind, overlap_count(a, b), F.size(a), F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    return similarity("jaccard", a, b)


def cosine(a: Column, b: Column) -> Column:
    return similarity("cosine", a, b)


def overlap_similarity(a: Column, b: Column) -> Column:
    return similarity("overlap", a, b)


def distance(kind: str, a: Column, b: Column) -> Column:
    return 1 - similarity(kind, a, b)


def hamming(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - 2 * overlap_count(a, b)


def sparsify(a: Column, most: int) -> Column:
    """The `most` lowest positions."""
    return F.slice(a, 1, most)


def to_dense(a: Column, size: int) -> Column:
    """Runs of zeros between the positions, so the work is that of the grid, not of the grid times the positions."""
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))

    def filled(s: Column) -> Column:
        gaps = F.transform(F.arrays_zip(s.alias("p"), F.concat(F.array(F.lit(-1)), s).alias("q")), lambda x: F.when(x["p"].isNull(), zeros(size - 1 - x["q"])).otherwise(F.concat(zeros(x["p"] - x["q"] - 1), F.array(F.lit(1)))))
        return F.flatten(gaps)

    return let(F.array_sort(F.array_distinct(F.filter(a, lambda p: (p >= 0) & (p < size)))), filled)


def from_dense(dense: Column) -> Column:
    return F.filter(F.transform(dense, lambda v, i: F.when(v > 0, i)), lambda p: p.isNotNull())


def is_subset(a: Column, b: Column) -> Column:
    return overlap_count(a, b) == F.size(a)


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def is_full(a: Column, grid: int) -> Column:
    return F.size(a) == grid


def contains_range(a: Column, start: int, end: int) -> Column:
    """Are all places from start to end - 1 active (an empty range: yes)."""
    return range_cardinality(a, start, end) == max(0, end - start)


def remove_smallest(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def remove_biggest(a: Column, n: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def from_lsb0_bytes(data: Column, offset: int = 0) -> Column:
    """Places of the bits that are set, the least bit of a byte first, from place `offset` on."""
    ones = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(1 << i).alias("one")) for i in range(8)))
    bits = lambda k, b: F.transform(F.filter(ones, lambda x: b.bitwiseAND(x["one"]) != 0), lambda x: (k * 8 + x["i"] + offset).cast("int"))
    byte = lambda h, k: F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    every = let(F.hex(data), lambda h: F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda k: let(byte(h, k), lambda b: bits(k, b))))
    return F.when(F.octet_length(data) > 0, F.flatten(every)).otherwise(empty())


def is_disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def rank(a: Column, position: Column | int) -> Column:
    """How many positions are at most this one."""
    return F.size(F.filter(a, lambda p: p <= position))


def select(a: Column, n: Column | int) -> Column:
    """The n-th smallest position from 0, or null."""
    return F.get(a, n)


def minimum(a: Column) -> Column:
    return F.array_min(a)


def maximum(a: Column) -> Column:
    return F.array_max(a)


def runs(a: Column) -> Column:
    """Number of maximal runs of consecutive positions."""
    return F.size(F.filter(a, lambda p: ~F.array_contains(a, p - 1)))


def insert_range(a: Column, start: int, end: int) -> Column:
    return union(a, F.sequence(F.lit(start), F.lit(end - 1))) if end > start else a


def remove_range(a: Column, start: int, end: int) -> Column:
    return F.filter(a, lambda p: (p < start) | (p >= end))


def range_cardinality(a: Column, start: int, end: int) -> Column:
    return F.size(F.filter(a, lambda p: (p >= start) & (p < end)))


def to_binary_rows(a: Column, dim: int) -> Column:
    """`dim` lines of 0 and 1."""
    bit = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda c: F.array_contains(a, r * dim + c).cast("int").cast("string")), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), bit), "\n")


def to_hex(a: Column, size: int) -> Column:
    """Bytes of eight positions, the least in the least bit."""
    byte = lambda k: F.aggregate(F.filter(a, lambda p: F.floor(p / 8) == k), F.lit(0), lambda x, p: x + F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), p % 8).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit((size + 7) // 8 - 1)), lambda k: F.lower(F.lpad(F.hex(byte(k)), 2, "0"))), "")
