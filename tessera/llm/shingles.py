"""Word shingles as 64-bit hashes, in Spark expressions: what decontamination and the Jaccard join share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_lower, words
from .pii import let


def shingle_hashes(text: Column, k: int, short: bool = True) -> Column:
    """Distinct hashes of each k consecutive words, A-Z lowered; short: of the whole sequence if there are fewer words (none: empty)."""

    def of(w: Column) -> Column:
        all_k = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(k)))))
        rest = F.when(F.size(w) > 0, F.array(F.xxhash64(w))) if short else F.lit(None)
        return F.coalesce(F.when(F.size(w) >= k, all_k).otherwise(rest), F.array().cast("array<bigint>"))

    return let(words(ascii_lower(F.coalesce(text, F.lit("")))), of)
