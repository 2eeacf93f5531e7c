"""What a sentence model's probabilities need before and after it: cutting, spreading to characters, removed spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def cut_after(text: Column, indices: Column, strip: bool = False) -> Column:
    """The pieces of a text cut after each character index (from 0, ascending) and the white space that follows it."""

    def ends(t: Column) -> Column:
        rest = lambda i: t.substr((i + 2).cast("int"), F.char_length(t))
        return F.transform(indices, lambda i: (i + 1 + F.char_length(rest(i)) - F.char_length(F.regexp_replace(rest(i), r"^\s+", ""))).cast("int"))

    def pieces(b: Column) -> Column:
        t = b["t"]
        starts = F.concat(F.array(F.lit(0)), b["e"])
        stops = F.concat(b["e"], F.array(F.char_length(t)))
        return F.transform(F.arrays_zip(starts.alias("s"), stops.alias("e")), lambda x: t.substr(x["s"] + 1, x["e"] - x["s"]))

    got = let(let(text, lambda t: F.struct(t.alias("t"), ends(t).alias("e"))), pieces)
    got = F.transform(got, lambda s: F.trim(s)) if strip else got
    return F.filter(got, lambda s: s != "")


def above(probabilities: Column, threshold: float) -> Column:
    """Indices whose probability passes a threshold."""
    return F.filter(F.transform(probabilities, lambda p, i: F.when(p > threshold, i)), lambda i: i.isNotNull())


def to_characters(length: Column, logits: Column, ends: Column) -> Column:
    """Logits of tokens, each at the last character of its token (ends: exclusive, ascending); minus infinity elsewhere."""
    at = F.map_from_arrays(F.transform(ends, lambda e: e - 1), logits)
    return let(at, lambda m: F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(float("-inf")))))


def space_positions(text: Column) -> Column:
    return F.filter(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def with_space_probabilities(probabilities: Column, spaces: Column) -> Column:
    """Probabilities of a text without its spaces as those of the text: 0 at the spaces."""
    before = lambda i: F.size(F.filter(spaces, lambda s: s < i))
    total = F.size(probabilities) + F.size(spaces)
    return F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.when(F.array_contains(spaces, i), 0.0).otherwise(F.get(probabilities, i - before(i))))
