"""Tokens, context windows, n-grams and sentences as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TextConfig

#: Approximates Unicode word boundaries: letters, marks, digits and underscores, joined by one apostrophe, dot or colon.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.:·][\p{L}\p{M}\p{N}_]+)*"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalise(token: Column, config: TextConfig = TextConfig()) -> Column:
    """The token in lower case without ASCII punctuation; null if it is too short or long in bytes."""
    t = F.lower(token) if config.lowercase else token
    t = F.regexp_replace(t, PUNCTUATION, "") if config.strip_punctuation else t
    fits = F.octet_length(t).between(config.min_bytes, config.max_bytes)
    if config.remove_numbers:
        fits = fits & ~t.rlike("^[0-9]*$")
    return F.when(fits, t)


def tokens(text: Column, config: TextConfig = TextConfig()) -> Column:
    """The tokens of a text, each normalised.  A text goes to lower case as a whole, unless it has a capital sigma, whose
    lower case depends on what follows it in the token; few tokens have punctuation to strip."""
    t = F.coalesce(text, F.lit(""))
    found = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    cut = found(t)
    if config.lowercase:
        cut = F.when(F.contains(t, F.lit("Σ")), F.transform(found(t), lambda x: F.lower(x))).otherwise(found(F.lower(t)))
    if config.strip_punctuation:
        marked = lambda x: F.contains(x, F.lit("_")) | F.contains(x, F.lit("'")) | F.contains(x, F.lit(".")) | F.contains(x, F.lit(":"))
        cut = F.transform(cut, lambda x: F.when(marked(x), F.regexp_replace(x, PUNCTUATION, "")).otherwise(x))
    fits = lambda x: F.octet_length(x).between(config.min_bytes, config.max_bytes)
    return F.filter(cut, lambda x: fits(x) & ~x.rlike("^[0-9]*$") if config.remove_numbers else fits(x))


def normalise_text(text: Column, config: TextConfig = TextConfig()) -> Column:
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: normalise(t, config)), lambda t: t.isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda captures by expression is computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def context_windows(toks: Column, half: int) -> Column:
    """array of (center, context): the tokens at most `half` before and after, without the centre."""

    def windows(all_: Column) -> Column:
        before = lambda i: F.slice(all_, F.greatest(i - half, F.lit(0)) + 1, F.least(i, F.lit(half)))
        return F.transform(all_, lambda t, i: F.struct(t.alias("center"), F.concat(before(i), F.slice(all_, i + 2, F.lit(half))).alias("context")))

    return let(toks, windows)


def tokens_by_sentence(sentences: Column, config: TextConfig = TextConfig()) -> Column:
    """The tokens of each sentence of an array of them."""
    return F.transform(sentences, lambda s: tokens(s, config))


def sentence_windows(sentences: Column, half: int, config: TextConfig = TextConfig()) -> Column:
    """Context windows that do not go past a sentence, of all sentences in order."""
    return F.flatten(F.transform(sentences, lambda s: context_windows(tokens(s, config), half)))


def ngrams(toks: Column, n: int) -> Column:
    def grams(all_: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(all_) - n + 1), lambda i: F.array_join(F.slice(all_, i, F.lit(n)), " "))
        return F.when(F.size(all_) >= n, each).otherwise(F.array().cast("array<string>"))

    return let(toks, grams)


_HOLD = "\ue000"  # stands for a full stop that ends no sentence


def sentences(text: Column) -> Column:
    """Rule-based splitter: full stops in abbreviations, initials, numbers and ellipses are protected, the text is cut
    after the others (and after ! and ?, with closing quotes and brackets), and the stops come back."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in (
        (r"\bet al\.", f"et al{_HOLD}"),
        (r"\.\.\.", _HOLD * 3),
        (r"(?<=[0-9])\.(?=[0-9])", _HOLD),
        (r"(?<![0-9A-Za-z])\.(?=[0-9])", _HOLD),
        (r"(?<=[A-Za-z]\.[A-Za-z])\.|(?<=[A-Za-z])\.(?=[A-Za-z]\.)", _HOLD),
        (r"\b([A-Z])\.", f"$1{_HOLD}"),
        (r"\b([A-Z][a-z]{1,3})\.", f"$1{_HOLD}"),
        (r"([.!?])([\"”')\]]+)", "$2$1"),
    ):
        t = F.regexp_replace(t, pattern, to)
    cut = F.split(t, r"(?<=[.!?])(?![.!?])")
    back = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit(_HOLD), F.lit(".")), r"([\"”')\]]+)([.!?])$", "$2$1")))
    return F.filter(back, lambda s: s != "")


def separator(lang: Column) -> Column:
    """What stands between two sentences of a language."""
    return F.when(lang.isin("ja", "km", "my", "zh", "th"), "").otherwise(" ")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


PRIMES = tuple(map(int, "31 43 59 61 73 97 103 113".split()))


def hash_encode(ordinals: Column, buckets: int, n: int = 8) -> Column:
    return F.transform(ordinals, lambda o: F.array(*(F.pmod((o.cast("long") + 1) * p, F.lit(buckets)) for p in PRIMES[:n])))


def safe_name(text: Column, most: int) -> Column:
    kept = F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "")
    return F.replace(F.substring(kept, 1, most), F.lit(" "), F.lit("_"))
