"""Personal data: fixed formats, and identifiers that a bootstrap over contexts discovers.  DataFrame functions only.

Base spans are the matches of four formats, leftmost and non-overlapping for each kind, checked afterwards (parts of an
address, length and Luhn sum of a card number, length of a phone number).

The bootstrap starts from seed instances: values of a known secret format (`SEED`, long hexadecimal strings) and card
numbers.  Each value that stands behind a key (`password=`, `token = "`) is an edge between its lexical pattern (the key,
in lower case, and its delimiters) and the value, the instance.  Spark scores both sides in turn: a pattern by the mean
score of its instances, less for few of them; an instance by the mean of the other patterns that it stands in or, if it
has no other, by what instances of its form (hexadecimal, digits, mixed) are worth on the whole.  Values behind patterns
that end at `threshold` or above, and that were seen with `support` distinct values, are identifiers: kind `secret`.
Counts cover all documents.

A scored pattern reaches every task as a literal if there are at most LITERALS of them, and by a join otherwise.

The regular expressions differ from the plain ones in look-behinds and possessive repeats only, which keep the same
matches without trying each start in a long run again.

Defined results.  Null or empty text: no spans.  Rows are independent in their spans; equal rows count twice in the
scores of their patterns, not in the support.  Null ids stay null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A key with its delimiter, then a value of 8 characters or more with a digit in it.
KEYED = r"((?<![A-Za-z0-9_])[A-Za-z_]{2,}+ ?[=:] ?[\"']?)((?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+)"
SEED = r"^[0-9a-f]{32,}$"
CHUNK, LITERALS = 256, 5000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda captures by expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda x, y: x + y)


def running_sum(sizes: Column) -> Column:
    """Prefix sums (each element included) of an array, chunk by chunk: no step rereads more than a chunk or all chunk sums."""

    def chunk_sums(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / CHUNK)), lambda c: total(F.slice(s, (c * CHUNK + 1).cast("int"), F.lit(CHUNK))))

    def at(s: Column, chunks: Column) -> Column:
        in_chunk = lambda i: total(F.slice(s, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), i % CHUNK + 1))
        return F.transform(s, lambda _, i: total(F.slice(chunks, F.lit(1), F.floor(i / CHUNK).cast("int"))) + in_chunk(i))

    return let(sizes, lambda s: let(chunk_sums(s), lambda c: at(s, c)))


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """Matches as array of (start, end, value), in code points; empty where `possible` is false."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))

    def spans(b: Column) -> Column:
        sizes = F.transform(F.arrays_zip(b["found"].alias("m"), F.slice(b["pieces"], F.lit(1), F.size(b["found"])).alias("p")), lambda x: (F.char_length(x["p"]) + F.char_length(x["m"])).cast("long"))
        ends = F.arrays_zip(running_sum(sizes).alias("end"), b["found"].alias("value"))
        return F.transform(ends, lambda x: F.struct((x["end"] - F.char_length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.coalesce(F.when(possible, let(both, lambda b: F.when(F.size(b["found"]) > 0, spans(b)))), none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def term(d: Column) -> Callable[[Column, Column], Column]:
        x = lambda i: d.substr(F.char_length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return lambda acc, i: acc + x(i) - F.when(x(i) > 9, 9).otherwise(0)

    return let(digits(value), lambda d: F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), term(d)) % 10 == 0)


def small_parts(value: Column) -> Column:
    def fits(part: Column) -> Column:
        p = F.regexp_replace(part, "^0+", "")
        return F.when(F.char_length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), fits)


def span(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> Column:
    """array of (start, rank of the kind, end, kind), sorted."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    n = lambda x: F.char_length(digits(x["value"]))
    by_kind = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda x: F.lit(True)),
        "ip": (IP, digit, lambda x: small_parts(x["value"])),
        "card": (CARD, digit, lambda x: F.when(n(x).between(14, 19), luhn(x["value"])).otherwise(False)),
        "phone": (PHONE, F.contains(text, F.lit("+")) & digit, lambda x: n(x).between(10, 15)),
    }
    parts = []
    for k, (pattern, possible, right) in by_kind.items():
        parts.append(F.transform(F.filter(matches(text, pattern, possible), right), span(k)))
    return F.sort_array(F.concat(*parts))


def keyed_values(text: Column) -> Column:
    """array of (start, end, value, pattern, form) of the values behind keys."""
    text = F.coalesce(text, F.lit(""))
    both = matches(text, KEYED, text.rlike("[=:] ?[\"']?[A-Za-z0-9_-]{8}"))

    def split(x: Column) -> Column:
        key = F.regexp_extract(x["value"], KEYED, 1)
        value = F.regexp_extract(x["value"], KEYED, 2)
        form = F.when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^[0-9a-fA-F]+$"), "hexadecimal").otherwise("mixed")
        return F.struct((x["start"] + F.char_length(key)).alias("start"), x["end"].alias("end"), value.alias("value"), F.lower(key).alias("pattern"), form.alias("form"))

    return F.transform(both, split)


def pattern_scores(docs: DataFrame, rounds: int = 6) -> DataFrame:
    """pattern, score, support (distinct values) from the graph of patterns and instances of all documents."""
    value = F.explode(keyed_values(F.col("text"))).alias("x")
    seen = docs.select(value).select("x.pattern", "x.form", "x.value")
    card = F.when(F.col("value").rlike("^[0-9]{14,19}$"), luhn(F.col("value"))).otherwise(False)
    edges = seen.groupBy("pattern", "form", "value").agg(F.count("*").alias("n"))
    edges = written(edges.withColumn("seed", F.when(F.col("value").rlike(SEED) | card, 1.0).otherwise(0.0)), "edges")
    by_form = lambda x: x.groupBy("form").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("prior"))
    weighed = lambda c: (F.sum(F.col("n") * c) / F.sum("n")).alias("prior")
    prior, scored = edges.groupBy("form").agg(weighed(F.col("seed"))), edges.withColumn("others", F.lit(None).cast("double"))
    for k in range(rounds):
        # a seed counts 1; another instance what its other patterns say or, if it has none, what its form is worth
        belief = scored.join(F.broadcast(prior), "form").withColumn("score", F.greatest("seed", F.coalesce("others", "prior")))  # three rows
        # the two added make a pattern of few values doubtful
        pattern = belief.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 2)).alias("score"), F.count("*").alias("support"))
        if k < rounds - 1:
            met = written(edges.join(pattern, "pattern"), "met")
            prior = met.groupBy("form").agg(weighed(F.greatest("score", "seed")))
            prior = docs.sparkSession.createDataFrame(prior.collect(), "form string, prior double")
            total = met.groupBy("value").agg(F.sum("score").alias("total"), F.count("*").alias("patterns")).where("patterns > 1")
            others = (F.col("total") - F.col("score")) / (F.col("patterns") - 1)
            scored = met.join(total, "value", "left").select("pattern", "form", "value", "n", "seed", others.alias("others"))
    return pattern


def find(docs: DataFrame, threshold: float = 0.5, support: int = 3) -> DataFrame:
    """docs with two more columns (in place of columns of these names): pii_base and pii, arrays of (start, rank, end, kind)
    sorted; pii holds the discovered ones too."""
    return spotted(docs, threshold, support).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("pii_base", "pii")), "pii_base", "pii")


def spotted(docs: DataFrame, threshold: float = 0.5, support: int = 3) -> DataFrame:
    """row (a struct of all columns of docs), pii_base, pii."""
    good = written(pattern_scores(docs).where((F.col("score") >= threshold) & (F.col("support") >= support)).select("pattern"), "patterns")
    n = good.count()

    def free(x: Column) -> Column:
        return ~F.exists(F.col("pii_base"), lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))

    based = docs.select(F.struct("*").alias("row"), F.col("text"), base_spans(F.col("text")).alias("pii_base"))
    if n <= LITERALS:
        known = F.array(*(F.lit(r["pattern"]) for r in good.collect())).cast("array<string>")
        found = F.filter(keyed_values(F.col("text")), lambda x: F.array_contains(known, x["pattern"])) if n else F.array()
        extra = F.transform(F.filter(found, free), span("secret")) if n else F.array()
        kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
        return based.select("row", "pii_base", F.sort_array(F.concat(F.col("pii_base"), extra.cast(kind))).alias("pii"))
    key = F.xxhash64("text")
    values = docs.select(key.alias("of"), F.explode(keyed_values(F.col("text"))).alias("x")).join(good, F.col("x.pattern") == good["pattern"], "left_semi")
    extra = values.groupBy("of").agg(F.collect_set("x").alias("found"))
    joined = based.join(extra, key == F.col("of"), "left")
    merged = F.concat(F.col("pii_base"), F.transform(F.filter(F.coalesce("found", F.array()), free), span("secret")))
    return joined.select("row", "pii_base", F.sort_array(merged).alias("pii"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (sorted) replaced by its kind in brackets; overlapping spans become the first of them."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
