"""Near-duplicate documents: a set similarity join filtered under several global token orders.  DataFrame functions only.

Two documents link if the Jaccard similarity of their sets of k-word shingles is at least `percent`.  Equal sets make
one class, so copies cost one row each.  For the classes, a pair that links must share a token among the first
n - ceil(t*n) + 1 of each set under any global order of tokens.  Here there are two orders: shingle hashes upwards from
the least, and upwards from zero and then round; in both, frequent tokens come last, whatever their hash.  The first
shared token also bounds the overlap that is left (position filter), and sizes bound the similarity.  Pairs must pass
under both orders.  Of those that do, the prefixes meet first: the rare tokens that only one of the two holds, as far as
both prefixes reach, are as many as any difference that a link allows, or fewer.  What is left is verified on the whole sets.

Token frequencies are counted over all documents, for the hashes in the fifth of the range from which each order starts
(prefixes lie there).  Frequent are tokens with more than a 1/`frequent` part of all counted occurrences, so there can
be no more than `frequent` of them, and they travel as a literal set.  A wrong guess of what is frequent would cost time
only: any order gives the same pairs.

Components of the link graph come from repeated minima over neighbours with pointer jumping, each round written to the
shared folder.

Defined results.  Null or empty text: no shingles, linked with nothing, a component of its own.  Fewer than k words: the
whole sequence is the one shingle.  Each row is a document: rows that repeat an id or a text are similar to each other.
Null ids are passed over when the least id is taken (null if a component has no other).  Extra columns are ignored.
Sets are compared by 64-bit hashes of their shingles, classes by two of all.  The tables of the way are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratched, written
from .pii import let
from .shingles import shingle_hashes

LEAST = -(1 << 63)
FIFTH = (1 << 64) // 5
ORDERS = (LEAST, 0)  # where each order starts


def _prefix(sets: Column, rare: Column, often: Column, start: int, percent: int) -> Column:
    n = F.size(sets)
    size = n - F.ceil(n * percent / 100).cast("int") + 1

    def turn(a: Column) -> Column:
        return a if start == LEAST else F.concat(F.filter(a, lambda h: h >= start), F.filter(a, lambda h: h < start))

    return F.slice(F.concat(turn(rare), turn(often)), F.lit(1), size)


def _apart(a: str, b: str) -> Column:
    """Tokens that two classes do not share, at least: those in one of the rare prefixes, up to where both reach."""

    def known(c: str) -> Column:
        return F.slice(F.col(f"prefix0_{c}"), F.lit(1), F.col(f"n_rare_{c}"))

    def reach(c: str) -> Column:
        return F.when(F.col(f"all_rare_{c}"), F.lit((1 << 63) - 1)).otherwise(F.coalesce(F.element_at(known(c), -1), F.lit(LEAST)))

    def count(both: Column) -> Column:
        upto = lambda c: F.size(F.filter(both[c], lambda h: h <= both["reach"]))
        return upto("a") + upto("b") - 2 * F.size(F.array_intersect(both["a"], both["b"]))

    return let(F.struct(known(a).alias("a"), known(b).alias("b"), F.least(reach(a), reach(b)).alias("reach")), count)


def _candidates(classes: DataFrame, order: int, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that share a prefix token under this order where sizes and positions allow the similarity."""
    rows = classes.select(F.posexplode(f"prefix{order}").alias("at", "token"), "class", "n").repartition("token")
    left = rows.select("token", F.col("at").alias("at_a"), F.col("class").alias("a"), F.col("n").alias("n_a"))
    right = rows.select("token", F.col("at").alias("at_b"), F.col("class").alias("b"), F.col("n").alias("n_b"))
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    return left.join(right, "token").where(sizes & left_over).select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least `value` reachable) from nodes (node, value) and edges (a, b); nodes without edges included."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    ends = both.select(F.col("a").alias("node")).distinct()
    # a node's label is a node; it gets smaller in the order of (value, node), nulls last
    key = lambda v, n: F.struct(F.col(v).isNull().alias("late"), F.col(v).alias("value"), F.col(n).alias("node"))
    labels = written(nodes.join(ends, "node", "left_semi").select("node", key("value", "node").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = step.select(F.col("node").alias("to"), F.col("least").alias("their"))
        new = step.join(jump, F.col("least.node") == F.col("to"), "left").select("node", F.least("least", F.coalesce("their", "least")).alias("new"), "label")
        new = written(new, "labels")
        changed = new.where(F.col("new") != F.col("label")).limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            break
    out = labels.select("node", F.col("label.value").alias("component"))
    return nodes.join(out.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", F.when(F.col("of").isNull(), F.col("value")).otherwise(F.col("component")).alias("component"))


@scratched
def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 90, frequent: int = 20_000) -> DataFrame:
    """Per row of docs: doc_id, text_key (a hash of its text), n_shingles, n_similar (rows linked with it), component_id."""
    text = F.col("text")
    sets = shingle_hashes(text, k)
    region = F.filter(sets, lambda h: (h < LEAST + FIFTH) | ((h >= 0) & (h < FIFTH)))
    counts = written(docs.select(F.explode(region).alias("token")).groupBy("token").count().where("count >= 64"), "frequent")
    total = counts.agg(F.sum("count")).collect()[0][0] or 0
    often = [r["token"] for r in counts.where(F.col("count") > F.lit(max(64, total // frequent))).select("token").collect()]

    def describe(s: Column) -> Column:
        rare = F.filter(s, lambda h: ~h.isin(often)) if often else s
        hot = F.filter(s, lambda h: h.isin(often)) if often else F.array().cast("array<bigint>")
        both = F.struct(rare.alias("rare"), hot.alias("often"))
        size = F.size(s) - F.ceil(F.size(s) * percent / 100).cast("int") + 1

        def parts(b: Column) -> Column:
            prefixes = (_prefix(s, b["rare"], b["often"], o, percent).alias(f"prefix{i}") for i, o in enumerate(ORDERS))
            n_rare = F.least(F.size(b["rare"]), size).alias("n_rare")
            return F.struct(F.size(s).alias("n"), F.xxhash64(s).alias("x"), F.xxhash64(F.lit(1), s).alias("y"), n_rare, (F.size(b["rare"]) <= size).alias("all_rare"), *prefixes)

        return let(both, parts)

    described = docs.select("doc_id", F.xxhash64("text").alias("text_key"), let(F.sort_array(sets), describe).alias("d")).select("doc_id", "text_key", "d.*")
    rows = written(described, "shingled")
    same = ["n_rare", "all_rare", *(f"prefix{i}" for i in range(len(ORDERS)))]
    firsts = [F.first(p).alias(p) for p in same]
    classes = rows.where("n > 0").groupBy("x", "y", "n").agg(F.count("*").alias("rows"), F.min("doc_id").alias("value"), F.min("text_key").alias("text_key"), *firsts)
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    pairs = _candidates(classes, 0, percent)
    for i in range(1, len(ORDERS)):
        pairs = pairs.join(_candidates(classes, i, percent), ["a", "b"])
    # the rare prefixes are a tenth of the sets, and tell most pairs apart
    known = lambda c: classes.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "prefix0", "n_rare", "all_rare")))
    size = F.col("n_a") + F.col("n_b")
    most = size - 2 * F.ceil(size * percent / (100 + percent)).cast("int")
    pairs = written(written(pairs, "candidates").join(known("a"), "a").join(known("b"), "b").where(_apart("a", "b") <= most).select("a", "b"), "pairs")
    used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    keys = classes.join(used, "class", "left_semi").select("text_key", "class", "x")
    keys = F.broadcast(keys) if keys.count() <= 500_000 else keys
    verify = docs.select(F.xxhash64("text").alias("text_key"), "text").join(keys, "text_key").dropDuplicates(["class"]).select("class", sets.alias("set"))
    verify = written(verify, "sets")
    sized = lambda c: verify.select(F.col("class").alias(c), F.col("set").alias(f"set_{c}"))
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    enough = overlap * (100 + percent) >= (F.size("set_a") + F.size("set_b")) * percent
    links = written(pairs.join(sized("a"), "a").join(sized("b"), "b").where(enough).select("a", "b"), "links")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(classes.select(F.col("class").alias("b"), "rows"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("rows").alias("linked"))
    groups = components(classes.select(F.col("class").alias("node"), "value"), links).withColumnRenamed("node", "class")
    by_class = classes.select("class", "x", "y", "rows").join(linked, "class", "left").join(groups, "class")
    by_class = by_class.select("x", "y", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("others"), "component")
    full = rows.select("doc_id", "text_key", "n", "x", "y").join(by_class, ["x", "y"], "left")
    return full.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("others", F.lit(0))).otherwise(0).cast("long").alias("n_similar"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """docs, with all its columns, with one row of each component: that of the least doc_id (then text); rows without words all stay."""
    near = near_duplicates(docs, **options).where("n_similar > 0")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    dropped = near.where(~least).select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    kept = own.join(dropped, F.col("id").eqNullSafe(F.col("gone")) & (F.col("key") == F.col("gone_key")), "left_anti")
    again = near.where(least).groupBy(F.col("doc_id").alias("shared")).count().where("count > 1").select("shared")
    if again.limit(1).count() == 0:
        return kept.select("row.*")
    # rows that share the least id of their component: the first text of them stays
    mine = F.col("id").eqNullSafe(F.col("shared"))
    first = kept.join(again, mine, "left_semi").dropDuplicates(["id"])
    return kept.join(again, mine, "left_anti").unionByName(first).select("row.*")
