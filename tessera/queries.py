"""A query for each group of operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import SegmentationConfig
from .functions import grid as G
from .functions import hdc, sdr
from .functions import text as T
from .functions import vectors as VF
from .operators import aggregates as A
from .operators import fingerprints as fp
from .operators import index as ix
from .operators import lookup as lk
from .operators import lsh
from .operators import segment as sg
from .operators import texts as tx
from .operators import vectors as V
from .operators import vocabulary as vo
from .sources.tables import stored, table

DIM, GRID, WORD_BITS, TEXT_BITS, PLANES = 128, 16384, 40, 100, VF.hyperplanes(64, 16)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def text_of(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# fingerprints of customers: the parts that they ordered
CUST = f"cust AS (SELECT o_custkey AS id, list_sort(list_distinct(list((l_partkey % {GRID})::INT))) AS positions FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"
PAIR = f"WITH {CUST}, p AS (SELECT a.id, a.positions AS a, b.positions AS b, list_filter(a.positions, lambda x: list_contains(b.positions, x)) AS i FROM cust a JOIN cust b ON b.id = a.id + 1)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    """id, positions: made once in a session, as most queries need them more than once."""
    return stored(spark, "customers", d, lambda: ordered_parts(spark, d))


def ordered_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % GRID).cast("int").alias("p"))
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    return lines.join(owner, "l_orderkey").groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("positions"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    return c.select("id", F.col("positions").alias("a")).join(c.select((F.col("id") - 1).alias("id"), F.col("positions").alias("b")), "id")


def join_list(x: str) -> str:
    return f"array_to_string({x}, ',')"


def measure(x: str) -> str:
    n = {"jaccard": "(len(a) + len(b) - len(i))", "overlap": "least(len(a), len(b))", "cosine": "sqrt(len(a) * len(b))"}[x]
    return f"round(CASE WHEN {n} > 0 THEN len(i) / {n} ELSE 0 END, 9)"


for _name, _column, _sql in (
    ("sdr_overlap", lambda a, b: text_of(sdr.overlap(a, b)), join_list("i")),
    ("sdr_union", lambda a, b: text_of(sdr.union(a, b)), join_list("list_sort(list_distinct(list_concat(a, b)))")),
    ("sdr_xor", lambda a, b: text_of(sdr.xor(a, b)), join_list("list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: NOT list_contains(i, x)))")),
    ("sdr_minus", lambda a, b: text_of(sdr.minus(a, b)), join_list("list_filter(a, lambda x: NOT list_contains(b, x))")),
    ("sdr_overlap_count", lambda a, b: sdr.overlap_count(a, b), "len(i)::INT"),
    ("sdr_jaccard", lambda a, b: F.round(sdr.jaccard(a, b), 9), measure("jaccard")),
    ("sdr_cosine", lambda a, b: F.round(sdr.cosine(a, b), 9), measure("cosine")),
    ("sdr_overlap_similarity", lambda a, b: F.round(sdr.overlap_similarity(a, b), 9), measure("overlap")),
    ("sdr_distance", lambda a, b: F.round(sdr.distance("cosine", a, b), 9), f"round(1 - {measure('cosine')}, 9)"),
    ("sdr_hamming", lambda a, b: sdr.hamming(a, b), "(len(a) + len(b) - 2 * len(i))::INT"),
    ("sdr_subset_disjoint", lambda a, b: F.concat(sdr.is_subset(F.slice(a, 1, 1), b).cast("string"), sdr.is_disjoint(a, b).cast("string")), "list_has_all(b, a[1:1])::VARCHAR || (len(i) = 0)::VARCHAR"),
    ("sdr_predicates", lambda a, b: F.concat_ws(":", sdr.is_superset(b, F.slice(a, 1, 2)).cast("string"), sdr.is_empty(sdr.overlap(a, b)).cast("string"), sdr.is_full(a, GRID).cast("string"), sdr.contains_range(sdr.insert_range(a, 100, 105), 101, 106).cast("string")), f"concat_ws(':', list_has_all(b, a[1:2])::VARCHAR, (len(i) = 0)::VARCHAR, (len(a) = {GRID})::VARCHAR, list_contains(a, 105)::VARCHAR)"),
    ("sdr_remove_ends", lambda a, b: F.concat_ws("|", text_of(sdr.remove_smallest(a, 2)), text_of(sdr.remove_biggest(b, 1))), join_list("a[3:]") + " || '|' || " + join_list("b[1:len(b) - 1]")),
    ("sdr_bytes", lambda a, b: text_of(sdr.from_lsb0_bytes(F.unhex(sdr.to_hex(F.filter(a, lambda p: p < 512), 512)), 7)), join_list("list_transform(list_filter(a, lambda x: x < 512), lambda x: x + 7)")),
    ("sdr_sparsify", lambda a, b: text_of(sdr.sparsify(sdr.union(a, b), 10)), join_list("list_sort(list_distinct(list_concat(a, b)))[1:10]")),
    ("sdr_insert_remove", lambda a, b: text_of(sdr.remove(sdr.insert(a, 77, GRID), 5)), join_list("list_filter(list_sort(list_distinct(list_append(a, 77))), lambda x: x <> 5)")),
    ("sdr_rank_select", lambda a, b: F.concat_ws(":", sdr.rank(a, 1000).cast("string"), sdr.select(a, 2).cast("string"), sdr.minimum(a).cast("string"), sdr.maximum(a).cast("string")), "concat_ws(':', len(list_filter(a, lambda x: x <= 1000)), a[3], a[1], a[len(a)])"),
    ("sdr_runs", lambda a, b: sdr.runs(a), "len(list_filter(a, lambda x: NOT list_contains(a, x - 1)))::INT"),
    ("sdr_ranges", lambda a, b: text_of(sdr.remove_range(sdr.insert_range(a, 100, 110), 105, 600)), join_list("list_filter(list_sort(list_distinct(list_concat(a, range(100, 110)::INT[]))), lambda x: x < 105 OR x >= 600)")),
    ("sdr_sparsity", lambda a, b: F.round(sdr.sparsity(a, GRID), 9), f"round(len(a) / {GRID}.0, 9)"),
    ("sdr_dense_roundtrip", lambda a, b: text_of(sdr.from_dense(sdr.to_dense(F.filter(a, lambda p: p < 256), 256))), join_list("list_filter(a, lambda x: x < 256)")),
    ("sdr_dense_roundtrip_grid", lambda a, b: text_of(sdr.from_dense(sdr.to_dense(a, GRID))), join_list("a")),
):

    def _run(spark: SparkSession, d: str, column: Callable[[Column, Column], Column] = _column) -> DataFrame:
        return pairs(spark, d).select("id", column(F.col("a"), F.col("b")).alias("value"))

    _run.__name__ = _name
    query(f"{PAIR} SELECT id, {_sql} AS value FROM p")(_run)


# aggregates of customers' fingerprints by nation
MEMBERS = f"WITH {CUST}, m AS (SELECT c_nationkey AS k, id, positions FROM cust JOIN customer ON c_custkey = id), n AS (SELECT k, count(*) AS members FROM m GROUP BY 1), v AS (SELECT k, p, count(*) AS votes FROM (SELECT k, unnest(positions) AS p FROM m) GROUP BY ALL)"


def members(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    return customers(spark, d).join(nation, "id").select("k", "id", "positions")


for _name, _agg, _sql in (
    ("sdr_union_agg", lambda m: A.union_agg(m, ["k"]), "true"),
    ("sdr_intersection_agg", lambda m: A.intersection_agg(m, ["k"]), "votes = members"),
    ("sdr_xor_agg", lambda m: A.xor_agg(m, ["k"]), "votes % 2 = 1"),
    ("semantic_center", lambda m: A.center(m, ["k"]), "votes > members // 2"),
    ("hdc_bundle", lambda m: hdc.bundle(m, ["k"], "positions", 0.03), "votes >= ceil(members * 0.03)"),
    ("hdc_bundle_weighted", lambda m: hdc.bundle_weighted(m.withColumn("w", F.when(F.col("id") % 10 == 0, 100).otherwise(1)), ["k"], "positions", "w"), ""),
):

    def _run(spark: SparkSession, d: str, agg: Callable[[DataFrame], DataFrame] = _agg) -> DataFrame:
        return agg(members(spark, d)).select("k", text_of(F.col("positions")).alias("value"))

    _run.__name__ = _name
    if _sql:
        query(f"{MEMBERS} SELECT k, string_agg(p, ',' ORDER BY p) AS value FROM v JOIN n USING (k) WHERE {_sql} GROUP BY k")(_run)
    else:
        _weighted = MEMBERS.replace("count(*) AS members", "sum(CASE WHEN id % 10 = 0 THEN 100 ELSE 1 END) AS members").replace("count(*) AS votes FROM (SELECT k, unnest", "sum(w) AS votes FROM (SELECT k, CASE WHEN id % 10 = 0 THEN 100 ELSE 1 END AS w, unnest")
        query(f"{_weighted} SELECT k, string_agg(p, ',' ORDER BY p) AS value FROM v JOIN n USING (k) WHERE votes >= 0.5 * members GROUP BY k")(_run)


# geometry
PLACES = f"WITH g AS (SELECT p_partkey AS k, (p_partkey % {GRID})::INT AS a, (p_partkey * 7919 % {GRID})::INT AS b FROM part), r AS (SELECT *, a // {DIM} AS ra, a % {DIM} AS ca, b // {DIM} AS rb, b % {DIM} AS cb FROM g), q AS (SELECT *, least(abs(ra - rb), {DIM} - abs(ra - rb)) AS dr, least(abs(ca - cb), {DIM} - abs(ca - cb)) AS dc FROM r)"


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), (k % GRID).cast("int").alias("a"), (k * 7919 % GRID).cast("int").alias("b"))


def _turn(x: str) -> str:
    return f"CASE WHEN {x} > {DIM // 2} THEN {x} - {DIM} WHEN {x} < -{DIM // 2} THEN {x} + {DIM} ELSE {x} END"


def _shift(steps: list[tuple[int, int]]) -> str:
    return "concat_ws(',', " + ", ".join(f"((ra + {r + DIM}) % {DIM}) * {DIM} + (ca + {c + DIM}) % {DIM}" for r, c in steps) + ")"


for _name, _column, _sql in (
    ("grid_distance", lambda a, b: F.round(G.distance(a, b, DIM), 9), "round(sqrt(dr * dr + dc * dc), 9)"),
    ("grid_manhattan", lambda a, b: G.manhattan(a, b, DIM), "(dr + dc)::INT"),
    ("grid_coordinates", lambda a, b: F.concat_ws(":", G.row(a, DIM).cast("string"), G.col(a, DIM).cast("string"), G.linear(G.row(a, DIM), G.col(a, DIM), DIM).cast("string")), "concat_ws(':', ra, ca, a)"),
    ("grid_angle", lambda a, b: F.round(G.angle(a, b, DIM), 9), f"round(atan2({_turn('(rb - ra)')}, {_turn('(cb - ca)')}), 9)"),
    ("grid_collinear", lambda a, b: G.collinear(a, b, F.lit(5000), DIM, 1.0).cast("string"), f"(abs(greatest(dx, dy, dz) - least(dx, dy, dz) - least(greatest(dx, dy, dz), greatest(least(dx, dy), dz, least(greatest(dx, dy), dz)))) < 1.0)::VARCHAR"),
    ("grid_weights", lambda a, b: F.round(G.gaussian_weight(G.distance(a, b, DIM), 20.0) + G.exponential_weight(G.distance(a, b, DIM)), 9), "round(exp(-(dr * dr + dc * dc) / 800.0) + pow(2.0, -sqrt(dr * dr + dc * dc)), 9)"),
    ("grid_moore", lambda a, b: text_of(G.moore(a, DIM)), _shift([(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])),
    ("grid_von_neumann", lambda a, b: text_of(G.von_neumann(a, DIM)), _shift([(-1, 0), (0, -1), (0, 1), (1, 0)])),
    ("grid_neighbourhood", lambda a, b: text_of(F.transform(G.neighbours(a, 1.8, DIM), lambda x: x["position"])), _shift([(r, c) for r, c, _ in G.offsets(1.8)])),
):

    def _run(spark: SparkSession, d: str, column: Callable[[Column, Column], Column] = _column) -> DataFrame:
        return places(spark, d).select("k", column(F.col("a"), F.col("b")).alias("value"))

    _run.__name__ = _name
    _third = "".join(f", sqrt(pow(least(abs(r{x} - {5000 // DIM}), {DIM} - abs(r{x} - {5000 // DIM})), 2) + pow(least(abs(c{x} - {5000 % DIM}), {DIM} - abs(c{x} - {5000 % DIM})), 2)) AS d{y}" for x, y in (("b", "y"), ("a", "z")))
    query(f"{PLACES} SELECT k, {_sql} AS value FROM (SELECT *, sqrt(dr * dr + dc * dc) AS dx{_third} FROM q)")(_run)


# text
_TOKEN = T.TOKEN.replace("'", "''")


def toks(source: str, key: str) -> str:
    return f"(SELECT {key}, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'), lambda t: regexp_replace(lower(t), '{T.PUNCTUATION}', '', 'g')), lambda t: strlen(t) BETWEEN 2 AND 50) AS toks FROM {source})"


def md5int(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The word fingerprints of the documents: the model of most queries, made once in a session."""
    return stored(spark, "vocabulary", d, lambda: vo.word_fingerprints(table(spark, d, "documents"), GRID, WORD_BITS))


HITS = f"tok AS {toks('documents', 'doc_id')}, win AS (SELECT toks[i] AS word, unnest(list_concat(toks[greatest(i - 2, 1):i - 1], toks[i + 1:i + 2])) AS c FROM (SELECT toks, unnest(range(1, len(toks) + 1)) AS i FROM tok)), hits AS (SELECT word, ({md5int('c')} % {GRID})::INT AS position, count(*) AS n FROM win GROUP BY ALL)"
WORDS = f"{HITS}, fpl AS (SELECT word, position, total FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY n DESC, position) AS r FROM hits) WHERE r <= {WORD_BITS}), card AS (SELECT word, count(*) AS nw FROM fpl GROUP BY 1)"


@query(f"WITH tok AS {toks('documents', 'doc_id')} SELECT doc_id, len(toks)::INT AS n, md5(array_to_string(toks, ' ')) AS tokens FROM tok")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"WITH tok AS {toks('documents', 'doc_id')} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS word FROM tok) GROUP BY word")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return vo.word_counts(table(spark, d, "documents"))


@query(f"WITH tok AS {toks('conversations', 'conv_id, turn')} SELECT conv_id, turn, i::INT AS idx, toks[i + 1] AS center, array_to_string(list_concat(toks[greatest(i - 1, 1):i], toks[i + 2:i + 3]), ' ') AS context FROM (SELECT *, unnest(range(0, len(toks))) AS i FROM tok)")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.context_windows(T.tokens(F.col("text")), 2)).alias("idx", "w"))
    return w.select("conv_id", "turn", "idx", "w.center", F.array_join("w.context", " ").alias("context"))


@query(f"WITH tok AS {toks('conversations', 'conv_id, turn')} SELECT gram, count(*) AS n FROM (SELECT array_to_string(toks[i:i + 2], ' ') AS gram FROM (SELECT toks, unnest(range(1, len(toks) - 1)) AS i FROM tok)) GROUP BY gram")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.explode(T.ngrams(T.tokens(F.col("text")), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda t: regexp_replace(lower(t), '{T.PUNCTUATION}', '', 'g')), lambda t: strlen(t) BETWEEN 2 AND 50), ' ') AS value FROM conversations")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.normalise_text(F.col("text")), " ").alias("value"))


@query()
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


# word fingerprints, postings and searches
@query(f"WITH {WORDS} SELECT word, md5(string_agg(position, ',' ORDER BY position)) AS positions, count(*)::INT AS cardinality, any_value(total) / (SELECT sum(n) FROM hits) AS frequency FROM fpl GROUP BY word")
def word_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return vo.with_frequency(vocabulary(spark, d)).withColumn("positions", F.md5(text_of(F.col("positions"))))


@query(f"WITH {WORDS} SELECT count(DISTINCT word) AS words, count(DISTINCT position) AS used_positions, count(*) AS entries, max(n) AS largest, round(count(*) / count(DISTINCT position), 6) AS average FROM fpl JOIN (SELECT position, count(*) AS n FROM fpl GROUP BY 1) USING (position)")
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return ix.stats(ix.postings(vocabulary(spark, d)), GRID).drop("positions").withColumn("average", F.round("average", 6))


@query(f"WITH {WORDS} SELECT p::INT AS position, count(word) AS n FROM range({GRID}) t(p) LEFT JOIN fpl ON position = p GROUP BY 1")
def posting_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ix.posting_sizes(ix.postings(vocabulary(spark, d)), GRID)


@query(f"WITH {WORDS} SELECT word FROM fpl WHERE position = 1234")
def words_at_position(spark: SparkSession, d: str) -> DataFrame:
    return ix.words_at_position(ix.postings(vocabulary(spark, d)), 1234)


@query(f"WITH {WORDS} SELECT word, count(*) AS n FROM fpl JOIN (VALUES (5), (77), (1234), (1234), (9000), (16000)) q(position) USING (position) GROUP BY word ORDER BY n DESC, word LIMIT 25")
def words_at_positions(spark: SparkSession, d: str) -> DataFrame:
    return ix.words_at_positions(ix.postings(vocabulary(spark, d)), [5, 77, 1234, 1234, 9000, 16000], 25)


@query(
    f"WITH {WORDS}, w AS (SELECT word, count(*) AS nw, any_value(total) / (SELECT sum(n) FROM hits) AS f FROM fpl GROUP BY word), s AS (SELECT word AS other, nw AS no FROM w ORDER BY md5(word), word LIMIT 100),"
    " i AS (SELECT x.word, y.word AS other, count(*) AS i FROM fpl x JOIN fpl y USING (position) WHERE y.word IN (SELECT other FROM s) AND x.word <> y.word GROUP BY ALL),"
    " c AS (SELECT i.word, count(*) AS c FROM i JOIN w USING (word) JOIN s USING (other) WHERE i / least(nw, no) > 0.3 GROUP BY 1),"
    " r AS (SELECT word, strlen(word) AS b, f, coalesce(c, 0) / (100 - (word IN (SELECT other FROM s))::INT) AS r FROM w LEFT JOIN c USING (word))"
    " SELECT word, round(least(1, (CASE b WHEN 1 THEN 0.5 WHEN 2 THEN 0.4 WHEN 3 THEN 0.25 WHEN 4 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(word, '[''’]') THEN 0.2 ELSE 0 END"
    " + CASE WHEN f > 0.005 THEN 0.4 WHEN f > 0.002 THEN 0.3 WHEN f > 0.001 THEN 0.2 WHEN f > 0.0005 THEN 0.1 ELSE 0 END + CASE WHEN r > 0.5 THEN 0.3 WHEN r > 0.3 THEN 0.2 WHEN r > 0.15 THEN 0.1 ELSE 0 END)::DOUBLE), 6) AS score FROM r"
)
def stopword_scores(spark: SparkSession, d: str) -> DataFrame:
    return fp.stopword_scores(vo.with_frequency(vocabulary(spark, d)))


def _text_sql(weight: str, order: str, extra: str = "", join: str = "") -> str:
    return f"WITH {WORDS}, bt AS {toks('benchmark', 'item_id')}, tf AS (SELECT item_id, word, count(*) AS tf FROM (SELECT item_id, unnest(toks) AS word FROM bt) GROUP BY ALL){extra}, w AS (SELECT item_id, position, sum({weight})::BIGINT AS w FROM tf JOIN fpl USING (word) {join} GROUP BY ALL), fpt AS (SELECT item_id, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS r FROM w) WHERE r <= {TEXT_BITS})"


_DF = f", df AS (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS word FROM tok) GROUP BY 1), nd AS (SELECT count(*)::DOUBLE AS nd FROM documents)"
_SHOW = "SELECT item_id, string_agg(position, ',' ORDER BY position) AS positions FROM fpt GROUP BY item_id"


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    """(word, df) of words with a fingerprint: the model has them, unless documents share an id or have none."""
    docs = table(spark, d, "documents")
    return vocabulary(spark, d).select("word", "df") if vo.by_row(docs, "doc_id")[1] is None else vo.word_counts(docs).where("df > 0").select("word", "df")


def item_fingerprints(spark: SparkSession, d: str, how: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    if how != "tfidf":
        return fp.text_fingerprints(items, vocabulary(spark, d), how, TEXT_BITS, "item_id")
    return fp.text_fingerprints(items, vocabulary(spark, d), how, TEXT_BITS, "item_id", df=frequencies(spark, d), n_docs=table(spark, d, "documents").count())


@query(_text_sql("1", "position") + _SHOW)
def text_fp_union(spark: SparkSession, d: str) -> DataFrame:
    return item_fingerprints(spark, d, "union").select("item_id", text_of(F.col("positions")).alias("positions"))


@query(_text_sql("tf", "w DESC, position") + _SHOW)
def text_fp_weighted(spark: SparkSession, d: str) -> DataFrame:
    return item_fingerprints(spark, d, "weighted").select("item_id", text_of(F.col("positions")).alias("positions"))


@query(_text_sql("tf * round(ln(nd / coalesce(df, 1)) * 1000000)::BIGINT", "w DESC, position", _DF, "LEFT JOIN df USING (word), nd") + _SHOW)
def text_fp_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return item_fingerprints(spark, d, "tfidf").select("item_id", text_of(F.col("positions")).alias("positions"))


# the same of all documents, with the items as queries against them
def document_fingerprints(spark: SparkSession, d: str, how: str) -> DataFrame:
    docs = table(spark, d, "documents")
    more = {"df": None if vo.by_row(docs, "doc_id")[1] is None else frequencies(spark, d), "n_docs": docs.count()} if how == "tfidf" else {}
    return tx.text_fingerprints(docs, vocabulary(spark, d), GRID, how, TEXT_BITS, "doc_id", **more)


for _how in ("union", "weighted", "tfidf"):

    def _run(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        return document_fingerprints(spark, d, how).select("doc_id", text_of(F.col("positions")).alias("positions"))

    _run.__name__ = f"doc_fp_{_how}"
    query()(_run)


@query()
def doc_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id, similarity (Jaccard) of at least 0.1: all items against all documents, by shared positions."""
    return ix.similar_to(item_fingerprints(spark, d, "weighted"), document_fingerprints(spark, d, "weighted"), 0.1, "item_id", "doc_id")


@query(f"WITH {WORDS}, ct AS {toks('conversations', 'conv_id, turn')}, k AS (SELECT conv_id, turn, count(*) AS total, count(card.word) AS known FROM (SELECT conv_id, turn, unnest(toks) AS word FROM ct) LEFT JOIN card USING (word) GROUP BY ALL) SELECT conv_id * 1000 + turn AS id, coalesce(known, 0) AS known, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) = 0 THEN 1.0 ELSE known / total END AS ratio FROM conversations LEFT JOIN k USING (conv_id, turn)")
def fp_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return fp.coverage(c, vocabulary(spark, d), "id")


_PROBE = _text_sql("tf", "w DESC, position") + ", nq AS (SELECT item_id, count(*) AS nq FROM fpt GROUP BY 1), hit AS (SELECT item_id, word, count(*) AS overlap FROM fpt JOIN fpl USING (position) GROUP BY ALL)"


def item_queries(spark: SparkSession, d: str) -> DataFrame:
    return item_fingerprints(spark, d, "weighted").withColumnRenamed("item_id", "query")


@query(f"{_PROBE} SELECT * FROM (SELECT item_id AS query, word, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, word)::INT AS rank FROM hit) WHERE rank <= 10")
def probe_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ix.probe_top_k(item_queries(spark, d), vocabulary(spark, d), 10)


@query(f"{_PROBE}, s AS (SELECT item_id AS query, word, round(overlap / sqrt(nq * nw), 9) AS similarity FROM hit JOIN nq USING (item_id) JOIN card USING (word)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, word)::INT AS rank FROM s) WHERE rank <= 10")
def nearest_words(spark: SparkSession, d: str) -> DataFrame:
    return ix.nearest(item_queries(spark, d), vocabulary(spark, d), 10)


@query(f"{_PROBE}, c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, word) AS r FROM hit), s AS (SELECT item_id AS query, word, round(overlap / sqrt(nq * nw), 9) AS similarity FROM c JOIN nq USING (item_id) JOIN card USING (word) WHERE r <= 100) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, word)::INT AS rank FROM s) WHERE rank <= 10")
def two_phase_words(spark: SparkSession, d: str) -> DataFrame:
    q = item_queries(spark, d).withColumn("query", F.col("query").cast("string"))
    return ix.two_phase(q, vocabulary(spark, d), 10).withColumn("query", F.col("query").cast("long"))


@query(f"{_PROBE.replace(', hit AS', ', unused AS')}, i AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS i FROM fpt a JOIN fpt b ON a.position = b.position AND a.item_id < b.item_id GROUP BY ALL) SELECT a, b, round(i / (x.nq + y.nq - i), 9) AS similarity FROM i JOIN nq x ON x.item_id = a JOIN nq y ON y.item_id = b WHERE round(i / (x.nq + y.nq - i), 9) >= 0.1")
def text_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ix.similar_pairs(item_fingerprints(spark, d, "weighted").withColumnRenamed("item_id", "id"), 0.1)


_NEAR = " UNION ALL ".join(f"SELECT ((p // {DIM} + {r + DIM}) % {DIM}) * {DIM} + (p % {DIM} + {c + DIM}) % {DIM} AS position, {x!r}::DOUBLE AS distance, p, words FROM q" for r, c, x in G.offsets(1.8))
_STATS = f"{WORDS}, q AS (SELECT p::INT AS p, count(word) AS words FROM range({GRID}) t(p) LEFT JOIN fpl ON position = p GROUP BY 1), near AS ({_NEAR}), v AS (SELECT count(DISTINCT word)::DOUBLE AS v FROM fpl), stats AS (SELECT q.p AS position, words, round(-ln((words + 1) / (v + 1)), 9) AS information, round(ln(v / (1 + words)), 9) AS idf FROM q, v)"


@query(f"WITH {_STATS} SELECT position::INT AS position, any_value(s.words) AS words, any_value(information) AS information, any_value(idf) AS idf, round(avg(near.words), 9) AS density FROM stats s JOIN near USING (position) GROUP BY position")
def position_stats(spark: SparkSession, d: str) -> DataFrame:
    return lk.position_stats(ix.postings(vocabulary(spark, d)), DIM)


_ASKED = [5, 77, 1234, 9000]


@query(f"WITH {_STATS}, place AS (SELECT position, sum(exp(-distance * distance / 4.5)) AS w, min(distance) AS dd FROM near WHERE p IN (5, 77, 1234, 9000) GROUP BY 1) SELECT word, round(sum(w * (1 + idf)) * (1 + ln(count(*))), 6) AS score, round(sum(w * (1 + idf)), 6) AS weighted, min(dd) AS nearest, count(*) AS overlap FROM place JOIN stats USING (position) JOIN fpl USING (position) GROUP BY word ORDER BY score DESC, word LIMIT 20")
def semantic_lookup(spark: SparkSession, d: str) -> DataFrame:
    posts = ix.postings(vocabulary(spark, d))
    return lk.lookup(posts, lk.position_stats(posts, DIM), _ASKED, 20, DIM)


@query()
def semantic_clusters(spark: SparkSession, d: str) -> DataFrame:
    posts = ix.postings(vocabulary(spark, d))
    c = lk.clusters(posts, DIM, 16, 10)
    return lk.representatives(posts, lk.position_stats(posts, DIM), c, 10)


_KERNEL = " UNION ALL ".join(f"SELECT id, ((p // {DIM} + {r + DIM}) % {DIM}) * {DIM} + (p % {DIM} + {c + DIM}) % {DIM} AS position, {w!r}::DOUBLE AS w FROM bits" for r, c, w in G.kernel(7, 1.5))


@query(f"WITH {CUST}, bits AS (SELECT id, unnest(positions) AS p FROM cust), v AS (SELECT id, position, sum(w) AS v FROM ({_KERNEL}) GROUP BY ALL), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1) SELECT a.id AS a, b.id AS b, round(sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)), 6) AS similarity FROM v a JOIN v b ON a.position = b.position AND b.id = a.id + 1 JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY ALL")
def smoothed_similarity(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    p = c.select(F.col("id").alias("a")).join(c.select(F.col("id").alias("b")), F.col("b") == F.col("a") + 1)
    return lk.smoothed_similarity(p, c, DIM).where("met").drop("met")


@query(f"WITH {WORDS}, p AS (SELECT position, word FROM fpl WHERE NOT starts_with(word, 'a') UNION ALL SELECT unnest([3, 5, 77]), 'new word') SELECT position::INT AS position, count(*) AS n, min(word) AS least FROM p GROUP BY position")
def postings_update(spark: SparkSession, d: str) -> DataFrame:
    v = vocabulary(spark, d)
    new = spark.createDataFrame([("new word", [3, 5, 77])], "word string, positions array<int>")
    return ix.insert(ix.remove(ix.postings(v), v.where(F.col("word").startswith("a"))), new).groupBy("position").agg(F.count("*").alias("n"), F.min("word").alias("least"))


# segmentation: lines of documents, each the set of its words' places
_LINES = f"ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents), lt AS {toks('ln', 'doc_id, idx')}, pos AS (SELECT doc_id, idx // 3 AS b, {md5int('t')} % {GRID} AS p FROM (SELECT doc_id, idx, unnest(toks) AS t FROM lt)), full3 AS (SELECT doc_id, idx // 3 AS b FROM ln GROUP BY ALL HAVING count(*) = 3), bl AS (SELECT f.doc_id, f.b, list_distinct(list(p) FILTER (p IS NOT NULL)) AS s FROM full3 f LEFT JOIN pos USING (doc_id, b) GROUP BY ALL), nx AS (SELECT *, lead(s) OVER w AS t FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY b)), gap AS (SELECT doc_id, b::INT AS gap, coalesce(round(CASE WHEN len(s) * len(t) > 0 THEN len(list_intersect(s, t)) / sqrt(len(s) * len(t)) END, 6), 0) AS similarity FROM nx WHERE t IS NOT NULL OR b < (SELECT max(b) FROM full3 z WHERE z.doc_id = nx.doc_id))"
_DEPTH = "dep AS (SELECT *, round(max(similarity) OVER (PARTITION BY doc_id ORDER BY gap) + max(similarity) OVER (PARTITION BY doc_id ORDER BY gap DESC) - 2 * similarity, 6) AS depth FROM gap)"
_G = [2.718281828459045 ** (-i * i / 2) for i in range(-3, 4)]
_SMOOTH = "sm AS (SELECT *, round(CASE WHEN count(*) OVER (PARTITION BY doc_id) < 3 THEN depth ELSE " + " + ".join(f"{x / sum(_G)!r} * coalesce(lag(depth, {-i}) OVER w, {'first_value' if i < 0 else 'last_value'}(depth) OVER u)" for i, x in zip(range(-3, 4), _G, strict=True)) + " END, 6) AS smooth FROM dep WINDOW w AS (PARTITION BY doc_id ORDER BY gap), u AS (PARTITION BY doc_id ORDER BY gap ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "sentence"))


def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    place = F.transform(T.tokens(F.col("sentence")), lambda t: F.pmod(hdc.hashed(t), F.lit(GRID)).cast("int"))
    return sg.gaps(sg.blocks(doc_lines(spark, d).withColumn("positions", sdr.from_positions(place)), 3))


@query(f"WITH {_LINES}, {_DEPTH} SELECT doc_id, gap, similarity, depth FROM dep")
def segment_depths(spark: SparkSession, d: str) -> DataFrame:
    return sg.depths(line_gaps(spark, d))


@query(f"WITH {_LINES}, {_DEPTH}, {_SMOOTH} SELECT doc_id, gap, smooth FROM sm")
def segment_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return sg.smoothed(sg.depths(line_gaps(spark, d)), 1.0).select("doc_id", "gap", "smooth")


@query(
    f"WITH {_LINES}, {_DEPTH}, {_SMOOTH}, bd AS (SELECT doc_id, gap FROM (SELECT *, round(avg(smooth) OVER p + 0.5 * stddev_pop(smooth) OVER p, 6) AS least FROM sm WINDOW p AS (PARTITION BY doc_id)) WHERE smooth > least),"
    " kp AS (SELECT doc_id, unnest(list_reduce(list_transform(list(gap ORDER BY gap), lambda g: [g]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 2 THEN list_concat(a, x) ELSE a END)) AS gap FROM bd GROUP BY doc_id),"
    " cut AS (SELECT ln.doc_id, ln.idx, ln.text, count(kp.gap) OVER (PARTITION BY ln.doc_id ORDER BY ln.idx) AS segment FROM ln LEFT JOIN kp ON kp.doc_id = ln.doc_id AND (kp.gap + 1) * 3 = ln.idx)"
    " SELECT doc_id, segment::INT AS segment, min(idx)::INT AS first, max(idx)::INT AS last, string_agg(text, ' ' ORDER BY idx) AS text FROM cut GROUP BY doc_id, segment"
)
def segments(spark: SparkSession, d: str) -> DataFrame:
    marked = sg.spaced(sg.boundaries(sg.smoothed(sg.depths(line_gaps(spark, d)), 1.0)), SegmentationConfig(min_sentences=6))
    return sg.segments(doc_lines(spark, d), marked, 3)


@query(f"WITH {_LINES.split(', pos AS')[0]} SELECT toks[i + 1] AS center, count(*) AS n, sum(len(list_concat(toks[greatest(i - 1, 1):i], toks[i + 2:i + 3])))::BIGINT AS near FROM (SELECT *, unnest(range(0, len(toks))) AS i FROM lt) GROUP BY center")
def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows within the lines of documents: how many a word has, and how many neighbours in all."""
    w = table(spark, d, "documents").select(F.explode(T.sentence_windows(F.split(F.coalesce("text", F.lit("")), "\n"), 2)).alias("w"))
    return w.groupBy(F.col("w.center").alias("center")).agg(F.count("*").alias("n"), F.sum(F.size("w.context")).alias("near"))


# hypervectors of users' event sequences
_BITS, _HDIM, _MOST = 20, 128, 8
_SEQ = f"WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE i <= {_MOST}), it AS (SELECT DISTINCT event_type, {md5int('event_type || chr(58) || b::VARCHAR')} % {_HDIM} AS p FROM (SELECT DISTINCT event_type FROM events), range({_BITS}) t(b))"


def sequences(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("i")).where(F.col("i") <= _MOST)
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]).alias("items"))


@query(f"{_SEQ}, v AS (SELECT user_id, any_value(n) AS n, (p + n - i) % {_HDIM} AS p, count(*) AS c FROM f JOIN it USING (event_type) GROUP BY user_id, (p + n - i) % {_HDIM}) SELECT user_id, string_agg(p, ',' ORDER BY p) AS value FROM v WHERE c >= ceil(n * 0.5) GROUP BY user_id")
def hdc_sequence(spark: SparkSession, d: str) -> DataFrame:
    out = sequences(spark, d).select("user_id", text_of(hdc.encode_sequence(F.col("items"), _HDIM, _BITS, _MOST)).alias("value"))
    return out.where("value <> ''")


@query(
    f"{_SEQ}, v AS (SELECT user_id, any_value(n) AS n, (p + n - i) % {_HDIM} AS p, count(*) AS c FROM f JOIN it USING (event_type) GROUP BY user_id, (p + n - i) % {_HDIM}), enc AS (SELECT user_id, p, count(*) OVER (PARTITION BY user_id) AS ne FROM v WHERE c >= ceil(n * 0.5)),"
    f" item AS (SELECT event_type AS name, p, count(*) OVER (PARTITION BY event_type) AS nm FROM it), hit AS (SELECT user_id, name, pos::INT AS pos, count(*) / least(any_value(ne), any_value(nm)) AS s FROM enc, range({_MOST}) t(pos), item WHERE item.p = (enc.p - pos + {_HDIM}) % {_HDIM} GROUP BY user_id, name, pos) SELECT user_id, name, pos, round(s, 9) AS similarity FROM hit WHERE s > 0.6"
)
def hdc_decode(spark: SparkSession, d: str) -> DataFrame:
    encoded = sequences(spark, d).select("user_id", hdc.encode_sequence(F.col("items"), _HDIM, _BITS, _MOST).alias("positions"))
    memory = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("positions", hdc.random(F.col("name"), _HDIM, _BITS))
    return hdc.decode_sequences(encoded, "user_id", memory, _MOST, _HDIM, 0.6).withColumn("similarity", F.round("similarity", 9))


@query(
    f"WITH {CUST}, t AS (SELECT id - o AS query, id, unnest(positions) AS p FROM cust, range(3) r(o) WHERE (id - o) % 50 = 0), q AS (SELECT query, p FROM t GROUP BY ALL HAVING count(*) % 2 = 1), whole AS (SELECT query FROM t GROUP BY 1 HAVING count(DISTINCT id) = 3),"
    " nq AS (SELECT query, count(*) AS nq FROM q GROUP BY 1), m AS (SELECT id, len(positions) AS nm, unnest(positions) AS p FROM cust), s AS (SELECT query, id AS name, count(*) / least(any_value(nq), any_value(nm)) AS similarity FROM q JOIN whole USING (query) JOIN nq USING (query) JOIN m USING (p) GROUP BY ALL)"
    " SELECT * FROM (SELECT query, name, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, name)::INT AS rank FROM s) WHERE rank <= 5"
)
def hdc_analogy(spark: SparkSession, d: str) -> DataFrame:
    """Customer id is to id + 1 as id + 2 is to whom, for every 50th customer."""
    c = customers(spark, d)
    other = lambda o, name: c.select((F.col("id") - o).alias("query"), F.col("positions").alias(name)).where("query % 50 = 0")
    asked = other(0, "a").join(other(1, "b"), "query").join(other(2, "c"), "query")
    return hdc.solve(asked, c.withColumnRenamed("id", "name"))


@query(f"{_SEQ}, v AS (SELECT user_id, (p + i - 1) % {_HDIM} AS p, count(*) AS c FROM f JOIN it USING (event_type) WHERE i <= 3 GROUP BY user_id, (p + i - 1) % {_HDIM}) SELECT user_id, string_agg(p, ',' ORDER BY p) AS value FROM v WHERE c % 2 = 1 GROUP BY user_id")
def hdc_ngram(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("user_id", text_of(hdc.encode_ngram(F.slice("items", 1, 3), _HDIM, _BITS)).alias("value"))


# the same of whole sequences, whatever their length, at the dimension of 2,000; users without a position stay
_WHOLE = 2000
_ALL = f"WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), it AS (SELECT DISTINCT event_type, {md5int('event_type || chr(58) || b::VARCHAR')} % {_WHOLE} AS p FROM (SELECT DISTINCT event_type FROM events), range({_BITS}) t(b))"
_EVERY = "SELECT user_id, coalesce(value, '') AS value FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, string_agg(p, ',' ORDER BY p) AS value FROM v WHERE {} GROUP BY user_id) USING (user_id)"


def whole_sequences(spark: SparkSession, d: str) -> DataFrame:
    return hdc.ordered(table(spark, d, "events"), "user_id", F.date_trunc("day", F.col("ts")), ["ts", "event_id"], "event_type")


@query(f"{_ALL}, v AS (SELECT user_id, n, (p + n - 1 - i) % {_WHOLE} AS p, count(*) AS c FROM e JOIN it USING (event_type) GROUP BY user_id, n, (p + n - 1 - i) % {_WHOLE}) " + _EVERY.format("c >= ceil(n * 0.5)"))
def hdc_sequence_whole(spark: SparkSession, d: str) -> DataFrame:
    return hdc.encode_sequences(whole_sequences(spark, d), "user_id", _WHOLE, _BITS).select("user_id", text_of(F.col("positions")).alias("value"))


@query(
    f"{_ALL}, g AS (SELECT user_id, n, i - k AS s, (p + k) % {_WHOLE} AS p FROM e JOIN it USING (event_type), range(3) r(k) WHERE i >= k AND i - k <= n - 3 GROUP BY user_id, n, i - k, (p + k) % {_WHOLE} HAVING count(*) % 2 = 1),"
    " v AS (SELECT user_id, n, p, count(*) AS c FROM g GROUP BY ALL) " + _EVERY.format("c >= ceil((n - 2) * 0.3::DOUBLE)")
)
def hdc_ngram_text(spark: SparkSession, d: str) -> DataFrame:
    return hdc.encode_text(whole_sequences(spark, d), "user_id", 3, _WHOLE, _BITS).select("user_id", text_of(F.col("positions")).alias("value"))


@query(f"{PAIR}, q AS (SELECT id, list_transform(a, lambda x: (x + 16300) % {GRID}) AS r, b FROM p) SELECT id, array_to_string(list_sort(r), ',') AS value FROM q")
def hdc_permute(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("id", text_of(hdc.permute(F.col("a"), 16300, GRID)).alias("value"))


@query(f"WITH {CUST}, i AS (SELECT a.id AS query, b.id AS name, len(any_value(a.positions)) AS na, len(any_value(b.positions)) AS nb, count(*) AS i FROM (SELECT id, positions, unnest(positions) AS p FROM cust WHERE id % 50 = 0) a JOIN (SELECT id, positions, unnest(positions) AS p FROM cust) b USING (p) GROUP BY ALL), s AS (SELECT query, name, i / least(na, nb) AS similarity FROM i) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, name)::INT AS rank FROM s) WHERE rank <= 5")
def item_memory_top_k(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    return hdc.query_top_k(c.where("id % 50 = 0").withColumnRenamed("id", "query"), c.withColumnRenamed("id", "name"), 5)


# signatures
_HASHES = 16
_MIN = f"WITH {CUST}, mh AS (SELECT id, h, min({md5int('h::VARCHAR || chr(58) || p::VARCHAR')}) AS value FROM (SELECT id, unnest(positions) AS p FROM cust), range({_HASHES}) t(h) GROUP BY ALL)"


@query(f"{_MIN} SELECT id, h::INT AS h, value FROM mh")
def minhash(spark: SparkSession, d: str) -> DataFrame:
    return lsh.minhash(customers(spark, d), _HASHES)


@query(f"{_MIN}, b AS (SELECT id, h // 2 AS band, string_agg(value, ',' ORDER BY h) AS bucket FROM mh GROUP BY ALL) SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.band = y.band AND x.bucket = y.bucket AND x.id < y.id")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lsh.candidate_pairs(lsh.bands(lsh.minhash(customers(spark, d), _HASHES), 2))


@query(f"{_MIN}, b AS (SELECT id, h // 2 AS band, string_agg(value, ',' ORDER BY h) AS bucket FROM mh GROUP BY ALL), s AS (SELECT count(*) AS n FROM b GROUP BY band, bucket) SELECT count(*) AS buckets, sum(n)::BIGINT AS items, max(n) AS largest, round(avg(n), 9) AS average FROM s")
def lsh_stats(spark: SparkSession, d: str) -> DataFrame:
    return lsh.bucket_stats(lsh.bands(lsh.minhash(customers(spark, d), _HASHES), 2)).withColumn("average", F.round("average", 9))


@query(f"{_MIN} SELECT a.id AS id, count(*) FILTER (a.value = b.value) / {_HASHES} AS estimate FROM mh a JOIN mh b ON b.id = a.id + 1 AND a.h = b.h GROUP BY 1")
def minhash_jaccard(spark: SparkSession, d: str) -> DataFrame:
    s = lsh.signatures(lsh.minhash(customers(spark, d), _HASHES))
    both = s.join(s.select((F.col("id") - 1).alias("id"), F.col("signature").alias("other")), "id")
    return both.select("id", lsh.estimated_jaccard(F.col("signature"), F.col("other")).alias("estimate"))


_PLACES = lsh.sampled_places(2000, 12)


@query(f"WITH {CUST} SELECT id, " + " + ".join(f"CASE WHEN list_contains(positions, {p}) THEN {1 << i} ELSE 0 END" for i, p in enumerate(_PLACES)) + " AS hash FROM cust")
def bit_sampling(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("id", lsh.bit_sample(F.col("positions"), _PLACES).alias("hash"))


_WIDE = lsh.sampled_places(GRID, 96, 7)
_BIT = lambda places: " + ".join(f"CASE WHEN list_contains(positions, {p}) THEN {1 << i} ELSE 0 END" for i, p in enumerate(places))


@query(f"WITH {CUST} SELECT id, concat_ws(',', {', '.join(_BIT(_WIDE[i:i + 32]) for i in range(0, 96, 32))}) AS hash FROM cust")
def bit_sampling_words(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("id", text_of(lsh.bit_sample_words(F.col("positions"), _WIDE)).alias("hash"))


def _dot(planes: list[float]) -> str:
    return f"list_inner_product(v, {planes}::DOUBLE[])"


_SIM = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, (" + " + ".join(f"CASE WHEN {_dot(p)} >= 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(PLANES)) + ")::BIGINT AS hash FROM e)"


@query(f"{_SIM} SELECT * FROM s")
def simhash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", VF.simhash(F.col("embedding"), PLANES).alias("hash"))


@query(f"{_SIM} SELECT a.vec_id AS query, b.vec_id FROM s a JOIN s b ON a.vec_id <> b.vec_id AND (a.hash = b.hash OR xor(a.hash, b.hash) IN (1, 2, 4, 8)) WHERE a.vec_id % 20 = 0")
def lsh_multiprobe(spark: SparkSession, d: str) -> DataFrame:
    s = simhash(spark, d)
    return lsh.multiprobe(s, s.where("vec_id % 20 = 0"), 4, "vec_id")


@query(f"{_SIM} SELECT a.vec_id, bit_count(xor(a.hash, b.hash))::INT AS hamming, round(cos(pi() * bit_count(xor(a.hash, b.hash)) / 16), 9) AS cosine FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def simhash_cosine(spark: SparkSession, d: str) -> DataFrame:
    s = simhash(spark, d)
    both = s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other")), "vec_id")
    h = VF.hamming(F.col("hash"), F.col("other"))
    return both.select("vec_id", h.alias("hamming"), F.round(VF.estimated_cosine(h, 16), 9).alias("cosine"))


# dense vectors
@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return both.select("vec_id", F.round(VF.dot(F.col("embedding"), F.col("other")), 6).alias("dot"), F.round(VF.l2(F.col("embedding"), F.col("other")), 6).alias("l2"))


_UNITS = [[round(VF.gaussian("unit", u, i) / 8, 6) for i in range(64)] for u in range(16)]


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), w(unit, w) AS (VALUES " + ", ".join(f"({u}, {w}::DOUBLE[])" for u, w in enumerate(_UNITS)) + ") SELECT vec_id, arg_min(unit, list_distance(v, w))::INT AS unit FROM e, w GROUP BY vec_id")
def bmu_assign(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    return V.assign_units(table(spark, d, "embeddings"), np.array(_UNITS), "vec_id", "embedding")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), w(unit, w) AS (VALUES " + ", ".join(f"({u}, {w}::DOUBLE[])" for u, w in enumerate(_UNITS)) + ") SELECT vec_id, rank, unit, round(distance, 6) AS distance FROM (SELECT vec_id, unit::INT AS unit, list_distance(v, w) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, w), unit)::INT AS rank FROM e, w) WHERE rank <= 3")
def k_nearest_units(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    return V.k_nearest_units(table(spark, d, "embeddings"), np.array(_UNITS), 3, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


_BOOKS = [[[round(VF.gaussian("pq", m, k, i) / 8, 6) for i in range(8)] for k in range(8)] for m in range(8)]
_CODES = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b(m, k, c) AS (VALUES " + ", ".join(f"({m}, {k}, {c}::DOUBLE[])" for m, book in enumerate(_BOOKS) for k, c in enumerate(book)) + "), code AS (SELECT vec_id, m, arg_min(k, list_distance(v[m * 8 + 1:m * 8 + 8], c)) AS k FROM e, b GROUP BY ALL)"


@query(f"{_CODES} SELECT vec_id, string_agg(k, ',' ORDER BY m) AS codes FROM code GROUP BY 1")
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    return V.encode(table(spark, d, "embeddings"), [np.array(b) for b in _BOOKS], "vec_id", "embedding").select("vec_id", text_of(F.col("codes")).alias("codes"))


_ASK = [round(VF.gaussian("query", i) / 8, 6) for i in range(64)]


@query(f"{_CODES}, t AS (SELECT m, k, pow(list_distance(({_ASK}::DOUBLE[])[m * 8 + 1:m * 8 + 8], c), 2) AS d FROM b) SELECT vec_id, round(sum(d), 6) AS distance FROM code JOIN t USING (m, k) GROUP BY 1 ORDER BY distance, vec_id LIMIT 10")
def pq_search(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    codes = V.encode(table(spark, d, "embeddings"), [np.array(b) for b in _BOOKS], "vec_id", "embedding")
    return codes.select("vec_id", F.round(VF.pq_distance(F.col("codes"), VF.pq_table(_ASK, _BOOKS)), 6).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query()
def som_batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    from .config import SomConfig

    _, metrics = V.train_batch(table(spark, d, "embeddings"), "embedding", SomConfig(dimension=8), 4)
    return spark.createDataFrame(metrics, "epoch int, qe double, radius double")


@query()
def context_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return V.context_embeddings(table(spark, d, "conversations"), 16)


@query()
def pq_train_encode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.encode(e, V.train_codebooks(V.sample_rows(e, "embedding", "vec_id", 2000), 8, 16, 8), "vec_id", "embedding")
