"""DuckDB SQL that gives the rows of those queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(k: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))"


SQL = {
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d)),
        again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, s + j AS pos FROM again, range(20) AS t(j)),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents), b AS (SELECT item_id, {_words(_LOWER)} AS w FROM benchmark),
        ds AS (SELECT doc_id, unnest({_shingles(5)}) AS h FROM d), bs AS (SELECT item_id, {_shingles(5)} AS s FROM b),
        c AS (SELECT doc_id, item_id, len(s) AS n_item, count(*) AS n_common FROM (SELECT item_id, s, unnest(s) AS h FROM bs) JOIN ds USING (h) GROUP BY ALL)
        SELECT doc_id, item_id, n_item::INT AS n_item, n_common, n_common / n_item AS containment FROM c WHERE n_common >= ceil(n_item * 50 / 100)""",
    "op7_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_shingles(5)} END AS s FROM d),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t AS a JOIN t AS b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT count(*) FROM link WHERE a = doc_id) AS n_similar, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM s""",
}
