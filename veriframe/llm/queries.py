"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import decontam, licenses, neardup, packing, pii, quality, shards, substrings, topk, urls

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_best_two_fit_packing": packing.query,
    "op3_substring_dedup": substrings.query,
    "op4_pii": pii.query,
    "op5_pivot_topk": topk.query,
    "op6_decontamination": decontam.query,
    "op7_url_filter": urls.query,
    "op8_quality": quality.query,
    "op9_sharding": shards.query,
    "op10_minhash_neardup": neardup.query,
}
WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT win, min(struct_pack(d := doc_id, i := i)) AS first FROM k GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k JOIN f USING (win) WHERE struct_pack(d := doc_id, i := i) > first),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
y AS (SELECT doc_id, count(*) FILTER (g.i IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""
NEARDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, b AS to_id FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_id = u.a),
c AS (SELECT id, min(to_id) AS low FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id"""
ORACLES = {"op3_substring_dedup": SUBSTRINGS, "op5_pivot_topk": topk.ORACLE, "op7_url_filter": urls.oracle(), "op10_minhash_neardup": NEARDUP}
