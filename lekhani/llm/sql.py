"""DuckDB SQL, by brute force over the same tables, for operators whose results SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: From linked(a, b), both ways, and nodes(id): reach(id, low), the smallest id that each reaches, itself included.
REACH = "reached(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reached r JOIN linked l ON l.a = r.other), reach AS (SELECT id, min(other) AS low FROM reached GROUP BY id)"


def near_vectors(cosine: float = 0.95) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND list_dot_product(e, e) > 0),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= {cosine}),
nodes AS (SELECT vec_id AS id FROM v), {REACH}
SELECT id AS vec_id, (SELECT count(*) FROM linked WHERE a = id) AS n_links, low AS component_id, id = low AS kept FROM reach"""


def near_documents(k: int, percent: int) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})]) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
met AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS met_n FROM u p JOIN u q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM met WHERE 100 * met_n >= {percent} * (na + nb - met_n)),
nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT doc_id, len(s) AS n_shingles, low AS component_id, doc_id = low AS kept FROM s JOIN reach ON id = doc_id"""


def near_lines(shingle: int, percent: int) -> str:
    norm = "trim(regexp_replace(lower(x), '[ \\t\\r\\x0b\\x0c]+', ' ', 'g'), ' ')"
    return f"""WITH RECURSIVE cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
ln AS (SELECT doc_id, no, {norm} AS norm FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS no FROM cut) WHERE {norm} <> ''),
dl AS (SELECT norm, row_number() OVER () AS id, {{'d': f.d, 'l': f.l}} AS place FROM (SELECT norm, min({{'d': doc_id, 'l': no}}) AS f FROM ln GROUP BY norm)),
s AS (SELECT id, CASE WHEN length(norm) < {shingle} THEN [norm] ELSE list_distinct([substr(norm, i, {shingle}) for i in range(1, length(norm) - {shingle - 2})]) END AS s FROM dl),
u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
met AS (SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS met_n FROM u p JOIN u q ON p.x = q.x AND p.id <> q.id AND 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n) GROUP BY ALL),
linked AS (SELECT a, b FROM met WHERE 100 * met_n >= {percent} * (na + nb - met_n)),
nodes AS (SELECT id FROM dl), {REACH},
keep AS (SELECT low, min(place) AS keeper FROM reach JOIN dl USING (id) GROUP BY low)
SELECT ln.doc_id, ln.no::BIGINT AS line_no, keeper.d = ln.doc_id AND keeper.l = ln.no AS kept, keeper.d AS keeper_id, keeper.l::BIGINT AS keeper_no FROM ln JOIN dl USING (norm) JOIN reach USING (id) JOIN keep USING (low)"""
