"""SQL of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source AS host FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
 win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
 rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1), cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) r(k) GROUP BY 1),
 lw AS (SELECT * FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY 1),
 norm AS (SELECT doc_id, host, t, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS x, len(regexp_extract_all(line, '{WORD}')) AS nw FROM lw),
 f AS (SELECT host, x, count(DISTINCT t) AS n, arg_min(t, doc_id) AS first FROM norm GROUP BY 1, 2), hosts AS (SELECT host, count(DISTINCT t) AS k FROM d GROUP BY 1),
 rem AS (SELECT doc_id, sum(nw) AS n FROM norm JOIN f ON norm.host IS NOT DISTINCT FROM f.host AND norm.x = f.x JOIN hosts ON norm.host IS NOT DISTINCT FROM hosts.host WHERE f.n > 10 AND f.n > least(0.05 * k, 1000) AND t <> first GROUP BY 1),
 m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
 coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rem USING (doc_id)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
 SELECT *, NOT base_failed AND n_words - n_removed >= 10 AND n_words - n_removed >= 0.4::DOUBLE * n_words AS kept FROM b"""

#: Links of word shingles, and their components; the names after @ are filled in.
LINKED = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < @WORDS THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + @WORDS - 1], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - @WORDS + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= @PERCENT * (x.n + y.n - i)), both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b FROM reach r JOIN both_ ON a = r.node)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id@KEPT FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(node) AS component_id FROM reach GROUP BY 1) c ON c.id = d.doc_id"""


def _linked(words: int, percent: int, kept: str = "") -> str:
    return LINKED.replace("@WORDS", str(words)).replace("@PERCENT", str(percent)).replace("@KEPT", kept)


JACCARD = _linked(5, 75)
FOREST = _linked(2, 80, ", d.doc_id = c.component_id AS kept")

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
 SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10"""

#: The unsigned crc32 of a decimal id, bit by bit: a table of all bytes, then the id's digits.
CRC32 = """crc_table AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM documents, crc_table)"""

RUNS = rf"""WITH {CRC32}, o AS (SELECT d.doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents d JOIN crc USING (doc_id)),
 d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < g % n THEN w[i + 1] ELSE w[g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM o),
 p AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
 m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
 r AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
 u AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = r.doc_id AND b.q < r.q AND b.s <= r.s AND b.s + b.l >= r.s + r.l)),
 s AS (SELECT doc_id, count(*) AS n_runs, string_agg(s::VARCHAR || ',' || l::VARCHAR || ',' || q::VARCHAR || chr(10), '' ORDER BY s, q) AS txt FROM u GROUP BY 1),
 f AS (SELECT doc_id, s, l, q FROM u WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.doc_id = u.doc_id AND (b.l * u.q > u.l * b.q OR b.l * u.q = u.l * b.q AND (b.s < u.s OR b.s = u.s AND b.q < u.q)))),
 c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS txt FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = p.doc_id AND p.i >= u.s + u.q AND p.i < u.s + u.l) GROUP BY 1)
 SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, f.s::BIGINT AS start, f.l::BIGINT AS length, f.q::BIGINT AS period, (1000 * f.l // f.q)::BIGINT AS exponent_milli, sha256(coalesce(s.txt, '')) AS runs_sha256, sha256(coalesce(c.txt, '')) AS collapsed_sha256
 FROM d LEFT JOIN s USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
