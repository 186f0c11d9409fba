"""The same results as SQL for a second engine (DuckDB)."""

from __future__ import annotations

from tallybook.llm.secret_scan import ASSIGN, MAX_OWNERS, MAX_REPOSITORIES

_MATCHES = """SELECT doc_id, source, lang, tkey, '{kind}' AS kind, {rank} AS rank, text,
    regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d"""
_KINDS = (
    ("assign", ASSIGN.replace("'", "''"), 12),
    ("access", "AKIA[A-Z0-9]+", 18),
    ("hex", "[0-9a-f]+", 16),
    ("owned", "[A-Za-z0-9+/_-]+", 24),
)

OP1 = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tkey FROM documents),
runs AS ({" UNION ALL ".join(_MATCHES.format(kind=k, rank=i, pattern=p) for i, (k, p, _) in enumerate(_KINDS))}),
places AS (
    SELECT doc_id, source, lang, tkey, kind, rank, m[i] AS match,
        coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS a
    FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM runs WHERE len(m) > 0)),
parts AS (
    SELECT *, a + length(match) AS b,
        CASE WHEN kind = 'assign' THEN regexp_extract(match, '{ASSIGN.replace("'", "''")}', 2) ELSE match END AS part FROM places),
good AS (
    SELECT * FROM parts WHERE length(part) >= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, _, n in _KINDS)} END
    AND (kind <> 'owned' OR (regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[0-9]')))),
spans AS (
    SELECT * FROM good g WHERE kind <> 'owned' OR NOT EXISTS (SELECT 1 FROM good h WHERE h.kind <> 'owned'
        AND h.doc_id IS NOT DISTINCT FROM g.doc_id AND h.tkey = g.tkey AND h.a < g.b AND g.a < h.b)),
spread AS (
    SELECT part, count(*) <= {MAX_OWNERS} AND sum(n) <= {MAX_REPOSITORIES} AS live FROM (
        SELECT part, source, count(*) AS n FROM (SELECT DISTINCT part, source, lang FROM spans) GROUP BY part, source)
    GROUP BY part),
listed AS (
    SELECT s.doc_id, s.tkey,
        count(DISTINCT a) FILTER (kind = 'assign') AS n_assign, count(DISTINCT a) FILTER (kind = 'access') AS n_access,
        count(DISTINCT a) FILTER (kind = 'hex') AS n_hex,
        string_agg(DISTINCT kind || ':' || a || ':' || b, ',') FILTER (FALSE) AS nothing,
        list_sort(list(DISTINCT {{'a': a, 'rank': rank, 't': kind || ':' || a || ':' || b, 'live': live}})) AS l
    FROM spans s JOIN spread USING (part) GROUP BY s.doc_id, s.tkey)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
    coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(array_to_string([x.t FOR x IN l IF x.rank < 3], ','), '')) AS base_sha256,
    coalesce(array_to_string([x.t FOR x IN l IF x.rank < 3 OR x.live], ','), '') AS spans,
    coalesce(len([x FOR x IN l IF x.live]), 0)::BIGINT AS n_live
FROM d LEFT JOIN listed ON d.doc_id IS NOT DISTINCT FROM listed.doc_id AND d.tkey = listed.tkey
"""

OP2 = r"""
WITH z AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS unit FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (
    SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
        2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (
    SELECT *, coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(lim, weight * max((total - filled) / open) OVER ()) AS target FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, unit) - 1 AS rank FROM z),
r AS (
    SELECT t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS shift FROM t)
SELECT k.doc_id, k.size, r.source_size, r.target, (k.size * (floor(rate) + floor((rank + 1) * (rate - floor(rate)) + shift)
    - floor(rank * (rate - floor(rate)) + shift)))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""

_CLEAN = r"chr(10)"
_W = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP10 = rf"""
WITH bench AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PLAIN}') AS w
    FROM benchmark),
pat AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bench WHERE len(w) > 0)),
doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PLAIN}') AS w FROM documents),
lens AS (SELECT DISTINCT m FROM pat),
win AS (
    SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc CROSS JOIN lens WHERE len(w) >= m)),
hit AS (SELECT win.r, win.m, win.i, pat.item_id FROM win JOIN pat ON win.m = pat.m AND win.g = pat.g),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(generate_series(0, m - 1)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n USING (r) LEFT JOIN items USING (r)
"""

OP11 = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS (
    SELECT lang, k, phrase, count(*) AS n
    FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
            FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM pieces) WHERE len(w) >= k))
    GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(n)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 100),
cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.j, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n) AS score
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:c.k], ' ')
    JOIN total t ON t.lang = c.lang),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
    SELECT * FROM worst c WHERE NOT EXISTS (
        SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a
            AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

OP13 = rf"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PLAIN}') AS w FROM documents),
b AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PLAIN}') AS w FROM benchmark),
docs AS (SELECT r, unnest(w) AS word FROM d),
items AS (SELECT unnest(w) AS word FROM b),
hexes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM docs UNION SELECT word FROM items)),
codes AS (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
        lambda c, v: xor(c >> 8, steps[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM hexes, crc),
s AS (SELECT bucket, count(*) AS n FROM docs JOIN codes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM items JOIN codes USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM docs)::DOUBLE AS sn, (SELECT count(*) FROM items)::DOUBLE AS tn),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (sn + 10000) / ((s.n::DOUBLE + 1) * (tn + 10000))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM docs JOIN codes USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r)),
ranked AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

ORACLES = {"op1_secret_scans": OP1, "op2_source_mix": OP2, "op10_wu_manber": OP10, "op11_collocations": OP11, "op13_importance": OP13}
