"""DuckDB SQL with the rows of the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

JACCARD = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS ws FROM documents),
g AS (
    SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_sides AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM both_sides JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION
    SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least r ON r.node = d.doc_id
"""


BACKOFF = f"""
WITH w AS (
    SELECT row_number() OVER () AS uid, doc_id, {WORDS.format(LOWER.format('text'))} AS ws FROM documents),
p AS MATERIALIZED (
    SELECT uid, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
           CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3
    FROM (SELECT uid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
t1 AS MATERIALIZED (SELECT g1 AS g, count(*) AS c FROM p GROUP BY 1),
t2 AS MATERIALIZED (SELECT g2 AS g, count(*) AS c FROM p WHERE g2 IS NOT NULL GROUP BY 1),
t3 AS MATERIALIZED (SELECT g3 AS g, count(*) AS c FROM p WHERE g3 IS NOT NULL GROUP BY 1),
o AS (
    SELECT *, count(*) OVER (PARTITION BY uid) AS here, count(*) OVER () AS n,
           count(*) OVER (PARTITION BY uid, g1) AS o1, count(*) OVER (PARTITION BY uid, g2) AS o2,
           count(*) OVER (PARTITION BY uid, g3) AS o3 FROM p),
c AS (
    SELECT uid, i, n - here AS others, a.c - o1 AS c1, coalesce(b.c - o2, 0) AS c2, coalesce(c.c - o3, 0) AS c3
    FROM o JOIN t1 a ON a.g = g1 LEFT JOIN t2 b ON b.g = g2 LEFT JOIN t3 c ON c.g = g3),
x AS (
    SELECT *, lag(c1) OVER (PARTITION BY uid ORDER BY i) AS h1, lag(c2) OVER (PARTITION BY uid ORDER BY i) AS h2 FROM c),
s AS (
    SELECT uid, least(i, 3) AS reach,
           CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used,
           CASE WHEN c3 > 0 THEN c3 / h2 WHEN c2 > 0 THEN c2 / h1 WHEN c1 > 0 THEN c1 / others
                ELSE 1 / greatest(others, 1) END AS ratio FROM x),
d AS (
    SELECT uid, count(*)::BIGINT AS n_words, sum((reach > used)::INT)::BIGINT AS n_backed_off,
           sum(round_even((ln(ratio) + ln(0.4::DOUBLE) * (reach - used)) * 1000000, 0)::BIGINT)::BIGINT AS micro
    FROM s GROUP BY uid)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off,
       coalesce(micro, 0) / 1000000.0::DOUBLE AS score,
       CASE WHEN n_words > 0 THEN micro / 1000000.0::DOUBLE / n_words ELSE 0.0::DOUBLE END AS mean_score
FROM w LEFT JOIN d ON d.uid = w.uid
"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
    SELECT vec_id, unnest(range(1, len(w) + 1)) AS dim, unnest(w) AS x FROM v),
s AS (
    SELECT q.vec_id AS query_id, r.vec_id, sum(q.x * r.x)::BIGINT AS score
    FROM c q JOIN c r ON q.dim = r.dim AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

MIXING = f"""
WITH d AS (
    SELECT doc_id, source, len({WORDS.format('text')})::BIGINT AS size, md5(doc_id::VARCHAR) AS at FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s),
w AS (SELECT *, ([5, 2, 1])[(number - 1) % 3 + 1]::BIGINT AS weight, 2 * source_size AS most FROM n),
l AS (
    SELECT *, 150 * sum(source_size) OVER () - 100 * coalesce(sum(most) OVER before, 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
    FROM w WINDOW before AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
    SELECT rest, open_weight FROM l WHERE rest * weight <= 100 * open_weight * most
    ORDER BY most / weight, number LIMIT 1),
t AS (
    SELECT l.source, source_size, number, coalesce(least((lev.rest * weight)::BIGINT / (100 * lev.open_weight)::BIGINT,
           most::DOUBLE), most::DOUBLE) AS target
    FROM l LEFT JOIN lev ON true),
r AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS given,
           sum(d.size) OVER (PARTITION BY t.number ORDER BY d.at, d.doc_id) - d.size AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, given) - start)
        + greatest(0, least(source_size + start + size, given) - source_size - start))::BIGINT AS taken
FROM r
"""

REPEATS = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS MATERIALIZED (
    SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s
    FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.doc_id, w.p FROM w JOIN f ON f.s = w.s WHERE w.doc_id > f.first_doc),
t AS (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM t),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last_b FROM spans GROUP BY doc_id),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans),
kept AS (
    SELECT g.doc_id, string_agg(substr(d.x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS k
    FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN d.x ELSE k || substr(d.x, (2 * last_b + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

HARD_NEGATIVES = """
WITH v AS MATERIALIZED (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, label, w) AS k, * FROM v),
c AS (SELECT k, vec_id, label, unnest(range(1, len(w) + 1)) AS dim, unnest(w) AS x FROM r),
s AS MATERIALIZED (
    SELECT a.k AS ak, a.vec_id AS anchor_id, b.k AS bk, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
    FROM c a JOIN c b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (
    SELECT ak, anchor_id, vec_id AS positive_id, score AS positive_score, bk FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.ak, p.bk ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

COLLOCATIONS = f"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")},
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (
    SELECT lang, ws, len(ws) AS m FROM (
        SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p)
    WHERE len(ws) > 0),
totals AS (SELECT lang, sum(m)::BIGINT AS n FROM w GROUP BY lang),
g1 AS (SELECT lang, x AS phrase, count(*) AS a FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL HAVING a >= 10),
g2 AS (
    SELECT lang, x, y, count(*) AS a FROM (
        SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM (SELECT lang, ws, unnest(range(1, m)) AS i FROM w))
    GROUP BY ALL HAVING a >= 10),
g3 AS (
    SELECT lang, x, y, z, count(*) AS a FROM (
        SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, m - 1)) AS i FROM w))
    GROUP BY ALL HAVING a >= 10),
f AS (
    SELECT * FROM g1 UNION ALL SELECT lang, x || ' ' || y, a FROM g2 UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a FROM g3),
cuts AS (
    SELECT lang, x || ' ' || y AS phrase, a, 1 AS k, x AS first, y AS rest FROM g2
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, 1, x, y || ' ' || z FROM g3
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, 2, x || ' ' || y, z FROM g3),
s AS (
    SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r,
           ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, x || ' ' || y AS phrase, a FROM g3 UNION ALL SELECT lang, y || ' ' || z, a FROM g3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, l, r, n, score
FROM s JOIN totals t ON t.lang = s.lang LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a
QUALIFY rank <= 2000
"""
