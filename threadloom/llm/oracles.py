"""SQL of the operators' queries that SQL can express in full, over the same tables."""

from __future__ import annotations

#: Links by comparing the rarest shingles of each set, then the whole sets; groups by recursion.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (
  SELECT rep, n, unnest(s) AS t FROM classes
), ranked AS (
  SELECT rep, n, t, row_number() OVER (PARTITION BY rep ORDER BY f, t) AS k FROM tokens JOIN (SELECT t, count(*) AS f FROM tokens GROUP BY t) USING (t)
), rare AS (
  SELECT rep, n, t FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.t = b.t AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), shared AS (
  SELECT a, b, len(list_intersect(x.s, y.s)) AS i, x.n + y.n AS n FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b
), links AS (
  SELECT a, b FROM shared WHERE 100 * i >= 80 * (n - i)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), part AS (
  SELECT b AS rep, min(a) AS c FROM reach GROUP BY b
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(p.c, d.doc_id) AS component_id, coalesce(p.c, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN part p ON p.rep = c.rep
"""

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size, concat_ws('-', doc_id, md5(text)) AS k FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), listed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM sizes
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM listed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, level LIMIT 1), CAST('inf' AS DOUBLE)) * w) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2) ELSE 0 END AS rate FROM goals
), draws AS (
  SELECT s.doc_id, s.k, s.size, r.*, seed, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || md5(seed || '-' || s.k)[1:13] AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(32) t(seed)
), totals AS (
  SELECT source, seed, abs(CAST(sum(size * copies) AS DOUBLE) - any_value(target)) AS far FROM draws GROUP BY source, seed
), chosen AS (
  SELECT source, seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY far, seed) AS place FROM totals) WHERE place = 1
)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed
"""

#: All runs of words from each place of each piece.
PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), runs AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed)
), one AS (
  SELECT lang, x, count(*) AS f FROM runs GROUP BY ALL
), two AS (
  SELECT lang, x, y, count(*) AS f FROM runs WHERE y IS NOT NULL GROUP BY ALL
), three AS (
  SELECT lang, x, y, z, count(*) AS f FROM runs WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  LEFT JOIN longer g ON g.lang = t.lang AND g.x = t.x AND g.y = t.y WHERE t.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * t.f)
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
), scored AS (
  SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _places(kind: str, pattern: str, keep: str, value: str) -> str:
    """A subquery of one kind's matches: what stands between matches and the matches themselves give the places."""
    return f"""SELECT row, {kind} AS kind, s, s + length(m) AS e, {value} AS value, m FROM (
  SELECT row, m, CAST(coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
    SELECT row, between, matches, unnest(range(1, len(matches) + 1)) AS i, unnest(matches) AS m FROM (
      SELECT row, string_split_regex(text, '{pattern}') AS between, regexp_extract_all(text, '{pattern}') AS matches FROM docs WHERE regexp_matches(text, '{pattern}'))))
  WHERE {keep}"""


def secret_ownership(assign: str, access: str, hex_: str, token: str, different: int, assigned: int, owners: int, repos: int) -> str:
    quoted = assign.replace("'", "''")
    value = f"regexp_extract(m, '{quoted}', 2)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source, concat_ws('/', source, lang) AS repo FROM documents
), base AS (
  {_places("0", quoted, f"length({value}) >= {assigned}", value)} UNION ALL {_places("1", access, "true", "m")} UNION ALL {_places("2", hex_, "true", "m")}
), mixed AS (
  {_places("3", token, f"len(list_distinct(string_split(m, ''))) >= {different} AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')", "m")}
), hits AS (
  SELECT * FROM base UNION ALL SELECT * FROM mixed t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.s < t.e AND t.s < b.e)
), held AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) >= {owners} OR count(DISTINCT (coalesce(source, chr(0)), coalesce(repo, chr(0)))) >= {repos} AS example FROM hits JOIN docs USING (row) GROUP BY value
), shown AS (
  SELECT row, kind, example, s, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || s || ':' || e AS span FROM hits JOIN held USING (value)
), told AS (
  SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
  string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR NOT example) AS spans, count(*) FILTER (example) AS x FROM shown GROUP BY row
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(x, 0) AS n_examples
FROM docs LEFT JOIN told USING (row)
"""
