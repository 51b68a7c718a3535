"""DuckDB SQL for the operators that SQL can express, over whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"

EXACT = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
w AS (SELECT *, [3, 1, 2][(number % 3)::INT + 1]::BIGINT AS weight FROM n),
b AS (
  SELECT *, (coalesce(sum(source_size) OVER o, 0) * 2)::BIGINT AS stopped,
         (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS open, (sum(source_size) OVER ())::BIGINT AS total
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - stopped) / open AS level FROM b),
e AS (SELECT level AS last_level FROM l WHERE level * weight <= source_size * 2 ORDER BY source_size::DOUBLE / weight, number LIMIT 1),
t AS (SELECT source, number, source_size, least(source_size * 2.0::DOUBLE, last_level * weight) AS target FROM l, e),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.number, floor(t.target)::BIGINT AS goal,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)))::BIGINT AS taken,
         CASE WHEN goal <> 0 THEN start::DOUBLE / goal END AS done
  FROM r)
SELECT doc_id, source, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN
         CASE number % 3 WHEN 0 THEN 0.0::DOUBLE + (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2 * done)) - 1.5::DOUBLE) / (-1.0::DOUBLE)
                         WHEN 1 THEN done
                         ELSE 0.0::DOUBLE + (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2 * done)) - 0.5::DOUBLE) / 1.0::DOUBLE END END AS position
FROM k
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT l.*, k.first_doc IS NOT NULL AND l.doc_id > k.first_doc AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_AFTER = r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + _AFTER, 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]+)", 1, 24),
    ("cred", "([Pp][Ww][Dd]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll]|[Pp][Rr][Ii][Vv][Aa][Tt][Ee]_?[Kk][Ee][Yy]|[Aa][Uu][Tt][Hh]_?[Kk][Ee][Yy])" + _AFTER, 2, 12),
    ("vendor", r"(gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 24),
)
_FOUND = "\nUNION ALL\n".join(
    f"SELECT seq, doc_id, source, {i} AS kind, '{name}' AS name, {least} AS least, "
    f"unnest(regexp_extract_all(text, '{pattern}', 0)) AS whole, unnest(regexp_extract_all(text, '{pattern}', {group})) AS value, "
    f"unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{pattern}', 0), 1) AS i FROM d WHERE regexp_matches(text, '{pattern}')"
    for i, (name, pattern, group, least) in enumerate(_KINDS)
)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS seq, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY seq, kind ORDER BY i) AS stop FROM f),
q AS (
  SELECT seq, doc_id, source, kind, name, (stop - length(whole))::BIGINT AS start, stop::BIGINT AS stop, value,
         length(value) >= 16 AND regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT >= 2
         AND len(list_distinct(string_split(value, ''))) >= 8
         AND NOT regexp_matches(value, '(?i)example|sample|dummy|changeme|xxxx|1234567|placeholder') AS random
  FROM p WHERE length(value) >= least),
v AS (
  SELECT value, CASE WHEN bool_or(random) AND count(DISTINCT source) <= 1 THEN 'live'
                     WHEN count(DISTINCT source) >= 3 THEN 'example' ELSE 'unclear' END AS verdict
  FROM q GROUP BY value),
x AS (SELECT q.*, verdict, name || ':' || start || ':' || stop AS label FROM q JOIN v USING (value) WHERE kind < 3 OR verdict = 'live'),
a AS (
  SELECT seq, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
         string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(label, ',' ORDER BY start, kind) AS spans
  FROM x GROUP BY seq)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (seq)
"""

ORACLES = {"op4_exact_dedup": EXACT, "op5_mixing": MIXING, "op7_line_dedup": LINES, "op8_secrets": SECRETS}
