"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from sentivote.llm import fill_middle, mixing, near_join, pivots, secret_scan, substring_crc


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Smallest node in reach of each node over ``link`` (a, b), both ways.
REACH = """
reach(a, b) AS (
  SELECT id AS a, id AS b FROM node
  UNION
  SELECT reach.a, way.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) way ON way.a = reach.b
),
root AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def vectors() -> str:
    return f"""
WITH RECURSIVE every AS (SELECT vec_id AS id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL GROUP BY vec_id),
node AS (SELECT id FROM every),
usable AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM every
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT p.id AS a, q.id AS b FROM usable p JOIN usable q ON p.id < q.id
    WHERE list_dot_product(p.e, q.e) / (p.n * q.n) >= {pivots.COSINE}),
{REACH},
counted AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM link UNION ALL SELECT b FROM link) GROUP BY id)
SELECT root.id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = root.id AS kept FROM root LEFT JOIN counted USING (id)"""


def near_copies() -> str:
    width = near_join.WIDTH
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents
),
node AS (SELECT DISTINCT id FROM words WHERE id IS NOT NULL),
gram AS (
  SELECT DISTINCT id, unnest(CASE
    WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
),
size AS (SELECT id, count(*) AS n FROM gram GROUP BY id),
pair AS (
  SELECT a, b, c, p.n AS n, q.n AS m FROM (SELECT x.id AS a, y.id AS b, count(*) AS c FROM gram x JOIN gram y ON x.s = y.s AND x.id < y.id GROUP BY ALL)
  JOIN size p ON p.id = a JOIN size q ON q.id = b
),
link AS (SELECT a, b, c = n AND c = m AS same FROM pair WHERE c >= {near_join.SIMILARITY} * (n + m - c)),
{REACH},
side AS (SELECT a AS id, b AS other, same FROM link UNION ALL SELECT b, a, same FROM link),
counted AS (
  SELECT id, count(*) AS n_links, min(other) FILTER (WHERE same) AS first_copy, count(*) FILTER (WHERE same) AS n_same FROM side GROUP BY id
)
SELECT root.id AS doc_id, coalesce(least(root.id, first_copy), root.id) AS class_id, 1 + coalesce(n_same, 0) AS n_copies,
  coalesce(n_links, 0) AS n_links, component_id, component_id = root.id AS kept FROM root LEFT JOIN counted USING (id)"""


def secrets() -> str:
    def found(order: int, kind: str, pattern: str, keep: str) -> str:
        p = quoted(pattern)
        return f"""
  SELECT doc_id, {order} AS ord, {quoted(kind)} AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gaps FROM docs WHERE regexp_matches(text, {p})))
  ) WHERE {keep}"""

    weight = "lambda c: len(list_filter(w, lambda x: x = c)) * log2(len(list_filter(w, lambda x: x = c)))"
    n = secret_scan.WINDOW
    entropy = f"""(SELECT max(log2({n}) - list_sum(list_transform(list_distinct(w), {weight})) / {n})
      FROM (SELECT string_split(substr(m, k, {n}), '') AS w FROM (SELECT unnest(range(1, length(m) - {n} + 2)) AS k)))"""
    allowed = " AND ".join(f"NOT regexp_matches(m, {quoted(a)})" for a in secret_scan.ALLOWED)
    bar = f"CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {secret_scan.HEX_BAR} ELSE {secret_scan.KEY_BAR} END"
    base = [
        found(0, "assign", secret_scan.ASSIGN, f"length(regexp_extract(m, {quoted(secret_scan.ASSIGN)}, 1)) >= 8"),
        found(1, "access", secret_scan.ACCESS, "true"),
        found(2, "hex", secret_scan.HEX, "true"),
        found(3, "entropy", secret_scan.RUN, f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {allowed} AND {entropy} >= {bar}"),
    ]
    shown = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(base)}),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS k, count(*) FILTER (WHERE ord = 2) AS h,
    {shown} FILTER (WHERE ord < 3) AS base, {shown} AS spans FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN summed USING (doc_id)"""


def turned() -> str:
    p, s, m = fill_middle.SENTINELS
    groups = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    held = " OR ".join(f"contains(text, {quoted(x)})" for x in fill_middle.SENTINELS)
    block = lambda a, b: f"coalesce(array_to_string(lines[{a}:{b}], ''), '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || doc_id) AS d FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, {groups} FROM docs),
formed AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN d IS NULL OR text = '' OR {held} OR h3 % 100 >= {fill_middle.RATE} THEN 'plain'
      WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM cut
),
block AS (SELECT *, {block("1", "a")} AS prefix, {block("a + 1", "b")} AS middle, {block("b + 1", "n")} AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
    ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM block"""


def mixture() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))) AS key FROM documents
),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * {mixing.MOST} AS BIGINT) AS most,
    [{weights}][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)] AS weight FROM docs GROUP BY source
),
whole AS (SELECT sum(source_size) * {mixing.SHARE} / 100 AS wanted FROM src),
-- a source is at its limit if the level that takes it there asks no more than the whole
full_at AS (SELECT x.source, sum(least(y.most * x.weight, y.weight * x.most)) <= any_value(wanted) * any_value(x.weight) AS at_limit
  FROM src x, src y, whole GROUP BY x.source),
level AS (SELECT any_value(wanted) - coalesce(sum(most) FILTER (WHERE at_limit), 0) AS rest, sum(weight) FILTER (WHERE NOT at_limit) AS free
  FROM src JOIN full_at ON src.source IS NOT DISTINCT FROM full_at.source, whole),
goal AS (SELECT src.source, source_size, CASE WHEN at_limit THEN CAST(most AS DOUBLE) ELSE weight * CAST(rest AS DOUBLE) / free END AS target
  FROM src JOIN full_at ON src.source IS NOT DISTINCT FROM full_at.source, level),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, key
  FROM docs JOIN goal ON docs.source IS NOT DISTINCT FROM goal.source),
copied AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(CAST('0x' || substr(sha256('{mixing.SEED}:' || key), 1, 13) AS BIGINT) AS DOUBLE)
  < (rate - floor(rate)) * 4503599627370496 THEN 1 ELSE 0 END AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM copied"""


def resampling() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n, step = substring_crc.BUCKETS, f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {substring_crc.POLYNOMIAL}) ELSE c >> 1 END"
    words = lambda table: f"regexp_extract_all(translate(coalesce({table}.text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: {step}, i)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words("documents")} AS w FROM documents),
word AS (SELECT r, unnest(w) AS w FROM docs),
wanted AS (SELECT unnest({words("benchmark")}) AS w FROM benchmark),
bucket AS (
  SELECT w, xor(list_reduce(list_transform(range(CAST(length(hex(w)) / 2 AS INT)), lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {n} AS b FROM (SELECT w FROM word UNION SELECT w FROM wanted), tab
),
s AS (SELECT b, count(*) AS n FROM word JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN bucket USING (w) GROUP BY b),
gain AS (
  SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + {n}) AS DOUBLE)
    / CAST((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {n}) AS DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)
),
total AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS g FROM word JOIN bucket USING (w) JOIN gain USING (b) GROUP BY r),
weighed AS (
  SELECT r, doc_id, len(w) AS n_features, coalesce(CAST(floor(g / CAST(n_features AS DOUBLE)) AS BIGINT), 0) AS weight,
    CAST('0x' || substr(sha256('{substring_crc.SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM docs LEFT JOIN total USING (r)
),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored
  WHERE n_features >= {substring_crc.LEAST_WORDS} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {substring_crc.DRAWN} * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (r)"""


def sql() -> dict[str, str]:
    return {
        "op4_pivots": vectors(), "op6_secrets": secrets(), "op7_near_join": near_copies(),
        "op11_fill_middle": turned(), "op12_mixing": mixture(), "op13_substring_crc": resampling(),
    }
