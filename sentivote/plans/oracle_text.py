"""Second formulation of the text operators, in SQL over exploded lines.

The engine works inside each document's row; these statements explode lines and
use window functions instead, which makes them an independent check.
"""

from __future__ import annotations

from sentivote.operators import boundaries


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ASCII whitespace is all the supplied tables contain.
WS_CHARS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
KEYS = "source_folder, source_file"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def rx(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"


def chain(x: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        x = rx(x, p, r)
    return x


# The patterns of cleaning, in their order.
MARKUP = [
    (r'(?i)<span\s+id="[^"]*"[^>]*>.*?</span>', ""),
    (r"<[^>]+>", ""),
    (r"&[a-z]+;|&#[0-9]+;", " "),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"\*{1,3}(.+?)\*{1,3}", r"\1"),
    (r"`(.+?)`", r"\1"),
    (r"\\(.)", r"\1"),
    (r"[ \t]{2,}", " "),
]
INLINE = [
    (r"https?://\S+", ""),
    (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
    (r"[*_]{1,2}([^*_]+)[*_]{1,2}", r"\1"),
    (r"`[^`]+`", ""),
]


def noise(x: str) -> str:
    s = strip(x)
    return (
        f"({s} = '' OR regexp_matches({s}, '^(https?://\\S+|www\\.\\S+|[-*_]{{3,}}\\s*|[0-9\\s.\\-:|/\\\\+()]+)$'))"
    )


def fingerprint(x: str) -> str:
    return f"md5(regexp_replace({strip(f'lower({x})')}, '\\s+', ' ', 'g'))"


LINES = """
raw_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
  FROM documents
),
md_marked AS (
  SELECT source AS source_folder, 'doc_' || doc_id || '.md' AS source_file, n,
    CASE (n + doc_id) % 17
      WHEN 0 THEN repeat('#', CAST(1 + n % 3 AS INTEGER)) || ' ' || l
      WHEN 2 THEN '- ' || l
      WHEN 3 THEN '12. ' || l
      WHEN 4 THEN '**' || substr(l, 1, 12) || '** ' || l
      WHEN 5 THEN '[' || substr(l, 1, 12) || '](https://example.com/p?q=1) ' || l
      WHEN 6 THEN '![plan](a.png)' || chr(10) || l
      WHEN 7 THEN '***---' || chr(10) || l
      WHEN 8 THEN '| ' || l || ' | x |'
      WHEN 9 THEN '|---|:--|' || chr(10) || l
      WHEN 10 THEN ':-- -' || chr(10) || l
      WHEN 11 THEN chr(10) || l
      WHEN 13 THEN '```' || chr(10) || l
      WHEN 15 THEN '```' || chr(10) || l
      WHEN 16 THEN '<span id="p1">x</span><b>' || l || '</b>&nbsp;`fin` \\* 2  a'
      ELSE l END AS marked
  FROM raw_lines
),
md_parts AS (
  SELECT source_folder, source_file, n, unnest(string_split(marked, chr(10))) AS line,
         generate_subscripts(string_split(marked, chr(10)), 1) AS part
  FROM md_marked
),
md_lines AS (
  SELECT source_folder, source_file, line,
    row_number() OVER (PARTITION BY source_folder, source_file ORDER BY n, part) - 1 AS line_no
  FROM md_parts
)"""

CLEAN = f"""
fenced AS (
  SELECT *, starts_with({strip('line')}, '```') AS is_fence,
    sum(CASE WHEN starts_with({strip('line')}, '```') THEN 1 ELSE 0 END)
      OVER (PARTITION BY {KEYS} ORDER BY line_no) % 2 = 1 AS odd
  FROM md_lines
),
kept AS (
  SELECT *, is_fence OR odd AS verbatim FROM fenced
  WHERE is_fence OR odd OR NOT (
    regexp_matches({strip('line')}, '^[-=_*]{{3,}}\\s*$')
    OR ({strip('line')} <> '' AND {strip(rx(strip('line'), MARKUP[3][0], ''))} = ''))
),
cleaned AS (
  SELECT {KEYS}, line_no,
    CASE WHEN verbatim THEN line ELSE {strip(chain('line', MARKUP))} END AS line
  FROM kept
),
clean_docs AS (
  SELECT d.source AS source_folder, 'doc_' || d.doc_id || '.md' AS source_file,
    {strip("regexp_replace(coalesce(c.joined, ''), '\\n{3,}', chr(10)||chr(10), 'g')")} AS text
  FROM documents d LEFT JOIN (
    SELECT {KEYS}, string_agg(line, chr(10) ORDER BY line_no) AS joined FROM cleaned GROUP BY ALL
  ) c ON c.source_folder = d.source AND c.source_file = 'doc_' || d.doc_id || '.md'
),
clean_doc_lines AS (
  SELECT {KEYS}, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM clean_docs
)"""


def tokens(lines: str) -> str:
    """CTEs ending in ``tok(source_folder, source_file, tok_pos, kind, level, text)``."""
    return f"""
tf AS (
  SELECT {KEYS}, line_no, {strip('line')} AS s,
    starts_with({strip('line')}, '```') AS is_fence,
    sum(CASE WHEN starts_with({strip('line')}, '```') THEN 1 ELSE 0 END)
      OVER (PARTITION BY {KEYS} ORDER BY line_no) % 2 = 1 AS odd
  FROM {lines}
),
live AS (
  SELECT *, NOT is_fence AND starts_with(s, '|') AS is_table,
    NOT is_fence AND NOT starts_with(s, '|') AND s <> '' AND regexp_matches(s, '^[|\\-:\\s]+$') AS is_sep
  FROM tf WHERE is_fence OR NOT odd
),
stated AS (
  SELECT *, coalesce(last_value(CASE WHEN is_fence OR is_sep THEN NULL ELSE is_table END IGNORE NULLS)
      OVER (PARTITION BY {KEYS} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_table
  FROM live
),
kinded AS (
  SELECT {KEYS}, line_no, s,
    CASE WHEN is_fence OR is_table THEN 'F'
      WHEN is_sep AND in_table THEN 'D'
      WHEN starts_with(s, '![') OR regexp_matches(s, '^(https?://\\S+|www\\.\\S+)$') THEN 'D'
      WHEN s = '' THEN 'F'
      WHEN regexp_matches(s, '^#{{1,6}}\\s+.+') THEN 'H'
      WHEN regexp_matches(s, '^([-*+]|[0-9]+\\.)\\s+.+') THEN 'B'
      ELSE 'X' END AS kind
  FROM stated
),
paid AS (
  SELECT {KEYS}, line_no, kind,
    CASE kind
      WHEN 'H' THEN {strip(chain(strip("regexp_extract(s, '^#{1,6}\\s+(.+)', 1)"), INLINE))}
      WHEN 'B' THEN {strip(chain(strip("regexp_extract(s, '^([-*+]|[0-9]+\\.)\\s+(.+)', 2)"), INLINE))}
      WHEN 'X' THEN {strip(chain('s', INLINE))} END AS payload,
    length(regexp_extract(s, '^(#{{1,6}})\\s', 1)) AS lvl
  FROM kinded WHERE kind <> 'D'
),
settled AS (
  SELECT {KEYS}, line_no, payload, lvl,
    CASE WHEN kind IN ('H', 'B') AND payload = '' THEN 'F' ELSE kind END AS kind
  FROM paid WHERE NOT (kind = 'X' AND payload = '')
),
blocked AS (
  SELECT *, sum(CASE WHEN kind <> 'X' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY line_no) AS block_id
  FROM settled
),
blocks AS (
  SELECT {KEYS}, min(line_no) AS line_no, string_agg(payload, ' ' ORDER BY line_no) AS text
  FROM blocked WHERE kind = 'X' GROUP BY source_folder, source_file, block_id
),
listed AS (
  SELECT {KEYS}, line_no, 'text' AS kind, CAST(NULL AS INTEGER) AS level, text FROM blocks WHERE NOT {noise('text')}
  UNION ALL
  SELECT {KEYS}, line_no, CASE kind WHEN 'H' THEN 'title' ELSE 'bullet' END,
    CASE kind WHEN 'H' THEN CAST(lvl AS INTEGER) END, payload
  FROM blocked WHERE kind IN ('H', 'B')
),
tok AS (
  SELECT {KEYS}, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY line_no) - 1 AS INTEGER) AS tok_pos,
    kind, level, text
  FROM listed
)"""


RULE_PIECES = f"""
pieces AS (
  SELECT {KEYS}, tok_pos, text AS block,
    list_transform(list_filter(string_split(regexp_replace(text, '([.!?…]\\s+)', '\\1' || chr(10), 'g'), chr(10)),
      lambda x: x <> ''), lambda x: {strip('x')}) AS p
  FROM tok WHERE kind = 'text'
)"""

MERGED = f"""
merging AS (
  SELECT {KEYS}, tok_pos, block, p, 1 AS i, 0 AS n_out, p[1] AS cur, CAST(NULL AS VARCHAR) AS done FROM pieces
  UNION ALL
  SELECT {KEYS}, tok_pos, block, p, i + 1,
    CASE WHEN takes THEN n_out ELSE n_out + 1 END,
    CASE WHEN takes THEN cur || ' ' || p[i + 1] ELSE p[i + 1] END,
    CASE WHEN takes THEN NULL ELSE cur END
  FROM (
    SELECT *, length(cur) < 80 AND strpos(block, cur) > 0
      AND strpos(substr(block, strpos(block, cur) + length(cur)), p[i + 1]) > 0 AS takes
    FROM merging WHERE i < len(p)
  )
),
sent AS (
  SELECT {KEYS}, tok_pos, n_out - 1 AS sent_pos, done AS text FROM merging WHERE done IS NOT NULL
  UNION ALL
  SELECT {KEYS}, tok_pos, n_out, cur FROM merging WHERE i = len(p)
)"""

SENTENCES = RULE_PIECES + "," + MERGED


def boundary_words() -> str:
    """CTEs ending in ``learnt(kind, word, n, score)``, over the text blocks of ``tok``."""
    core = f"trim(x, {sql_text(boundaries.AROUND)})"
    chance = lambda k, n, p: f"(CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({p}) END + CASE WHEN {n} - {k} = 0 THEN 0 ELSE ({n} - {k}) * ln(1 - {p}) END)"
    apart = f"{chance('k', 'b', '(k / b)')} + {chance('(c - k)', '(m - b)', '((c - k) / (m - b))')}"
    alike = f"{chance('k', 'b', '(c / m)')} + {chance('(c - k)', '(m - b)', '(c / m)')}"

    def standing_out(name: str, kind: str, rows: str, least: float) -> str:
        return f"""
{name}_rows AS ({rows}),
{name} AS (
  SELECT kind, word, n, score FROM (
    SELECT '{kind}' AS kind, follower AS word, CAST(k AS BIGINT) AS n, 2 * ({apart} - ({alike})) AS score, k / b > c / m AS more FROM (
      SELECT f.follower, CAST(f.k AS DOUBLE) AS k, CAST(w.n AS DOUBLE) AS c, CAST((SELECT sum(n) FROM {name}_rows) AS DOUBLE) AS b, m
      FROM (SELECT follower, sum(n) AS k FROM {name}_rows GROUP BY follower) f JOIN per_word w ON w.type = f.follower, totals)
  ) WHERE more AND score >= {least}
)"""

    return f"""
core_words AS (
  SELECT r, i, core, CASE WHEN regexp_matches(core, '{boundaries.NUMERIC}') THEN '#' ELSE lower(regexp_replace(core, '\\.$', '')) END AS type
  FROM (SELECT r, generate_subscripts(t, 1) AS i, unnest(list_transform(t, lambda x: {core})) AS core FROM (
    SELECT row_number() OVER () AS r, list_filter(string_split_regex({strip('text')}, '\\s+'), lambda x: x <> '') AS t FROM tok WHERE kind = 'text'))
),
word_counts AS (
  SELECT type, dot, follower, count(*) AS n FROM (
    SELECT type, ends_with(core, '.') AS dot, CASE WHEN ends_with(core, '.') THEN nullif(behind, '') END AS follower
    FROM (SELECT *, lead(type) OVER (PARTITION BY r ORDER BY i) AS behind FROM core_words) WHERE type <> '') GROUP BY ALL
),
totals AS (SELECT CAST(sum(n) AS DOUBLE) AS m, CAST(sum(n) FILTER (WHERE dot) AS DOUBLE) AS d FROM word_counts),
per_word AS (SELECT type, coalesce(sum(n) FILTER (WHERE dot), 0) AS dotted, sum(n) AS n FROM word_counts GROUP BY type),
short AS (
  SELECT 'abbreviation' AS kind, type AS word, CAST(dotted AS BIGINT) AS n,
    2 * ({chance('dotted', 'n', str(boundaries.CERTAIN))} - {chance('dotted', 'n', '(d / m)')}) * exp(-letters) * (length(type) - letters + 1)
      * pow(letters, -CAST(n - dotted AS DOUBLE)) AS score
  FROM (SELECT *, CAST(length(replace(type, '.', '')) AS DOUBLE) AS letters FROM per_word), totals
  WHERE dotted > 0 AND regexp_matches(type, '\\p{{L}}') AND score >= {boundaries.ABBREVIATION}
),{standing_out('starting', 'starter', "SELECT * FROM word_counts WHERE follower IS NOT NULL AND type <> '#' AND type NOT IN (SELECT word FROM short)", boundaries.STARTER)},
{standing_out('ordered', 'ordinal', "SELECT * FROM word_counts WHERE follower IS NOT NULL AND type = '#'", boundaries.COLLOCATION)},
learnt AS (
  SELECT * FROM short UNION ALL SELECT * FROM starting
  UNION ALL SELECT * FROM ordered WHERE n > 1 AND word NOT IN (SELECT word FROM starting)
)"""


def learned_pieces() -> str:
    """CTE ``pieces`` with the rule's cuts less those that ``learnt`` rules out."""
    bare = lambda x: f"trim({x}, {sql_text(boundaries.AROUND)})"
    kind = lambda x: f"CASE WHEN regexp_matches({x}, '{boundaries.NUMERIC}') THEN '#' ELSE lower(regexp_replace({x}, '\\.$', '')) END"
    known = lambda x, name: f"{x} IN (SELECT word FROM learnt WHERE kind = '{name}')"
    return f"""
rule_cut AS (
  SELECT {KEYS}, tok_pos, text AS block, generate_subscripts(q, 1) AS i, unnest(q) AS piece FROM (
    SELECT *, list_filter(string_split(regexp_replace(text, '([.!?…]\\s+)', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS q FROM tok WHERE kind = 'text')
),
borders AS (
  SELECT *, {bare(f"regexp_extract({strip('piece')}, '(?:^|\\s)(\\S+)$', 1)")} AS core,
    {bare(f"regexp_extract({strip('next_piece')}, '^\\S+')")} AS follower
  FROM (SELECT *, lead(piece) OVER (PARTITION BY {KEYS}, tok_pos ORDER BY i) AS next_piece FROM rule_cut)
),
typed_borders AS (SELECT *, {kind('core')} AS w, {kind('follower')} AS u, substr(follower, 1, 1) AS f FROM borders),
decided AS (
  SELECT *, next_piece IS NOT NULL AND ends_with(core, '.') AND (
    ({known('w', 'abbreviation')} AND NOT (f <> lower(f) AND {known('u', 'starter')}))
    OR (w = '#' AND (f <> upper(f) OR {known('u', 'ordinal')}))) AS on_it FROM typed_borders
),
islands AS (
  SELECT *, coalesce(sum(CASE WHEN on_it THEN 0 ELSE 1 END) OVER (PARTITION BY {KEYS}, tok_pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM decided
),
joined_pieces AS (SELECT {KEYS}, tok_pos, block, g, {strip("string_agg(piece, '' ORDER BY i)")} AS piece FROM islands GROUP BY source_folder, source_file, tok_pos, block, g),
pieces AS (SELECT {KEYS}, tok_pos, block, list(piece ORDER BY g) AS p FROM joined_pieces GROUP BY source_folder, source_file, tok_pos, block)"""


PHRASES = f"""
units AS (
  SELECT {KEYS}, tok_pos, 0 AS sent_pos, kind, {strip('text')} AS text FROM tok WHERE kind <> 'text'
  UNION ALL
  SELECT {KEYS}, tok_pos, sent_pos, 'text', {strip('text')} FROM sent
),
sectioned AS (
  SELECT *, sum(CASE WHEN kind = 'title' THEN 1 ELSE 0 END)
      OVER (PARTITION BY {KEYS} ORDER BY tok_pos, sent_pos) AS section
  FROM units
),
spoken AS (SELECT *, {fingerprint('text')} AS fp FROM sectioned WHERE NOT {noise('text')}),
first_seen AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS}, fp ORDER BY tok_pos, sent_pos) AS rn FROM spoken
),
phrases AS (
  SELECT {KEYS}, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY tok_pos, sent_pos) - 1 AS INTEGER) AS phrase_index,
    text AS phrase
  FROM first_seen WHERE rn = 1
)"""

PARAGRAPHS = f"""
events AS (
  SELECT *, CASE WHEN kind = 'title' THEN 1 ELSE 0 END AS closing FROM spoken
),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS}, fp ORDER BY section, closing, tok_pos, sent_pos) AS rn FROM events
),
titles AS (SELECT {KEYS}, section, text AS section_title, rn AS title_rn FROM counted WHERE closing = 1),
inside AS (SELECT {KEYS}, section, tok_pos, sent_pos, text FROM counted WHERE closing = 0 AND rn = 1),
all_sections AS (SELECT DISTINCT {KEYS}, section FROM sectioned),
emitted AS (
  SELECT a.source_folder, a.source_file, a.section, coalesce(t.section_title, '') AS section_title
  FROM all_sections a
  LEFT JOIN titles t USING (source_folder, source_file, section)
  WHERE t.title_rn = 1
     OR EXISTS (SELECT 1 FROM inside i WHERE i.source_folder = a.source_folder
                AND i.source_file = a.source_file AND i.section = a.section)
),
para AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY section) - 1 AS INTEGER) AS paragraph_index FROM emitted
),
para_phrases AS (
  SELECT p.source_folder, p.source_file, p.paragraph_index, p.section_title,
    CASE WHEN i.text IS NOT NULL THEN CAST(row_number() OVER (
      PARTITION BY p.source_folder, p.source_file, p.section ORDER BY i.tok_pos, i.sent_pos) - 1 AS INTEGER) END AS phrase_index,
    i.text AS phrase
  FROM para p LEFT JOIN inside i USING (source_folder, source_file, section)
)"""

SIMPLE = f"""
sl AS (SELECT {KEYS}, line_no, {strip('line')} AS s FROM md_lines),
sb AS (
  SELECT *, sum(CASE WHEN s = '' OR starts_with(s, '#') THEN 1 ELSE 0 END) OVER w AS block_id,
    last_value(CASE WHEN starts_with(s, '#') THEN {strip("regexp_replace(s, '^#+', '')")} END IGNORE NULLS) OVER w AS title
  FROM sl WINDOW w AS (PARTITION BY {KEYS} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
sg AS (
  SELECT {KEYS}, min(line_no) AS line_no, coalesce(any_value(title), 'Introduction') AS section_title,
    {strip("string_agg(s, ' ' ORDER BY line_no)")} AS paragraph
  FROM sb WHERE s <> '' AND NOT starts_with(s, '#') GROUP BY source_folder, source_file, block_id
)"""


def statement(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + body
