"""SQL twins of the call, parsing, structure and flagship queries."""

from __future__ import annotations

from sentivote import vocab
from sentivote.functions import language
from sentivote.plans import oracle_text as X
from sentivote.plans.fixtures import ANSWER_MODELS, RULES

K = "source_folder, source_file, phrase_index"


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def case(selector: str, options: list[str]) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def call_sql(o) -> dict[str, str]:
    """``o`` is the module holding the shared CTEs."""
    d = o.d
    # What each of the sixteen reply shapes means; the last one is text in braces.
    has_oui = "contains(lower(text), 'oui')"
    yes, no, none = "'oui'", "'non'", "false"
    shape = d("h", 1)
    loose = [yes, yes, yes, no, no, no, no, no, yes, yes, yes, no, no, yes, no, f"CASE WHEN {has_oui} THEN 'oui' ELSE 'non' END"]
    loose_failed = [none] * 4 + ["true"] + [none] * 9 + ["true", none]
    strict = [yes, no, no, no, no, no, yes, no, yes, yes, yes, no, no, no, no, no]
    strict_failed = [none, none, "true", none, "true", "true"] + [none] * 7 + ["true", "true", "true"]
    replies = f"""
rh AS (SELECT doc_id, text, question_key, md5(CAST(doc_id AS VARCHAR) || '|' || question_key || '|raw') AS h FROM documents, questions)"""

    def parsed(answer: list[str], failed: list[str]) -> str:
        return o.with_(
            f"SELECT doc_id, question_key, {case(shape, answer)} AS answer, {case(shape, failed)} AS failed FROM rh",
            o.QUESTIONS, replies,
        )

    cat = case(d("h", 1) + " % 8", [quote(c) for c in
               ("ROI", "ROI", "Notoriete", "Notoriete", "Obligation", "Description", "Description", "Notoriete")])
    conf = case(d("h", 2) + " % 8", ["0.55::DOUBLE", "0.8", "1.0", "0.0", "0.5", "0.5", "1.0", "0.25"])
    bad = f"{d('h', 5)} % 4 = 3"
    roi1 = f"CASE WHEN {d('h', 3)} < 8 THEN 'oui' ELSE 'non' END"
    obl3 = f"CASE WHEN {d('h', 4)} < 8 THEN 'oui' ELSE 'non' END"
    prompt = (
        "'Phrase : \"' || text || '\"' || chr(10) || chr(10) || 'Question : ' || texte || chr(10) || chr(10) || "
        "'Réponds UNIQUEMENT avec ce JSON valide (sans markdown) :' || chr(10) || '{\"reponse\": \"oui\"} ou {\"reponse\": \"non\"}'"
    )
    context = "'Paragraphe de contexte :' || chr(10) || '\"\"\"' || full_paragraph || '\"\"\"' || chr(10) || chr(10) || "
    para_prompt = context + prompt.replace("'Phrase : ", "'Phrase à analyser : ").replace("|| text ||", "|| phrase ||")
    qtext = o.values("qtext", "question_key, texte", [(q.key, q.text) for q in vocab.QUESTIONS])
    contexts, context_ctes = o.unit_contexts()
    words = lambda ws: "len(list_filter(w, lambda x: x IN (" + ", ".join(quote(x) for x in ws) + ")))"
    langs = list(language.PROFILES)
    counts = ", ".join(f"{words(ws)} AS n_{lang}" for lang, ws in language.PROFILES.items())
    best = "greatest(" + ", ".join(f"n_{lang}" for lang in langs) + ")"
    detected = "CASE WHEN " + best + " = 0 THEN '-' " + " ".join(f"WHEN n_{lang} = {best} THEN '{lang}'" for lang in langs) + " END"
    lang_ctes = f"""
lw AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
lc AS (SELECT doc_id, lang, {counts} FROM lw),
ld AS (SELECT doc_id, lang, {detected} AS lang_detected FROM lc)"""
    rule = "CASE WHEN " + " OR ".join(
        f"(question_key = '{q}' AND regexp_matches(text, '{p}'))" for q, p in RULES.items()) + " THEN 'oui' ELSE 'non' END"
    said = " || chr(10) || ".join(
        f"'  {q}: ' || " + ("CASE WHEN categorie = 'ROI' THEN 'oui' ELSE 'non' END" if q == "roi_1" else "'non'") for q in vocab.QUESTION_KEYS)
    docs = "SELECT lang AS source_folder, source AS source_file, CAST(doc_id AS INTEGER) AS phrase_index, doc_id, text FROM documents"
    return {
        "parse_answers": parsed(loose, loose_failed),
        "parse_answers_strict": parsed(strict, strict_failed),
        "parse_predictions": o.with_(
            f"""SELECT doc_id, CASE WHEN {bad} THEN 'Description' ELSE {cat} END AS categorie,
            CASE WHEN {bad} THEN 0.0::DOUBLE ELSE {conf} END AS confiance, CASE WHEN {bad} THEN '' ELSE 'j' END AS justification,
            CASE WHEN {bad} THEN 'non,non,non,non,non,non,non,non,non'
              ELSE {roi1} || ',non,non,non,oui,non,non,non,' || {obl3} END AS answers, {bad} AS failed
            FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '|structured') AS h FROM documents)""",
            "unused AS (SELECT 1)"),
        "chat_content": f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '' ELSE {X.strip('text')} END AS raw,
            CAST(CASE WHEN turn % 4 = 2 THEN 0 ELSE length(text) END AS INTEGER) AS tok_in,
            CAST(CASE WHEN turn % 4 IN (2, 3) THEN 0 ELSE turn END AS INTEGER) AS tok_out, turn % 4 = 2 AS failed FROM conversations""",
        "call_plan": o.with_(f"SELECT {K}, question_key, model FROM u, questions, models", o.QUESTIONS, o.model_list(ANSWER_MODELS), o.UNITS),
        "call_costs": o.with_(
            f"""SELECT {K}, model, question_key, {o.usd('cents', 10)} AS cost_usd, {o.eur('cents', 10)} AS cost_eur FROM (
              SELECT *, CAST(tok_in * CAST(round(pin * 100) AS BIGINT) + tok_out * CAST(round(pout * 100) AS BIGINT) AS HUGEINT) AS cents
              FROM calls JOIN prices USING (model))""", *o.VOTE_CTES),
        "phrase_prompts": o.with_(f"SELECT {K}, question_key, model, md5({prompt}) AS prompt_md5 FROM ({docs}), qtext, models", qtext, o.model_list(ANSWER_MODELS)),
        "paragraph_prompts": X.statement(
            f"""SELECT source_folder, source_file, paragraph_index, phrase_index, question_key, model, md5({para_prompt}) AS prompt_md5
            FROM {contexts}, qtext, models""", *context_ctes, qtext, o.model_list(ANSWER_MODELS)),
        "segment_prompts": o.with_(
            f"""SELECT {o.S}, model, md5(CASE WHEN contains(model, 'qwen') THEN '/no_think ' ELSE 'Titre : ' END || 'Introduction' || chr(10) || text)
            AS prompt_md5 FROM u JOIN documents ON doc_id = paragraph_index, models""", o.model_list(ANSWER_MODELS), o.SEGMENTS),
        "judge_prompts": o.with_(
            f"""SELECT {o.S}, md5('Introduction' || chr(10) || text || chr(10) || chr(10) || categorie || ' ' || CAST(confiance AS VARCHAR)
            || chr(10) || {said}) AS prompt_md5 FROM pred JOIN documents ON doc_id = paragraph_index WHERE model_idx = 0""",
            o.model_list(ANSWER_MODELS), o.SEGMENTS, o.PREDICTIONS),
        "external_answers": o.with_(
            f"""SELECT {K}, question_key, model, CASE WHEN length({prompt}) % 2 = 0 THEN 'oui' ELSE 'non' END AS answer,
            CAST(length({prompt}) + 10 AS INTEGER) AS tok_in, 5 AS tok_out FROM ({docs}), qtext, models""",
            qtext, o.model_list(ANSWER_MODELS)),
        "answers_once": o.with_(
            f"""SELECT {K}, question_key, model, CASE WHEN length({prompt}) % 2 = 0 THEN 'oui' ELSE 'non' END AS answer,
            CAST(length({prompt}) + 10 AS INTEGER) AS tok_in, 5 AS tok_out,
            phrase_index IN (SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE starts_with(source, 'src1'))) AS reused FROM ({docs}), qtext, models""",
            qtext, o.model_list(ANSWER_MODELS)),
        "recorded_answers": o.with_(
            f"""SELECT lang AS source_folder, source AS source_file, CAST(doc_id AS INTEGER) AS phrase_index, question_key, model,
            CASE WHEN doc_id % 10 = 3 THEN 'non' ELSE {case(shape, loose)} END AS answer,
            CASE WHEN doc_id % 10 = 3 OR {case(shape, loose_failed)} THEN 0 ELSE 10 END AS tok_in,
            doc_id % 10 = 3 OR {case(shape, loose_failed)} AS failed FROM rh JOIN documents USING (doc_id), models""".replace(
                "lower(text)", "lower(documents.text)"), o.QUESTIONS, o.model_list(ANSWER_MODELS), replies),
        "rule_answers": o.with_(
            f"SELECT {K}, question_key, model, {rule} AS answer FROM ({docs}), questions, models",
            o.QUESTIONS, o.model_list(ANSWER_MODELS)),
        "incremental_skip": o.with_(f"SELECT {K} FROM u WHERE NOT starts_with(source_file, 'src1')", o.UNITS),
        "dedup_results": o.with_(
            f"""SELECT {K}, CASE WHEN phrase_index % 3 = 0 THEN 'cached' ELSE categorie END AS categorie,
            CASE WHEN phrase_index % 3 = 0 THEN 'a/old.json' ELSE 'b/new.json' END AS source_path FROM lab""", *o.VOTE_CTES),
        "language_route": o.with_(
            "SELECT doc_id, lang_detected, CASE WHEN lang_detected IN ('fr', 'en') THEN lang_detected ELSE 'fr' END AS lang_routed FROM ld",
            lang_ctes),
        "language_accuracy": o.with_(
            """SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = lang_detected THEN 1 ELSE 0 END) AS BIGINT) AS n_right
            FROM ld GROUP BY lang""", lang_ctes),
    }


PATHS = ["//Document/H1", "//Document/P", "//Document/Table", "//Document/Table/TR", "//Document/Table/TR/TD",
         "//Document/Table[2]/TR/TD/P", "//Document/P[2]"]


def structure_sql(o) -> dict[str, str]:
    elements = f"""
el AS (
  SELECT conv_id AS doc, CAST(turn AS INTEGER) AS el_no, {case('(turn + conv_id) % 7', [quote(p) for p in PATHS])} AS path,
    text,
    CASE WHEN turn > 0 THEN CAST(turn // 4 + 1 AS INTEGER) ELSE 1 END AS page,
    CASE (turn + conv_id) % 7 WHEN 0 THEN 20 WHEN 6 THEN 15 WHEN 1 THEN 12 ELSE 10 END AS size
  FROM conversations
),
es AS (
  SELECT *, contains(path, 'Table') AS tab, page <> lag(page, 1, 1) OVER w AS brk,
    lag(contains(path, 'Table'), 1, false) OVER w AND page = lag(page, 1, 1) OVER w AS inside,
    sum(CASE WHEN contains(path, 'Table') AND NOT contains(path, 'TD') THEN 1 ELSE 0 END) OVER w AS nth
  FROM el WINDOW w AS (PARTITION BY doc ORDER BY el_no)
)"""
    brk = "CASE WHEN brk THEN chr(10) || '---' || chr(10) || '## Page ' || page || chr(10) END"
    t = X.strip("text")
    heading = lambda m: f"chr(10) || '{m} ' || {t} || chr(10)"
    md_line = f"""concat_ws(chr(10), {brk},
      CASE WHEN tab AND NOT inside THEN chr(10) || '### Tableau' || chr(10) END,
      CASE WHEN tab AND contains(path, 'TD') THEN '| ' || text || ' |' WHEN tab AND contains(path, 'TR') THEN chr(10) END,
      CASE WHEN NOT tab AND inside THEN chr(10) END,
      CASE WHEN NOT tab AND {t} <> '' THEN CASE WHEN size >= 18 THEN {heading('##')} WHEN size >= 14 THEN {heading('###')} ELSE {t} || ' ' END END)"""
    has_line = f"(brk OR (tab AND (NOT inside OR contains(path, 'TD') OR contains(path, 'TR'))) OR (NOT tab AND (inside OR {t} <> '')))"
    tables = """
tb AS (
  SELECT conv_id AS doc, CAST(turn + 1 AS INTEGER) AS table_no, '| ' || text || ' |' || chr(10) || '|---|' AS markdown
  FROM conversations
)"""
    rebuilt = f"""concat_ws(chr(10), {brk},
      CASE WHEN tab AND NOT contains(path, 'TD') AND markdown IS NOT NULL
        THEN chr(10) || '### Tableau ' || nth || chr(10) || chr(10) || markdown || chr(10) END,
      CASE WHEN NOT tab AND {t} <> '' THEN {t} || ' ' END)"""
    rebuilt_has = f"(brk OR (tab AND NOT contains(path, 'TD') AND markdown IS NOT NULL) OR (NOT tab AND {t} <> ''))"
    cells = """
cl AS (
  SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS row,
    CAST(event_id AS VARCHAR) AS c1, event_type AS c2, CASE WHEN event_id % 5 <> 0 THEN props END AS c3
  FROM events
)"""
    headings = """
hd AS (
  SELECT conv_id AS doc, turn, (turn + conv_id) % 3 = 0 AS is_h,
    CASE WHEN (turn + conv_id) % 3 = 0 THEN '### Tableau' || chr(10) || chr(10) || text
      ELSE 'mot Tableau ' || text END AS txt, text AS body
  FROM conversations
),
hn AS (
  SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY turn) AS nth,
    sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS n_h, true AS has_tables
  FROM hd
),
hp AS (
  SELECT hn.doc, turn, n_h, has_tables,
    CASE WHEN is_h AND has_tables THEN '### Tableau' || chr(10) || chr(10) || chr(10) || coalesce(markdown, '*Tableau non disponible*')
      || chr(10) || chr(10) || body ELSE txt END AS piece
  FROM hn LEFT JOIN tb ON tb.doc = hn.doc AND tb.table_no = hn.nth
),
ex AS (
  SELECT tb.doc, string_agg(chr(10) || '### Tableau ' || table_no || chr(10) || chr(10) || markdown || chr(10), chr(10) ORDER BY table_no) AS extra
  FROM tb JOIN (SELECT DISTINCT doc, n_h FROM hn) h ON h.doc = tb.doc WHERE table_no > n_h GROUP BY tb.doc
)"""
    items = """
it AS (
  SELECT doc, n, p, 'x' || n AS f FROM (SELECT l_orderkey AS doc, l_partkey AS p,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)
)"""
    md = (X.LINES,)
    runs = f"""
tl AS (SELECT {X.KEYS}, line_no, {X.strip('line')} AS s, starts_with({X.strip('line')}, '|') AS t FROM md_lines),
tg AS (SELECT *, sum(CASE WHEN t THEN 0 ELSE 1 END) OVER (PARTITION BY {X.KEYS} ORDER BY line_no) AS g FROM tl),
tt AS (
  SELECT {X.KEYS}, CAST(row_number() OVER (PARTITION BY {X.KEYS} ORDER BY min(line_no)) - 1 AS INTEGER) AS table_no,
    string_agg(s, chr(10) ORDER BY line_no) AS "table"
  FROM tg WHERE t GROUP BY source_folder, source_file, g
)"""
    tail = "SELECT doc, string_agg(line, chr(10) ORDER BY el_no) FILTER (WHERE has) AS markdown"
    return {
        "page_concat": """SELECT doc, text, n_pages, CAST(length(text) AS INTEGER) AS n_chars FROM (
            SELECT conv_id AS doc, string_agg(text, chr(10)||chr(10)||'--- PAGE SUIVANTE ---'||chr(10)||chr(10) ORDER BY turn) AS text,
            count(*) AS n_pages FROM conversations GROUP BY conv_id)""",
        "page_concat_titled": """SELECT doc, text, n_pages, CAST(length(text) AS INTEGER) AS n_chars FROM (
            SELECT conv_id AS doc, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || text, chr(10)||chr(10) ORDER BY turn) AS text,
            count(*) AS n_pages FROM conversations GROUP BY conv_id)""",
        "page_boxes": f"""SELECT doc, page, coalesce(string_agg(t, chr(10) ORDER BY turn), '') AS texte, CAST(count(t) AS INTEGER) AS nb_blocs,
            CAST(coalesce(sum(length(t)), 0) AS INTEGER) AS nb_chars, coalesce(string_agg(b, ';' ORDER BY turn), '') AS bboxes FROM (
              SELECT conv_id AS doc, CAST(turn // 3 + 1 AS INTEGER) AS page, turn, {X.strip('text')} AS t,
              concat_ws(',', CAST(((turn * 250 + 10) // 20)::DOUBLE / 100 AS VARCHAR), CAST(turn::DOUBLE AS VARCHAR),
                CAST((turn * 2)::DOUBLE AS VARCHAR), CAST(turn + 0.5::DOUBLE AS VARCHAR)) AS b FROM conversations)
            GROUP BY doc, page""",
        "structure_markdown": o.with_(f"{tail} FROM (SELECT doc, el_no, {md_line} AS line, {has_line} AS has FROM es) GROUP BY doc", elements),
        "element_stats": o.with_(
            """SELECT doc, nb_elements, nb_tableaux, texte_complet, CAST(length(texte_complet) AS INTEGER) AS nb_chars FROM (
              SELECT doc, count(*) AS nb_elements, CAST(sum(CASE WHEN contains(path, 'Table') THEN 1 ELSE 0 END) AS BIGINT) AS nb_tableaux,
              coalesce(string_agg(text, chr(10) ORDER BY el_no) FILTER (WHERE text <> ''), '') AS texte_complet FROM el GROUP BY doc)""",
            elements),
        "rebuild_with_tables": o.with_(
            f"""SELECT doc, coalesce(string_agg(line, chr(10) ORDER BY el_no) FILTER (WHERE has), '') AS markdown FROM (
              SELECT es.doc, el_no, {rebuilt} AS line, {rebuilt_has} AS has FROM es LEFT JOIN tb ON tb.doc = es.doc AND tb.table_no = es.nth
              AND es.tab AND NOT contains(es.path, 'TD')) GROUP BY doc""", elements, tables),
        "splice_tables": o.with_(
            """SELECT doc, body || CASE WHEN extra IS NULL THEN '' ELSE chr(10)||chr(10)||'## Tableaux supplémentaires'||chr(10)||chr(10) || extra END AS text
            FROM (SELECT doc, string_agg(piece, chr(10) ORDER BY turn) AS body FROM hp GROUP BY doc) LEFT JOIN ex USING (doc)""",
            tables, headings),
        "table_markdown": o.with_(
            """SELECT doc, 1 AS table_no, '| id | type | props |' || chr(10) || '|---|---|---|' || chr(10) ||
            string_agg('| ' || c1 || ' | ' || c2 || ' | ' || coalesce(c3, 'nan') || ' |', chr(10) ORDER BY row) AS markdown
            FROM cl GROUP BY doc""", cells),
        "table_preview": o.with_(
            """SELECT doc, 1 AS table_no, CAST(max(row) AS INTEGER) AS n_rows, 3 AS n_cols, 'id,type,props' AS colonnes,
            string_agg(c1 || ',' || c2 || ',' || coalesce(c3, ''), ',' ORDER BY row) AS apercu
            FROM cl GROUP BY doc""", cells),
        "markdown_tables": o.with_("SELECT * FROM tt", *md, runs),
        "table_cells": o.with_(
            f"""SELECT {X.KEYS}, table_no, CAST(row AS INTEGER) AS row, CAST(c AS INTEGER) AS col, coalesce(vals[c + 1], '') AS value FROM (
              SELECT *, unnest(range(0, max(len(vals)) OVER (PARTITION BY {X.KEYS}, table_no))) AS c FROM (
                SELECT {X.KEYS}, table_no, row_number() OVER (PARTITION BY {X.KEYS}, table_no ORDER BY i) - 1 AS row,
                  count(*) OVER (PARTITION BY {X.KEYS}, table_no) AS n,
                  list_transform(string_split(trim({X.strip('l')}, '|'), '|'), lambda x: {X.strip('x')}) AS vals
                FROM (SELECT {X.KEYS}, table_no, unnest(string_split("table", chr(10))) AS l,
                        generate_subscripts(string_split("table", chr(10)), 1) AS i FROM tt)
                WHERE regexp_replace(l, '[|\\- ]', '', 'g') <> ''
              ) WHERE n >= 2)""", *md, runs),
        "block_text": o.with_("SELECT doc, string_agg(p || ' ' || f, chr(10) ORDER BY n) AS text FROM it GROUP BY doc", items),
        "block_grid": o.with_(
            """SELECT g.doc, 't' AS table_id, CAST(g.r AS INTEGER) AS row, CAST(g.c AS INTEGER) AS col, coalesce(it.p || ' ' || it.f, '') AS value
            FROM (SELECT doc, r, unnest(range(1, mc + 1)) AS c FROM (
                SELECT doc, mc, unnest(range(1, mr + 1)) AS r FROM (SELECT doc, max(n) AS mr, max(1 + p % 3) AS mc FROM it GROUP BY doc))) g
            LEFT JOIN it ON it.doc = g.doc AND it.n = g.r AND 1 + it.p % 3 = g.c""", items),
        "extraction_leaderboard": _leaderboard("outil"),
        "extraction_by_mode": _leaderboard("outil, mode"),
        "path_dedup": "SELECT url AS path, max(page_id) AS seen_no FROM pages GROUP BY 1",
    }


def _leaderboard(by: str) -> str:
    return f"""SELECT {by}, count(*) AS fichiers, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS succes,
        CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS echecs,
        CAST(sum(CASE WHEN bad THEN 0 ELSE n_chars // 1800 + 1 END) AS BIGINT) AS nb_pages,
        CAST(sum(CASE WHEN bad THEN 0 ELSE n_chars END) AS BIGINT) AS nb_chars,
        CAST(sum(CASE WHEN bad THEN 0 ELSE doc_id % 5 END) AS BIGINT) AS nb_tableaux,
        CAST(sum(doc_id % 97) AS DOUBLE) / 10 AS temps_total_s FROM (
          SELECT *, doc_id % 13 = 0 AS bad, ['pypdf', 'marker', 'docling', 'tabula'][doc_id % 4 + 1] AS outil,
            CASE WHEN doc_id % 8 < 4 THEN 'lattice' ELSE 'stream' END AS mode FROM documents) GROUP BY {by}"""


def flagship_sql(o) -> dict[str, str]:
    text = (X.LINES, X.CLEAN, X.tokens("clean_doc_lines"), X.SENTENCES, X.PHRASES)
    fp = X.fingerprint("phrase")
    units = f"pu AS (SELECT {K}, {fp} AS seed FROM phrases)"
    ctes = (*text, units, o.QUESTIONS, o.model_list(ANSWER_MODELS), o.PRICES, o.answers("pu"), o.votes_cte(), o.COSTS)
    summary = o.report_sql()["file_summary"]
    body = summary[summary.rindex("SELECT source_folder, source_file, count(*)"):]
    agr = summary[summary.rindex("agr AS ("):summary.rindex("SELECT source_folder, source_file, count(*)")]
    by_folder = body.replace("SELECT source_folder, source_file,", "SELECT source_folder,").replace(
        "GROUP BY source_folder, source_file", "GROUP BY source_folder")
    return {
        "labelled_phrases": X.statement(
            f"""SELECT {K}, scores_roi, scores_notoriete, scores_obligation, categorie, cost_eur_phrase
            FROM lab JOIN money USING ({K})""", *ctes),
        "labelled_files": X.statement(by_folder, *ctes, agr),
    }
