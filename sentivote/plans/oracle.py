"""SQL twins of the registered queries, for an independent engine."""

from __future__ import annotations

import re
import sys

from sentivote import vocab
from sentivote.plans import fixtures, oracle_calls
from sentivote.plans import oracle_text as X
from sentivote.plans.fixtures import ANSWER_MODELS, ENSEMBLE_MODELS

Q = vocab.QUESTION_KEYS
CATS = vocab.CATEGORIES
K = "source_folder, source_file, phrase_index"
S = "source_folder, source_file, paragraph_index"


def d(h: str, at: int, n: int = 1) -> str:
    """Value of n hexadecimal digits starting at ``at``."""
    value = f"(strpos('0123456789abcdef', substr({h}, {at}, 1)) - 1)"
    for i in range(1, n):
        value = f"({value} * 16 + strpos('0123456789abcdef', substr({h}, {at + i}, 1)) - 1)"
    return value


def values(name: str, columns: str, rows: list[tuple]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


QUESTIONS = values("questions", "ord, question_key, category", [(i, q.key, q.category) for i, q in enumerate(vocab.QUESTIONS)])
PRICES = values(
    "prices", "model_no, model, pin, pout",
    [(i, m.name, float(m.usd_in_per_m), float(m.usd_out_per_m)) for i, m in enumerate(vocab.MODELS)],
)


def model_list(models: list[str]) -> str:
    return values("models", "model_idx, model", list(enumerate(models)))


UNITS = """
u AS (
  SELECT lang AS source_folder, source AS source_file, CAST(doc_id AS INTEGER) AS phrase_index,
         CAST(doc_id AS VARCHAR) AS seed FROM documents
)"""


def answers(units: str = "u", keys: str = K) -> str:
    """CTE ``calls``: recorded answers from the digits of md5(seed|model|question)."""
    return f"""
hashed AS (
  SELECT {keys}, model, model_idx, question_key, ord, category, md5(seed || '|' || model || '|' || question_key) AS h
  FROM {units}, models, questions
),
calls AS (
  SELECT {keys}, model, model_idx, question_key, ord, category, {d('h', 2, 2)} < 6 AS failed,
    CASE WHEN {d('h', 2, 2)} < 6 THEN 'non' WHEN {d('h', 1)} < 7 THEN 'oui' ELSE 'non' END AS answer,
    CASE WHEN {d('h', 2, 2)} < 6 THEN 0 ELSE 50 + {d('h', 4, 2)} END AS tok_in,
    CASE WHEN {d('h', 2, 2)} < 6 THEN 0 ELSE 4 + {d('h', 6)} END AS tok_out,
    {d('h', 7, 2)} AS centis
  FROM hashed
)"""


def votes_cte(keys: str = K) -> str:
    """CTEs ``vq`` (per unit and question) and ``lab`` (per unit)."""
    return f"""
vq AS (
  SELECT {keys}, question_key, ord, category,
    CAST(sum(CASE WHEN NOT failed THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
    CAST(sum(CASE WHEN NOT failed AND answer = 'oui' THEN 1 ELSE 0 END) AS BIGINT) AS n_oui
  FROM calls GROUP BY {keys}, question_key, ord, category
),
va AS (
  SELECT *, CASE WHEN 2 * n_oui > n_valid THEN 'oui' ELSE 'non' END AS answer,
    CASE WHEN n_valid < 2 THEN 0.5::DOUBLE ELSE greatest(n_oui, n_valid - n_oui)::DOUBLE / n_valid END AS agreement
  FROM vq
),
sc AS (
  SELECT {keys},
    CAST(sum(CASE WHEN category = 'ROI' AND answer = 'oui' THEN 1 ELSE 0 END) AS INTEGER) AS scores_roi,
    CAST(sum(CASE WHEN category = 'Notoriete' AND answer = 'oui' THEN 1 ELSE 0 END) AS INTEGER) AS scores_notoriete,
    CAST(sum(CASE WHEN category = 'Obligation' AND answer = 'oui' THEN 1 ELSE 0 END) AS INTEGER) AS scores_obligation
  FROM va GROUP BY {keys}
),
lab AS (
  SELECT *, {label_sql('scores_roi', 'scores_notoriete', 'scores_obligation')} AS categorie FROM sc
)"""


def label_sql(roi: str, noto: str, obl: str) -> str:
    return (
        f"CASE WHEN {roi} + {noto} + {obl} = 0 THEN 'Description' WHEN {roi} >= {noto} AND {roi} >= {obl} THEN 'ROI' "
        f"WHEN {obl} >= {noto} THEN 'Obligation' ELSE 'Notoriete' END"
    )


UNITS_SUM = "CAST(sum(tok_in * CAST(round(pin * 100) AS BIGINT) + tok_out * CAST(round(pout * 100) AS BIGINT)) AS HUGEINT)"


def usd(cents: str, digits: int) -> str:
    """Hundredths of a millionth dollar to dollars, half up."""
    m = 10 ** (digits - 6)
    return f"((2 * {cents} * {m} + 100) // 200)::DOUBLE / 1e{digits}"


def eur(cents: str, digits: int, n: str = "1") -> str:
    m = 10 ** (digits - 6)
    return f"((2 * {cents} * {m} * 100 + 10800 * {n}) // (21600 * {n}))::DOUBLE / 1e{digits}"


COSTS = f"""
money AS (
  SELECT {K}, {usd(UNITS_SUM, 7)} AS cost_usd_phrase, {eur(UNITS_SUM, 7)} AS cost_eur_phrase,
    {UNITS_SUM} AS units, CAST(sum(centis) AS DOUBLE) / 100 AS duration_s_phrase
  FROM calls JOIN prices USING (model) GROUP BY {K}
)"""


def pct(part: str, whole: str, digits: int, default: str = "0.0") -> str:
    exact = f"((200 * {10**digits} * CAST({part} AS HUGEINT) + {whole}) // (2 * {whole}))::DOUBLE / 1e{digits}"
    return f"CASE WHEN {whole} = 0 THEN {default} ELSE {exact} END"


def pivot(fmt: str, agg: str = "max") -> str:
    return ", ".join(f"{agg}(CASE WHEN question_key = '{q}' THEN {fmt.split('|')[0]} END) AS {fmt.split('|')[1].format(q=q)}" for q in Q)


def with_(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


VOTE_CTES = (QUESTIONS, model_list(ANSWER_MODELS), PRICES, UNITS, answers(), votes_cte(), COSTS)


_PERCENT = re.compile(r"round\(100\.0::DOUBLE \* (.+?)\s/ (.+?), (\d)\)", re.DOTALL)


def exact_percentages(statement: str) -> str:
    """Expand ``round(100.0::DOUBLE * a / b, n)`` to integer arithmetic."""
    return _PERCENT.sub(lambda m: pct(m[1], m[2], int(m[3])), statement)


def sql() -> dict[str, str]:
    here = sys.modules[__name__]
    parts = [
        text_sql(), vote_sql(), report_sql(), sensitivity_sql(), ensemble_sql(), judge_sql(),
        oracle_calls.call_sql(here), oracle_calls.structure_sql(here), oracle_calls.flagship_sql(here),
    ]
    twins = {name: exact_percentages(s) for part in parts for name, s in part.items()}
    # what is stored, published, streamed or counted in the row answers as what it was made from
    made_from = {"stored_votes": "majority_vote", "stored_costs": "phrase_costs", "stored_wide": "wide_phrases", "published_summary": "file_summary",
                 "change_rates_in_row": "change_rates", "stability_in_row": "stability", "streamed_votes": "majority_vote"}
    return twins | {name: twins[source] for name, source in made_from.items()}


# --- text -----------------------------------------------------------------------


def unit_contexts() -> tuple[str, tuple[str, ...]]:
    """A relation of units with their paragraph's text, and the CTEs that it needs."""
    clean = (X.LINES, X.CLEAN, X.tokens("clean_doc_lines"), X.SENTENCES, X.PHRASES, X.PARAGRAPHS)
    return f"""(
      SELECT {X.KEYS}, paragraph_index, section_title, string_agg(phrase, ' ' ORDER BY phrase_index) AS full_paragraph,
        list(phrase_index ORDER BY phrase_index) AS li, list(phrase ORDER BY phrase_index) AS lp
      FROM para_phrases WHERE phrase IS NOT NULL GROUP BY {X.KEYS}, paragraph_index, section_title
    ) g, LATERAL (
      SELECT unnest(li) AS phrase_index, unnest(lp) AS phrase
      UNION ALL SELECT -1, section_title WHERE section_title <> ''
    )""", clean


def text_sql() -> dict[str, str]:
    contexts, _ = unit_contexts()
    raw = (X.LINES, X.tokens("md_lines"))
    clean = (X.LINES, X.CLEAN, X.tokens("clean_doc_lines"), X.SENTENCES, X.PHRASES)
    nl = "length(text) - length(replace(text, chr(10), ''))"
    short = "text"
    for word, abbreviation in fixtures.ABBREVIATIONS.items():
        short = f"replace({short}, '{word}', '{abbreviation}')"
    blocks = (X.LINES.replace("string_split(text,", f"string_split({short},"), X.CLEAN, X.tokens("clean_doc_lines"), X.boundary_words())
    return {
        "boundary_words": X.statement("SELECT kind, word, n, round(score, 4) AS score FROM learnt", *blocks),
        "phrases_learned": X.statement("SELECT * FROM phrases", *blocks, X.learned_pieces(), X.MERGED, X.PHRASES),
        "clean_lines": X.statement(
            f"SELECT {X.KEYS}, CAST(row_number() OVER (PARTITION BY {X.KEYS} ORDER BY line_no) - 1 AS INTEGER) AS line_no, line FROM cleaned",
            X.LINES, X.CLEAN),
        "clean_documents": X.statement(
            f"""SELECT c.source_folder, c.source_file, c.text, CAST(d.nb AS INTEGER) AS n_before,
            false AS bad, CAST({nl.replace('text', 'c.text')} AS INTEGER) AS n_after
            FROM clean_docs c JOIN (SELECT source_file, count(*) - 1 AS nb FROM md_lines GROUP BY source_file) d USING (source_file)""",
            X.LINES, X.CLEAN),
        "clean_report": X.statement(
            f"""SELECT CAST(count(*) AS BIGINT) AS files_ok, CAST(0 AS BIGINT) AS files_failed,
            CAST(sum(d.nb) AS BIGINT) AS lines_before,
            CAST(sum({nl.replace('text', 'c.text')}) AS BIGINT) AS lines_after
            FROM clean_docs c JOIN (SELECT source_file, count(*) - 1 AS nb FROM md_lines GROUP BY source_file) d USING (source_file)""",
            X.LINES, X.CLEAN),
        "tokens": X.statement("SELECT * REPLACE (coalesce(level, 0) AS level) FROM tok", *raw),
        "sentences_merged": X.statement(
            f"SELECT {X.KEYS}, tok_pos, CAST(sent_pos AS INTEGER) AS sent_pos, text AS sentence FROM sent",
            X.LINES, X.tokens("md_lines"), X.SENTENCES),
        "blocked_documents": X.statement("SELECT * FROM clean_docs WHERE text <> ''", X.LINES, X.CLEAN),
        "blocked_phrases": X.statement("SELECT * FROM phrases", *clean),
        "phrases_flat": X.statement("SELECT * FROM phrases", *clean),
        "phrases_by_model": X.statement("SELECT * FROM phrases", *clean),
        "paragraphs": X.statement("SELECT * REPLACE (coalesce(phrase_index, -1) AS phrase_index) FROM para_phrases", *clean, X.PARAGRAPHS),
        "phrase_counts": X.statement(
            f"""SELECT d.source AS source_folder, 'doc_' || d.doc_id || '.md' AS source_file,
            CAST(coalesce(n, 0) AS INTEGER) AS n_phrases FROM documents d
            LEFT JOIN (SELECT {X.KEYS}, count(*) AS n FROM phrases GROUP BY ALL) p
            ON p.source_file = 'doc_' || d.doc_id || '.md'""",
            *clean),
        "scored_units": X.statement(f"SELECT {X.KEYS}, paragraph_index, section_title, phrase_index, phrase FROM {contexts}", *clean, X.PARAGRAPHS),
        "paragraph_contexts": X.statement(
            f"SELECT {X.KEYS}, paragraph_index, section_title, full_paragraph, CAST(count(*) AS INTEGER) AS n_units FROM {contexts} GROUP BY ALL",
            *clean, X.PARAGRAPHS),
        "segmentation_report": X.statement(
            f"""SELECT source_folder, source_file, grouping(source_file) = 1 AS is_total, count(*) AS n_phrases
            FROM phrases GROUP BY GROUPING SETS ((source_folder, source_file), ())""",
            *clean),
        "simple_segments": X.statement(
            f"""SELECT {X.KEYS}, CAST(row_number() OVER (PARTITION BY {X.KEYS} ORDER BY line_no) - 1 AS INTEGER) AS paragraph_index,
            section_title, paragraph FROM sg WHERE length(paragraph) >= 30""",
            X.LINES, X.SIMPLE),
        "html_strip": f"SELECT page_id, {X.strip(X.chain('html', X.MARKUP))} AS text FROM pages",
    }


# --- votes ----------------------------------------------------------------------


def vote_sql() -> dict[str, str]:
    return {
        "majority_vote": with_(f"SELECT {K}, question_key, n_valid, n_oui, answer, agreement FROM va", *VOTE_CTES),
        "scores_labels": with_(f"SELECT {K}, scores_roi, scores_notoriete, scores_obligation, categorie FROM lab", *VOTE_CTES),
        "unanimity": with_(
            """SELECT question_key, CAST(sum(CASE WHEN n_valid >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_comparaisons,
            CAST(sum(CASE WHEN n_valid >= 2 AND (n_oui = 0 OR n_oui = n_valid) THEN 1 ELSE 0 END) AS BIGINT) AS n_unanimes,
            sum(CASE WHEN n_valid >= 2 AND (n_oui = 0 OR n_oui = n_valid) THEN 1 ELSE 0 END)::DOUBLE
              / sum(CASE WHEN n_valid >= 2 THEN 1 ELSE 0 END) AS taux
            FROM va GROUP BY question_key""",
            *VOTE_CTES),
        "answer_maps": with_(
            f"""SELECT {K}, categorie, string_agg(question_key || '=' || answer, ',' ORDER BY ord) AS answers,
            sum(agreement ORDER BY ord) AS agreement_sum FROM va JOIN lab USING ({K}) GROUP BY {K}, categorie""",
            *VOTE_CTES),
        "phrase_costs": with_(
            f"SELECT {K}, cost_usd_phrase, cost_eur_phrase, duration_s_phrase FROM money", *VOTE_CTES),
        "call_details": with_(
            f"""SELECT {K}, CAST(count(*) AS INTEGER) AS n_details,
            string_agg(split_part(model, '/', 2) || ':' || question_key || ':' || answer ||
              CASE WHEN failed THEN '!' ELSE '' END, ',' ORDER BY model, question_key) AS details
            FROM calls GROUP BY {K}""",
            *VOTE_CTES),
        "tensor_coo": with_(
            f"""SELECT CAST(client_pos AS BIGINT) AS client_pos, CAST(phrase_pos AS BIGINT) AS phrase_pos,
              CAST(model_idx AS INTEGER) AS model_pos, CAST(ord AS INTEGER) AS question_pos, CAST(1 AS TINYINT) AS value
            FROM calls JOIN (
              SELECT {K}, row_number() OVER (PARTITION BY source_folder ORDER BY source_file, phrase_index) - 1 AS phrase_pos,
                dense_rank() OVER (ORDER BY source_folder) - 1 AS client_pos FROM u
            ) USING ({K}) WHERE NOT failed AND answer = 'oui'""",
            *VOTE_CTES),
        "tensor_phrases": """SELECT lang AS source_folder, source AS source_file, CAST(doc_id AS INTEGER) AS phrase_index, text AS phrase,
            row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1 AS phrase_pos,
            dense_rank() OVER (ORDER BY lang) - 1 AS client_pos FROM documents""",
        "tensor_clients": """SELECT lang AS source_folder, row_number() OVER (ORDER BY lang) - 1 AS client_pos
            FROM (SELECT DISTINCT lang FROM documents)""",
        "tensor_shape": with_(
            """SELECT count(*) AS n_clients, max(n) AS max_phrases_per_client, 5 AS n_models, 9 AS n_questions
            FROM (SELECT source_folder, count(*) AS n FROM u GROUP BY 1)""", UNITS),
    }


# --- reports ---------------------------------------------------------------------


def _score_strings() -> str:
    return (
        "CAST(scores_roi AS VARCHAR) || '/3' AS \"ROI_Score\", CAST(scores_notoriete AS VARCHAR) || '/3' AS \"Notoriete_Score\", "
        "CAST(scores_obligation AS VARCHAR) || '/3' AS \"Obligation_Score\""
    )


def report_sql() -> dict[str, str]:
    short = lambda m: m.split("/")[-1]
    agg = ", ".join(f"max(CASE WHEN question_key = '{q}' THEN answer END) AS \"AGG_{q}\"" for q in Q)
    accord = lambda name: ", ".join(
        f"max(CASE WHEN question_key = '{q}' THEN CASE WHEN n_valid < 2 THEN 50.0 ELSE round(100.0::DOUBLE * greatest(n_oui, n_valid - n_oui) / n_valid, 1) END END) AS \"{name}_{q}\"" for q in Q)
    cells = ", ".join(
        f"max(CASE WHEN model = '{m}' AND question_key = '{q}' THEN CASE WHEN failed THEN 'ERR' ELSE answer END END) AS \"{short(m)}__{q}\""
        for m in ANSWER_MODELS for q in Q)
    compact = ", ".join(
        "'R:' || " + " || ' N:' || ".join([_bits(m, "ROI"), _bits(m, "Notoriete")]) + " || ' O:' || " + _bits(m, "Obligation")
        + f" AS \"resp_{short(m)}\", coalesce({eur(UNITS_SUM.replace('sum(', "sum(CASE WHEN model = '" + m + "' THEN ", 1).replace('BIGINT)) AS', 'BIGINT) END) AS'), 7)}, 0.0) AS \"cost_eur_{short(m)}\""
        for m in ANSWER_MODELS)
    means = []
    for c, p in (("ROI", "roi"), ("Notoriete", "notoriete"), ("Obligation", "obl")):
        means.append(f"sum(CAST(a_{p}_1 AS DECIMAL(18,1)))::DOUBLE / count(*) AS \"accord_q1_{c}\"")
        means.append(
            f"sum(CAST(a_{p}_1 AS DECIMAL(18,1)) + CAST(a_{p}_2 AS DECIMAL(18,1)) + CAST(a_{p}_3 AS DECIMAL(18,1)))::DOUBLE / count(*) / 3 AS \"accord_moyen_{c}\"")
    file_summary = f"""SELECT source_folder, source_file, count(*) AS total_phrases,
      {", ".join(f"CAST(sum(CASE WHEN categorie = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in CATS)},
      sum(CAST(cost_eur_phrase AS DECIMAL(18,7)))::DOUBLE AS cout_total_eur,
      sum(CAST(cost_eur_phrase AS DECIMAL(18,7)))::DOUBLE / count(*) AS cout_moyen_eur,
      sum(CAST(duration_s_phrase AS DECIMAL(18,2)))::DOUBLE AS duree_totale_s,
      sum(CAST(duration_s_phrase AS DECIMAL(18,2)))::DOUBLE / count(*) AS duree_moyenne_s,
      {", ".join(means)}
      FROM lab JOIN money USING ({K}) JOIN agr USING ({K}) GROUP BY source_folder, source_file"""
    agr = "agr AS (SELECT " + K + ", " + ", ".join(
        f"max(CASE WHEN question_key = '{q}' THEN CASE WHEN n_valid < 2 THEN 50.0 ELSE round(100.0::DOUBLE * greatest(n_oui, n_valid - n_oui) / n_valid, 1) END END) AS a_{q}" for q in Q) + f" FROM va GROUP BY {K})"
    totals = ", ".join(f"CAST(sum(CASE WHEN categorie = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"total_{c}\"" for c in CATS)
    contexts, clean = unit_contexts()
    key = f"{X.KEYS}, paragraph_index, phrase_index"
    said = ", ".join(f"max(CASE WHEN question_key = '{q}' THEN answer END) AS \"Q_{q}\"" for q in Q)
    errors = ", ".join(
        f"coalesce(max(CASE WHEN model = '{m}' AND failed THEN 'timeout' END), '') AS \"err_{short(m)}\"" for m in ANSWER_MODELS)
    wide_units = X.statement(
        f"""SELECT w.*, m.* EXCLUDE ({key}), lab.categorie, {_score_strings()}, cost_usd_phrase, cost_eur_phrase, v.* EXCLUDE ({key}),
          section_title, phrase
        FROM (SELECT {key}, phrase_index = -1 AS is_title FROM u) w
        JOIN u USING ({key}) JOIN lab USING ({key}) JOIN money USING ({key})
        JOIN (SELECT {key}, {compact}, {errors} FROM calls JOIN prices USING (model) GROUP BY {key}) m USING ({key})
        JOIN (SELECT {key}, {said} FROM va GROUP BY {key}) v USING ({key})""",
        *clean, f"""
u AS (SELECT {key}, section_title, phrase, concat_ws('/', source_file, paragraph_index, phrase_index) AS seed FROM {contexts})""",
        QUESTIONS, model_list(ANSWER_MODELS), PRICES, answers("u", key), votes_cte(key), COSTS.replace(K, key))
    return {
        "wide_units": wide_units,
        "phrase_rows": with_(
            f"""SELECT {K}, categorie, {_score_strings()}, cost_eur_phrase, duration_s_phrase,
            {", ".join(f'"ACCORD_{q}"' for q in Q)}, {", ".join(f'"AGG_{q}"' for q in Q)}
            FROM lab JOIN money USING ({K}) JOIN (SELECT {K}, {agg}, {accord('ACCORD')} FROM va GROUP BY {K}) USING ({K})""",
            *VOTE_CTES),
        "wide_phrases": with_(
            f"""SELECT * FROM (SELECT {K}, categorie, {_score_strings()}, cost_eur_phrase, duration_s_phrase,
            {", ".join(f'"ACCORD_{q}"' for q in Q)}, {", ".join(f'"AGG_{q}"' for q in Q)}
            FROM lab JOIN money USING ({K}) JOIN (SELECT {K}, {agg}, {accord('ACCORD')} FROM va GROUP BY {K}) USING ({K}))
            JOIN (SELECT {K}, {cells} FROM calls GROUP BY {K}) USING ({K})""",
            *VOTE_CTES),
        "compact_answers": with_(
            f"SELECT {K}, {compact} FROM calls JOIN prices USING (model) GROUP BY {K}", *VOTE_CTES),
        "file_summary": with_(file_summary, *VOTE_CTES, agr),
        "model_stats": with_(
            f"""SELECT model, CAST(sum(tok_in) AS BIGINT) AS tokens_in, CAST(sum(tok_out) AS BIGINT) AS tokens_out,
            {usd(UNITS_SUM, 6)} AS cout_usd, {eur(UNITS_SUM, 6)} AS cout_eur,
            count(*) AS nb_appels, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS nb_erreurs,
            round(100.0::DOUBLE * sum(CASE WHEN failed THEN 1 ELSE 0 END) / count(*), 2) AS taux_erreur
            FROM calls JOIN prices USING (model) GROUP BY model""",
            *VOTE_CTES),
        "file_costs": with_(
            f"""SELECT source_folder, source_file, {usd(UNITS_SUM, 6)} AS cout_usd,
            {eur(UNITS_SUM, 6)} AS cout_eur
            FROM calls JOIN prices USING (model) GROUP BY source_folder, source_file""",
            *VOTE_CTES),
        "question_agreement": with_(
            """SELECT question_key, category AS categorie, texte,
            round(100.0::DOUBLE * sum(CASE WHEN n_valid >= 2 AND (n_oui = 0 OR n_oui = n_valid) THEN 1 ELSE 0 END)
              / sum(CASE WHEN n_valid >= 2 THEN 1 ELSE 0 END), 2) AS taux_accord,
            CAST(sum(CASE WHEN n_valid >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS nb_comparaisons
            FROM va JOIN qtext USING (question_key) GROUP BY question_key, category, texte""",
            *VOTE_CTES, values("qtext", "question_key, texte", [(q.key, q.text) for q in vocab.QUESTIONS])),
        "category_distribution": with_(
            f"""SELECT c.categorie, count(l.categorie) AS nombre,
            round(100.0::DOUBLE * count(l.categorie) / (SELECT count(*) FROM lab), 1) AS pourcentage
            FROM cats c LEFT JOIN lab l USING (categorie) GROUP BY c.categorie""",
            *VOTE_CTES, values("cats", "categorie", [(c,) for c in CATS])),
        "global_stats": with_(
            f"""SELECT total_phrases, {usd('CAST(units AS HUGEINT)', 6)} AS cout_total_usd, {eur('CAST(units AS HUGEINT)', 6)} AS cout_total_eur,
            {eur('CAST(units AS HUGEINT)', 7, 'total_phrases')} AS cout_phrase_eur, round(secs::DOUBLE / 60, 2) AS duree_min,
            1.08::DOUBLE AS taux_eur_usd, 5 AS nb_modeles, 9 AS nb_questions,
            '{" | ".join(short(m) for m in ANSWER_MODELS)}' AS modeles, {", ".join(f'"total_{c}"' for c in CATS)},
            {", ".join(f'round(100.0::DOUBLE * "total_{c}" / total_phrases, 1) AS "pct_{c}"' for c in CATS)}
            FROM (SELECT count(*) AS total_phrases, sum(units) AS units, sum(CAST(duration_s_phrase AS DECIMAL(18,2))) AS secs, {totals}
                  FROM lab JOIN money USING ({K}))""",
            *VOTE_CTES),
        "agreement_per_phrase": with_(
            f"""SELECT lang AS source_folder, source AS source_file, CAST(doc_id AS INTEGER) AS phrase_index,
            text AS phrase_text, {", ".join(f'"Accord_{q}"' for q in Q)}
            FROM documents JOIN (SELECT {K}, {accord('Accord')} FROM va GROUP BY {K}) a ON a.phrase_index = doc_id""",
            *VOTE_CTES),
        "flat_listing": with_(
            f"""SELECT {K}, categorie, {_score_strings()}, cost_eur_phrase, {", ".join(f'"AGG_{q}"' for q in Q)}, text AS phrase
            FROM lab JOIN money USING ({K}) JOIN (SELECT {K}, {agg} FROM va GROUP BY {K}) USING ({K})
            JOIN documents ON phrase_index = doc_id""",
            *VOTE_CTES),
    }


def _bits(model: str, category: str) -> str:
    return (
        f"string_agg(CASE WHEN model = '{model}' AND category = '{category}' THEN "
        f"CASE WHEN NOT failed AND answer = 'oui' THEN '1' ELSE '0' END END, '' ORDER BY ord)"
    )


# --- sensitivity -----------------------------------------------------------------

SEGMENTS = UNITS.replace("phrase_index", "paragraph_index")
PREDICTIONS = f"""
ph AS (
  SELECT {S}, model, model_idx, md5(seed || '|' || model) AS h FROM u, models
),
pred AS (
  SELECT {S}, model, model_idx, {d('h', 2, 2)} < 12 AS failed,
    CASE WHEN {d('h', 2, 2)} < 12 THEN 'Description' WHEN {d('h', 1)} < 6 THEN 'ROI' WHEN {d('h', 1)} < 10 THEN 'Notoriete'
      WHEN {d('h', 1)} < 13 THEN 'Obligation' ELSE 'Description' END AS categorie,
    CASE WHEN {d('h', 2, 2)} < 12 THEN 0.0::DOUBLE ELSE ({d('h', 4, 2)} % 101)::DOUBLE / 100 END AS confiance
  FROM ph
)"""
SUBSETS = """
subsets AS (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS subset_id),
members AS (
  SELECT subset_id, model_idx, CAST(5 - bit_count(subset_id) AS INTEGER) AS k
  FROM subsets, models WHERE (subset_id >> (4 - model_idx)) & 1 = 1
),
ref_scores AS (
  SELECT {S}, categorie, sum(confiance * confiance ORDER BY model_idx) AS s, min(model_idx) AS f
  FROM pred WHERE NOT failed GROUP BY {S}, categorie
),
ref AS (
  SELECT u.source_folder, u.source_file, u.paragraph_index, coalesce(r.categorie, 'Description') AS label,
    CASE WHEN coalesce(r.total, 0) > 0 THEN round(r.s / r.total, 3) ELSE 0.0 END AS confidence
  FROM u LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY s DESC, f) AS rn, sum(s) OVER (PARTITION BY {S}) AS total FROM ref_scores
  ) r ON r.rn = 1 AND r.source_folder = u.source_folder AND r.source_file = u.source_file AND r.paragraph_index = u.paragraph_index
),
sub_scores AS (
  SELECT {S}, subset_id, categorie, sum(confiance * confiance ORDER BY model_idx) AS s, min(model_idx) AS f
  FROM pred JOIN members USING (model_idx) WHERE NOT failed GROUP BY {S}, subset_id, categorie
),
sub AS (
  SELECT r.source_folder, r.source_file, r.paragraph_index, z.subset_id, CAST(5 - bit_count(z.subset_id) AS INTEGER) AS k,
    coalesce(b.categorie, 'Description') AS label, coalesce(b.categorie, 'Description') <> r.label AS changed
  FROM ref r CROSS JOIN subsets z LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY {S}, subset_id ORDER BY s DESC, f) AS rn FROM sub_scores
  ) b ON b.rn = 1 AND b.subset_id = z.subset_id AND b.source_folder = r.source_folder
     AND b.source_file = r.source_file AND b.paragraph_index = r.paragraph_index
),
rates AS (
  SELECT {S}, k, count(*) AS nb_combinations, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS BIGINT) AS nb_changes,
    round(100.0::DOUBLE * sum(CASE WHEN changed THEN 1 ELSE 0 END) / count(*), 1) AS pct_change
  FROM sub GROUP BY {S}, k
),
stab AS (
  SELECT {S}, ((2 * (1000 * count(*) - CAST(round(sum(pct_change) * 10) AS BIGINT)) + count(*)) // (2 * count(*)))::DOUBLE / 10 AS stability_score
  FROM rates GROUP BY {S}
)""".replace("{S}", S)


def sensitivity_sql() -> dict[str, str]:
    base = (model_list(ANSWER_MODELS), SEGMENTS, PREDICTIONS, SUBSETS)
    short = sorted((m.split("/")[-1], i) for i, m in enumerate(ANSWER_MODELS))
    names = "concat_ws(' + ', " + ", ".join(f"CASE WHEN (subset_id >> {4 - i}) & 1 = 1 THEN '{s}' END" for s, i in short) + ")"
    wide = ", ".join(
        f"max(CASE WHEN model_idx = {i} THEN categorie END) AS \"pred_{m.split('/')[-1]}\", max(CASE WHEN model_idx = {i} THEN confiance END) AS \"conf_{m.split('/')[-1]}\""
        for i, m in enumerate(ANSWER_MODELS))
    qcols = ", ".join(f"max(CASE WHEN question_key = '{q}' THEN answer END) AS \"Q_{q}\"" for q in Q)
    calls = (QUESTIONS, answers("u", S), votes_cte(S))
    dataset = f"""ds AS (SELECT u.source_folder AS client, '' AS dossier, {", ".join("u." + c.strip() for c in S.split(","))},
        'Introduction' AS section_title, doc.text AS paragraph, label, confidence, stability_score,
        scores_roi, scores_notoriete, scores_obligation, w.* EXCLUDE ({S}), qa.* EXCLUDE ({S})
        FROM u JOIN documents doc ON doc.doc_id = u.paragraph_index
        JOIN ref USING ({S}) JOIN stab USING ({S}) JOIN sc USING ({S})
        JOIN (SELECT {S}, {wide} FROM pred GROUP BY {S}) w USING ({S})
        JOIN (SELECT {S}, {qcols} FROM va GROUP BY {S}) qa USING ({S}))"""
    return {
        "weighted_vote": with_(f"SELECT {S}, label, confidence FROM ref", *base),
        "leave_k_out": with_(f"SELECT {S}, subset_id, k, label, changed FROM sub", *base),
        "change_rates": with_("SELECT * FROM rates", *base),
        "stability": with_("SELECT * FROM stab", *base),
        "stability_report": with_(
            """SELECT k, CAST(sum(CASE WHEN nb_changes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS segments_affected, count(*) AS segments_total,
            round(100.0::DOUBLE * sum(CASE WHEN nb_changes > 0 THEN 1 ELSE 0 END) / count(*), 1) AS pct_affected FROM rates GROUP BY k""",
            *base),
        "top_combinations": with_(
            f"""SELECT k, CAST(rank AS INTEGER) AS rank, models_kept, nb_changes, total, pct_change FROM (
              SELECT *, row_number() OVER (PARTITION BY k ORDER BY pct_change DESC, subset_id DESC) AS rank FROM (
                SELECT k, subset_id, {names} AS models_kept, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS BIGINT) AS nb_changes,
                  count(*) AS total, round(100.0::DOUBLE * sum(CASE WHEN changed THEN 1 ELSE 0 END) / count(*), 1) AS pct_change
                FROM sub GROUP BY k, subset_id))""",
            *base),
        "labelled_dataset": with_("SELECT * FROM ds", *base, *calls, dataset),
        "file_synthesis": with_(
            f"""SELECT source_folder, source_file, count(*) AS total,
            {", ".join(f"CAST(sum(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in CATS)},
            ((2 * CAST(round(sum(confidence) * 1000) AS BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 1000 AS conf_moy,
            ((2 * CAST(round(sum(stability_score) * 10) AS BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 10 AS stabilite_moy,
            {", ".join(f"round(100.0::DOUBLE * sum(CASE WHEN label = '{c}' THEN 1 ELSE 0 END) / count(*), 1) AS \"pct_{c}\"" for c in CATS[:3])}
            FROM ds GROUP BY source_folder, source_file""",
            *base, *calls, dataset),
        "unstable_dataset": with_("SELECT * FROM ds WHERE stability_score < 80", *base, *calls, dataset),
    }


# --- ensembles --------------------------------------------------------------------


def _ensemble_ctes() -> tuple[str, ...]:
    rows = [(i, n, m) for i, (n, ms) in enumerate(vocab.ENSEMBLES.items()) for m in ms]
    names = [(i, n) for i, n in enumerate(vocab.ENSEMBLES)]
    votes = f"""
mv AS (
  SELECT {K}, ensemble, count(DISTINCT model) AS n_valid FROM calls JOIN ens USING (model) WHERE NOT failed GROUP BY {K}, ensemble
),
ev AS (
  SELECT {K}, ensemble, question_key, ord, category,
    CASE WHEN 2 * sum(CASE WHEN NOT failed AND answer = 'oui' THEN 1 ELSE 0 END) > coalesce(max(n_valid), 0)
      THEN 'oui' ELSE 'non' END AS answer
  FROM calls JOIN ens USING (model) LEFT JOIN mv USING ({K}, ensemble) GROUP BY {K}, ensemble, question_key, ord, category
),
es AS (
  SELECT {K}, ensemble,
    CAST(sum(CASE WHEN category = 'ROI' AND answer = 'oui' THEN 1 ELSE 0 END) AS INTEGER) AS roi,
    CAST(sum(CASE WHEN category = 'Notoriete' AND answer = 'oui' THEN 1 ELSE 0 END) AS INTEGER) AS noto,
    CAST(sum(CASE WHEN category = 'Obligation' AND answer = 'oui' THEN 1 ELSE 0 END) AS INTEGER) AS obl
  FROM ev GROUP BY {K}, ensemble
),
active AS (SELECT ensemble, count(*) AS n_modeles_actifs FROM ens GROUP BY ensemble),
er AS (SELECT *, {label_sql('roi', 'noto', 'obl')} AS categorie FROM es JOIN active USING (ensemble)),
chg AS (
  SELECT a.source_folder, a.source_file, a.phrase_index, a.ensemble, a.question_key, a.ord
  FROM ev a JOIN ev r USING ({K}, question_key)
  WHERE r.ensemble = 'A_reference' AND a.ensemble <> 'A_reference' AND a.answer <> r.answer
),
pr AS (
  SELECT a.source_folder, a.source_file, a.phrase_index, a.ensemble, r.categorie AS ref_categorie, a.categorie AS alt_categorie,
    'ROI:' || r.roi || ' NOT:' || r.noto || ' OBL:' || r.obl AS ref_scores,
    'ROI:' || a.roi || ' NOT:' || a.noto || ' OBL:' || a.obl AS alt_scores,
    CAST(a.n_modeles_actifs AS INTEGER) AS n_modeles_actifs, r.categorie <> a.categorie AS differs
  FROM er a JOIN er r USING ({K}) WHERE r.ensemble = 'A_reference' AND a.ensemble <> 'A_reference'
),
conc AS (
  SELECT ensemble, count(*) AS n_segments, CAST(sum(CASE WHEN differs THEN 0 ELSE 1 END) AS BIGINT) AS n_concordants,
    round(100.0::DOUBLE * sum(CASE WHEN differs THEN 0 ELSE 1 END) / count(*), 2) AS taux_concordance
  FROM pr GROUP BY ensemble
),
byclass AS (
  SELECT ensemble, categorie, CAST(sum(CASE WHEN ref_categorie = categorie THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
    CAST(sum(CASE WHEN ref_categorie = categorie AND NOT differs THEN 1 ELSE 0 END) AS BIGINT) AS n_concordants
  FROM pr, cats GROUP BY ensemble, categorie
),
qdiv AS (
  SELECT e.ensemble, e.n_divergents, q.question_key, count(c.question_key) AS n_changes,
    {pct('count(c.question_key)', 'e.n_divergents', 1)} AS taux
  FROM (SELECT ensemble, CAST(sum(CASE WHEN differs THEN 1 ELSE 0 END) AS BIGINT) AS n_divergents FROM pr GROUP BY ensemble) e
  CROSS JOIN questions q
  LEFT JOIN (SELECT chg.* FROM chg JOIN pr USING ({K}, ensemble) WHERE differs) c
    ON c.ensemble = e.ensemble AND c.question_key = q.question_key
  GROUP BY e.ensemble, e.n_divergents, q.question_key
)"""
    return (
        QUESTIONS, model_list(ENSEMBLE_MODELS), UNITS, answers(), values("ens", "ens_no, ensemble, model", rows),
        values("ens_names", "ens_no, ensemble", names), values("cats", "categorie", [(c,) for c in CATS]), votes,
    )


def ensemble_sql() -> dict[str, str]:
    base = _ensemble_ctes()
    ref = vocab.ENSEMBLES["A_reference"]
    moved = values("moved", "ensemble, gone_no, model, way", [
        *[(n, i, m, "out") for n, ms in vocab.ENSEMBLES.items() for i, m in enumerate(ref) if m not in ms],
        *[(n, i, m, "in") for n, ms in vocab.ENSEMBLES.items() for i, m in enumerate(ms) if m not in ref],
    ])
    gone = values("gone", "ensemble, retires", [
        (n, " | ".join(m.split("/")[-1] for m in ref if m not in ms)) for n, ms in vocab.ENSEMBLES.items()])
    added = values("added", "ensemble, ajoutes", [
        (n, " | ".join(m.split("/")[-1] for m in ms if m not in ref)) for n, ms in vocab.ENSEMBLES.items()])
    texted = lambda body: f"SELECT x.*, text AS phrase FROM ({body}) x JOIN documents ON doc_id = x.phrase_index"
    return {
        "ensemble_revote": with_(
            f"""SELECT {K}, ensemble, CAST(n_modeles_actifs AS INTEGER) AS n_modeles_actifs, roi, noto AS "not", obl, categorie,
            answers FROM er JOIN (SELECT {K}, ensemble, string_agg(answer, ',' ORDER BY ord) AS answers FROM ev GROUP BY {K}, ensemble)
            USING ({K}, ensemble)""", *base),
        "concordance": with_(
            """SELECT ensemble, retires AS modeles_retires, ajoutes AS modeles_ajoutes, n_segments, n_concordants, taux_concordance
            FROM conc JOIN gone USING (ensemble) JOIN added USING (ensemble)""", *base, gone, added),
        "concordance_by_class": with_(
            f"SELECT ensemble, categorie, n_ref, n_concordants, {pct('n_concordants', 'n_ref', 1, 'NULL')} AS taux FROM byclass", *base),
        "question_divergence": with_("SELECT * FROM qdiv", *base),
        "divergent_segments": with_(
            texted(f"""SELECT {K}, ensemble, ref_categorie, alt_categorie, ref_scores, alt_scores,
            coalesce(qs, '') AS questions_changees, n_modeles_actifs FROM pr LEFT JOIN (
              SELECT {K}, ensemble, string_agg(question_key, ' | ' ORDER BY ord) AS qs FROM chg GROUP BY {K}, ensemble
            ) USING ({K}, ensemble) WHERE differs"""), *base),
        "model_influence": with_(
            """SELECT model, count(*) AS nb_comparaisons, round(avg(100 - taux_concordance), 2) AS divergence_moy,
            round(max(100 - taux_concordance), 2) AS divergence_max,
            CASE WHEN avg(100 - taux_concordance) > 15 THEN 'FORT' WHEN avg(100 - taux_concordance) > 5 THEN 'MOYEN' ELSE 'FAIBLE' END AS influence,
            CASE WHEN avg(100 - taux_concordance) > 15 THEN 'Ce modèle influence fortement la classification — à garder en priorité'
              WHEN avg(100 - taux_concordance) > 5 THEN 'Ce modèle a un impact modéré'
              ELSE 'Ce modèle est interchangeable sans impact majeur' END AS interpretation
            FROM conc JOIN moved USING (ensemble) WHERE way = 'out' GROUP BY model""", *base, moved),
        "question_sensitivity": with_(
            """SELECT question_key, label, round(avg(taux), 2) AS divergence_moy, round(max(taux), 2) AS divergence_max,
            CASE WHEN avg(taux) > 30 THEN 'ÉLEVÉE' WHEN avg(taux) > 10 THEN 'MOYENNE' ELSE 'FAIBLE' END AS sensibilite
            FROM qdiv JOIN qlabels USING (question_key) GROUP BY question_key, label""",
            *base, values("qlabels", "question_key, label", list(vocab.QUESTION_LABELS.items()))),
        "unstable_segments": with_(
            texted(f"""SELECT {K}, ref_categorie, n_changements, categories_alt, ensembles_alt, modeles_retires,
            CASE WHEN n_seen > 1 THEN 'Segment AMBIGU — catégorie réelle incertaine, révision manuelle conseillée'
              ELSE 'Catégorie ' || ref_categorie || ' robuste mais sensible au choix des modèles' END AS diagnostic
            FROM (
              SELECT {K}, ref_categorie, count(*) AS n_changements, count(DISTINCT alt_categorie) AS n_seen,
                string_agg(DISTINCT alt_categorie, ' | ' ORDER BY alt_categorie) AS categories_alt,
                string_agg(ensemble, ' | ' ORDER BY ens_no) AS ensembles_alt, string_agg(retires, ' | ' ORDER BY ens_no) AS modeles_retires
              FROM pr JOIN gone USING (ensemble) JOIN ens_names USING (ensemble) WHERE differs GROUP BY {K}, ref_categorie
            ) WHERE n_changements >= 2"""), *base, gone),
        "stable_segments": with_(
            texted(f"""SELECT {K}, any_value(ref_categorie) AS categorie, 'TRÈS HAUTE — stable dans tous les ensembles testés' AS fiabilite
            FROM pr GROUP BY {K} HAVING sum(CASE WHEN differs THEN 1 ELSE 0 END) = 0"""), *base),
        "stability_headline": with_(
            f"""SELECT n_total, n_stables, n_total - n_stables AS n_changeants, round(100.0::DOUBLE * n_stables / n_total, 1) AS pct_stables,
            round(100.0::DOUBLE * (n_total - n_stables) / n_total, 1) AS pct_changeants FROM (
              SELECT count(*) AS n_total, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_stables FROM (
                SELECT {K}, sum(CASE WHEN differs THEN 1 ELSE 0 END) AS n FROM pr GROUP BY {K}))""", *base),
        "ensemble_global_view": with_(
            f"""SELECT 'A_reference' AS ensemble_ref, ensemble AS ensemble_alt, retires AS modeles_retires, ajoutes AS modeles_ajoutes,
            n_segments, conc.n_concordants AS n_concordants, n_segments - conc.n_concordants AS n_divergents, taux_concordance,
            round(100 - taux_concordance, 2) AS taux_divergence,
            {", ".join(f"max(CASE WHEN categorie = '{c}' THEN " + pct('byclass.n_concordants', 'n_ref', 1, 'NULL') + f" END) AS \"concord_{c}\"" for c in CATS)}
            FROM conc JOIN gone USING (ensemble) JOIN added USING (ensemble) JOIN byclass USING (ensemble)
            GROUP BY ALL""", *base, gone, added),
    }


# --- judge -------------------------------------------------------------------------


def judge_sql() -> dict[str, str]:
    gt = f"""
gt AS (
  SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'ROI' WHEN quality = 1 THEN 'Notoriete'
    WHEN toxic = 1 THEN 'Obligation' ELSE 'Description' END AS category FROM labels
),
vh AS (SELECT {S}, md5(seed || '|judge') AS h FROM u WHERE paragraph_index % 11 <> 0),
vd AS (
  SELECT {S}, {d('h', 1)} < 11 AS accord,
    CASE WHEN paragraph_index % 7 <> 0 THEN CASE WHEN {d('h', 2)} < 5 THEN 'ROI' WHEN {d('h', 2)} < 9 THEN 'Notoriete'
      WHEN {d('h', 2)} < 13 THEN 'Obligation' ELSE 'Description' END END AS categorie_juge,
    ({d('h', 3, 2)} % 101)::DOUBLE / 100 AS confiance_juge, 'verdict ' || substr(h, 1, 4) AS justification_juge
  FROM vh
),
first AS (SELECT {S}, categorie AS categorie_cot, confiance AS confiance_cot FROM pred WHERE model_idx = 0),
judged AS (
  SELECT first.*, coalesce(accord, false) AS accord_avec_modele, coalesce(vd.categorie_juge, categorie_cot) AS categorie_juge,
    coalesce(vd.confiance_juge, 0.0) AS confiance_juge, coalesce(vd.justification_juge, '') AS justification_juge,
    '' AS analyse_critique, coalesce(gt.category, 'N/A') AS categorie_gt
  FROM first LEFT JOIN vd USING ({S}) LEFT JOIN gt ON gt.doc_id = paragraph_index
)"""
    base = (model_list(ANSWER_MODELS), SEGMENTS, PREDICTIONS, gt)
    one_model = (QUESTIONS, answers("u", S), votes_cte(S).replace("FROM calls", "FROM (SELECT * FROM calls WHERE model_idx = 0)"))
    ok = lambda c: f"sum(CASE WHEN categorie_gt <> 'N/A' AND {c} = categorie_gt THEN 1 ELSE 0 END)"
    n_gt = "sum(CASE WHEN categorie_gt <> 'N/A' THEN 1 ELSE 0 END)"
    return {
        "ground_truth_match": with_(f"SELECT {S}, categorie_cot, categorie_gt FROM judged", *base),
        "ground_truth_accuracy": with_(
            f"""SELECT CAST({n_gt} AS BIGINT) AS n_gt, CAST({ok('categorie_cot')} AS BIGINT) AS n_ok,
            round(100.0::DOUBLE * {ok('categorie_cot')} / {n_gt}, 1) AS accuracy FROM judged""", *base),
        "judge_report": with_(
            f"""SELECT total, n_accords, total - n_accords AS n_desaccords, round(100.0::DOUBLE * n_accords / total, 1) AS pct_accords,
            round(100.0::DOUBLE * (total - n_accords) / total, 1) AS pct_desaccords, n_gt, accuracy_cot, accuracy_juge,
            round(accuracy_juge - accuracy_cot, 1) AS delta_points FROM (
              SELECT count(*) AS total, CAST(sum(CASE WHEN accord_avec_modele THEN 1 ELSE 0 END) AS BIGINT) AS n_accords,
                CAST({n_gt} AS BIGINT) AS n_gt, round(100.0::DOUBLE * {ok('categorie_cot')} / {n_gt}, 1) AS accuracy_cot,
                round(100.0::DOUBLE * {ok('categorie_juge')} / {n_gt}, 1) AS accuracy_juge FROM judged)""", *base),
        "self_consistency": with_(
            f"""SELECT {S}, categorie_cot, lab.categorie AS label_calcule, categorie_cot = lab.categorie AS coherent
            FROM first JOIN lab USING ({S})""", *base, *one_model),
        "consistency_rate": with_(
            f"""SELECT count(*) AS total, CAST(sum(CASE WHEN categorie_cot = lab.categorie THEN 1 ELSE 0 END) AS BIGINT) AS n_coherents,
            round(100.0::DOUBLE * sum(CASE WHEN categorie_cot = lab.categorie THEN 1 ELSE 0 END) / count(*), 1) AS pct_coherents
            FROM first JOIN lab USING ({S})""", *base, *one_model),
        "judge_detail": with_(
            f"""SELECT row_number() OVER (ORDER BY source_folder, source_file, paragraph_index) AS numero, {S},
            'Introduction' AS section, text AS extrait, categorie_cot, confiance_cot,
            CASE WHEN accord_avec_modele THEN 'OUI' ELSE 'NON' END AS accord_juge, categorie_juge, confiance_juge,
            justification_juge, analyse_critique, categorie_gt, categorie_cot = categorie_gt AS cot_ok, categorie_juge = categorie_gt AS juge_ok
            FROM judged JOIN documents ON doc_id = paragraph_index""", *base),
    }
