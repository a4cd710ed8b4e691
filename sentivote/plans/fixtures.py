"""Inputs derived from the supplied tables, as whole-table expressions.

The supplied documents hold no Markdown and there are no recorded answers, so
both are derived by rules that any SQL engine can repeat: Markdown by line
position, answers by hexadecimal digits of an md5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentivote import vocab

ANSWER_MODELS = [m.name for m in vocab.MODELS]
ENSEMBLE_MODELS = list(dict.fromkeys(m for ms in vocab.ENSEMBLES.values() for m in ms))

#: A pattern for each question, for answers without a model.
RULES = {
    "roi_1": "(?i)tion", "roi_2": "(?i)ment", "roi_3": "[0-9]{3}", "notoriete_1": "(?i)the", "notoriete_2": "(?i)under",
    "notoriete_3": "[A-Z]{4}", "obl_1": "[0-9]", "obl_2": "(?i)ver", "obl_3": "@",
}


#: Templates of the prompts that take one.
SEGMENT_TEMPLATE = "Titre : {section_title}\n{paragraph}"
QWEN_TEMPLATE = "/no_think {section_title}\n{paragraph}"
JUDGE_TEMPLATE = "{section_title}\n{paragraph}\n{raisonnement}\n{categorie_proposee} {confiance}\n{reponses_str}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(h: Column, at: int) -> Column:
    """Value of the hexadecimal digit at 1-based position ``at``."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(h, at, 1)) - 1


def digits(h: Column, at: int, n: int) -> Column:
    value = digit(h, at)
    for i in range(1, n):
        value = value * 16 + digit(h, at + i)
    return value


def decorate(line: Column, kind: Column, level: Column) -> Column:
    """Markdown form of a line; ``kind`` runs over 0..16.  The line stays whole, marks and lines are added."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = F.substring(line, 1, 12)
    return (
        F.when(kind == 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), line))
        .when(kind == 2, text("- ", line))
        .when(kind == 3, text("12. ", line))
        .when(kind == 4, text("**", head, "** ", line))
        .when(kind == 5, text("[", head, "](https://example.com/p?q=1) ", line))
        .when(kind == 6, text("![plan](a.png)\n", line))
        .when(kind == 7, text("***---\n", line))
        .when(kind == 8, text("| ", line, " | x |"))
        .when(kind == 9, text("|---|:--|\n", line))
        .when(kind == 10, text(":-- -\n", line))
        .when(kind == 11, text("\n", line))
        .when((kind == 13) | (kind == 15), text("```\n", line))
        .when(kind == 16, text('<span id="p1">x</span><b>', line, "</b>&nbsp;`fin` \\* 2  a"))
        .otherwise(line)
    )


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


#: Words of the supplied prose and what stands in their place in texts with abbreviations.
ABBREVIATIONS = {" of ": " Dr. ", " by ": " e.g. ", " de ": " art. ", " der ": " Abs. ", " und ": " z.B. ", " la ": " av. ", " en ": " 3. ", " los ": " Sr. "}


def abbreviated(text: Column) -> Column:
    """The text with abbreviations and ordinals in place of some words; no sentence ends at them."""
    for word, short in ABBREVIATIONS.items():
        text = F.replace(text, F.lit(word), F.lit(short))
    return text


def md_docs(spark: SparkSession, sf_dir: str, rewrite: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Documents rewritten as Markdown: (source_folder, source_file, text)."""
    docs = documents(spark, sf_dir, "source", "text").withColumn("text", rewrite(F.col("text")))
    lines = F.transform(
        F.split("text", "\n"),
        lambda l, i: decorate(l, (i + F.col("doc_id")) % 17, (1 + i % 3).cast("int")),
    )
    return docs.select(
        F.col("source").alias("source_folder"),
        F.format_string("doc_%d.md", F.col("doc_id")).alias("source_file"),
        F.array_join(lines, "\n").alias("text"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as classified units: language is the client, source the file."""
    return documents(spark, sf_dir, "lang", "source").select(
        F.col("lang").alias("source_folder"),
        F.col("source").alias("source_file"),
        F.col("doc_id").cast("int").alias("phrase_index"),
    )


def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("source_folder"),
        F.col("source").alias("source_file"),
        F.col("doc_id").cast("int").alias("phrase_index"),
        F.col("text").alias("phrase"),
    )


def hashed_answers(units_df: DataFrame, seed: Column, models: list[str] = ANSWER_MODELS) -> DataFrame:
    """Recorded answers for every unit, model and question.

    ``seed`` identifies the unit; answer, error, tokens and duration come from
    the digits of md5(seed|model|question).
    """
    asked = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.lit(q).alias("question_key"))
                for m in models
                for q in vocab.QUESTION_KEYS
            ]
        )
    )
    keys = units_df.columns
    called = units_df.select(*keys, seed.alias("_seed"), asked.alias("call"))
    hashed = called.select(
        *keys,
        "call.model",
        "call.question_key",
        F.conv(F.substring(F.md5(F.concat_ws("|", "_seed", "call.model", "call.question_key")), 1, 8), 16, 10).cast("long").alias("_n"),
    )
    # the first eight digits as one number: a digit is four of its bits
    part = lambda shift, mask: F.shiftright("_n", shift).bitwiseAND(F.lit(mask))
    failed = part(20, 255) < 6
    return hashed.select(
        *keys,
        "model",
        "question_key",
        F.when(failed, "non").when(part(28, 15) < 7, "oui").otherwise("non").alias("answer"),
        F.when(failed, 0).otherwise(50 + part(12, 255)).cast("int").alias("tok_in"),
        F.when(failed, 0).otherwise(4 + part(8, 15)).cast("int").alias("tok_out"),
        (part(0, 255) / 100.0).alias("duration_s"),
        F.when(failed, "timeout").alias("erreur"),
    )


def votes(spark: SparkSession, sf_dir: str, models: list[str] = ANSWER_MODELS) -> DataFrame:
    u = units(spark, sf_dir)
    return hashed_answers(u, F.col("phrase_index").cast("string"), models)


def predictions(spark: SparkSession, sf_dir: str, models: list[str] = ANSWER_MODELS) -> DataFrame:
    """One category with a confidence per segment and model."""
    u = units(spark, sf_dir).withColumnRenamed("phrase_index", "paragraph_index")
    asked = u.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    h = F.md5(F.concat_ws("|", F.col("paragraph_index").cast("string"), "model"))
    hashed = asked.withColumn("_h", h)
    h = F.col("_h")
    d = digit(h, 1)
    failed = digits(h, 2, 2) < 12
    category = F.when(d < 6, "ROI").when(d < 10, "Notoriete").when(d < 13, "Obligation").otherwise("Description")
    return hashed.select(
        *u.columns,
        "model",
        F.when(failed, "Description").otherwise(category).alias("categorie"),
        F.when(failed, 0.0).otherwise((digits(h, 4, 2) % 101) / 100.0).alias("confiance"),
        F.when(failed, "timeout").alias("erreur"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as (source_folder, source_file, paragraph_index, category, ord)."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    category = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ROI")
        .when((F.col("quality") == 1), "Notoriete")
        .when(F.col("toxic") == 1, "Obligation")
        .otherwise("Description")
    )
    return labels.join(docs, "doc_id").select(
        F.col("lang").alias("source_folder"),
        F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("source_file"),
        F.col("doc_id").cast("string").alias("paragraph_index"),
        category.alias("category"),
        F.col("doc_id").alias("ord"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge verdicts; every 11th segment has none, every 7th lacks the category."""
    u = units(spark, sf_dir).withColumnRenamed("phrase_index", "paragraph_index")
    h = F.md5(F.concat(F.col("paragraph_index").cast("string"), F.lit("|judge")))
    hashed = u.filter(F.col("paragraph_index") % 11 != 0).withColumn("_h", h)
    h = F.col("_h")
    d = digit(h, 2)
    category = F.when(d < 5, "ROI").when(d < 9, "Notoriete").when(d < 13, "Obligation").otherwise("Description")
    return hashed.select(
        *u.columns,
        (digit(h, 1) < 11).alias("accord"),
        F.when(F.col("paragraph_index") % 7 != 0, category).alias("categorie_juge"),
        (digits(h, 3, 2) % 101 / 100.0).alias("confiance_juge"),
        F.concat(F.lit("verdict "), F.substring(h, 1, 4)).alias("justification_juge"),
        F.lit(None).cast("string").alias("analyse_critique"),
    )


# --- raw replies -------------------------------------------------------------------


def _pick(selector: Column, options: list[Column]) -> Column:
    return F.element_at(F.array(*options), (selector + 1).cast("int"))


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw reply per document and question, in sixteen shapes."""
    docs = documents(spark, sf_dir, "text")
    asked = docs.select("*", F.explode(F.array(*[F.lit(q) for q in vocab.QUESTION_KEYS])).alias("question_key"))
    h = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "question_key", F.lit("raw")))
    shapes = [
        '{"reponse": "oui"}', '```json\n{"reponse": "Oui "}\n```', "Je pense que OUI", '{"reponse": "non"}',
        '["oui"]', "aucune id\u00e9e", 'Voici {"reponse": "yes"} merci', '{"autre": 1}',
        '{"reponse": true}', '{"reponse": 1}', '{"reponse": "OUI"}', '```\n{"reponse": "non"}\n```',
        '{"reponse": null}', '{"reponse": "oui" ', '"oui"',
    ]
    quoted = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
    return asked.withColumn("_h", h).select(
        "doc_id", "question_key", _pick(digit(F.col("_h"), 1), [*[F.lit(s) for s in shapes], quoted]).alias("raw")
    )


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structured reply per document: category, confidence, two answers."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    hashed = docs.withColumn("_h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|structured"))))
    h = F.col("_h")
    category = _pick(digit(h, 1) % 8, [F.lit(c) for c in (
        "ROI", "roi", "Notori\u00e9t\u00e9", "NOTORIETE", "obligation", "Description", "autre", "Notoriete")])
    conf = _pick(digit(h, 2) % 8, [F.lit(c) for c in ("0.55", '"0.8"', "1.7", "-2", '"abc"', "null", "true", "0.25")])
    body = F.concat(
        F.lit('{"categorie": "'), category, F.lit('", "confiance": '), conf,
        F.lit(', "justification": "j", "reponses_questions": {"roi_1": "'),
        F.when(digit(h, 3) < 8, "oui").otherwise("non"),
        F.lit('", "not_2": "YES", "obl_3": '), F.when(digit(h, 4) < 8, "true").otherwise("0"), F.lit("}}"),
    )
    raw = _pick(digit(h, 5) % 4, [body, F.concat(F.lit("```json\n"), body, F.lit("\n```")),
                                  F.concat(F.lit("R\u00e9sultat : "), body, F.lit(" fin")), F.lit("pas de JSON")])
    return hashed.select("doc_id", raw.alias("raw"))


def chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded chat responses, one per conversation turn, as JSON text."""
    turns = table(spark, sf_dir, "conversations")
    text = F.col("text")
    message = (
        F.when(F.col("turn") % 4 == 0, F.struct(text.alias("content"), F.lit(None).cast("string").alias("reasoning")))
        .when(F.col("turn") % 4 == 1, F.struct(F.lit("  ").alias("content"), text.alias("reasoning")))
        .when(F.col("turn") % 4 == 2, F.struct(F.lit(None).cast("string").alias("content"), F.lit("").alias("reasoning")))
        .otherwise(F.struct(text.alias("content"), F.lit("r").alias("reasoning")))
    )
    body = F.struct(
        F.array(F.struct(message.alias("message"))).alias("choices"),
        F.struct(
            F.length(text).alias("prompt_tokens"),
            F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("completion_tokens"),
        ).alias("usage"),
    )
    return turns.select("conv_id", "turn", F.to_json(body).alias("response"))


# --- document structure --------------------------------------------------------------


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), "text"
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"),
        F.floor(turn / 3 + 1).cast("int").alias("page"),
        turn.cast("int").alias("box_no"),
        F.array(turn / 8.0, turn * 1.0, turn * 2.0, turn + 0.5).alias("bbox"),
        F.when(turn % 4 == 3, F.concat(F.lit(" \n "), "text")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("text"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    kind = (turn + F.col("conv_id")) % 7
    paths = ["//Document/H1", "//Document/P", "//Document/Table", "//Document/Table/TR", "//Document/Table/TR/TD",
             "//Document/Table[2]/TR/TD/P", "//Document/P[2]"]
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"),
        turn.cast("int").alias("el_no"),
        _pick(kind, [F.lit(p) for p in paths]).alias("path"),
        F.col("text"),
        F.when(turn > 0, F.floor(turn / 4 + 1).cast("int")).alias("page"),
        F.when(kind == 0, 20.0).when(kind == 6, 15.0).when(kind == 1, F.lit(None)).otherwise(10.0).alias("text_size"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as one table: a header row and one row per event."""
    from sentivote.functions.ranking import numbered

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    rows = numbered(events, ["event_id"], "pos", ["user_id"])
    row = (F.col("pos") + 1).cast("int")
    cell = lambda r, c, value: F.struct(r.alias("row"), F.lit(c).alias("col"), value.alias("value"))
    body = F.array(
        cell(row, 1, F.col("event_id").cast("string")),
        cell(row, 2, F.col("event_type")),
        cell(row, 3, F.when(F.col("event_id") % 5 != 0, F.col("props"))),
    )
    header = F.array(*[cell(F.lit(0), i, F.lit(n)) for i, n in enumerate(("id", "type", "props"), 1)])
    with_header = F.when(F.col("pos") == 0, F.concat(header, body)).otherwise(body)
    return rows.select(F.col("user_id").alias("doc"), F.lit(1).alias("table_no"), F.inline(with_header))


def tables_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extracted table for every turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"),
        (F.col("turn") + 1).cast("int").alias("table_no"),
        F.concat(F.lit("| "), "text", F.lit(" |\n|---|")).alias("markdown"),
    )


def docs_with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown texts with a table heading in every third turn."""
    from sentivote.operators.docstruct import join_pages

    turn = F.col("page") - 1
    text = F.when((turn + F.col("doc")) % 3 == 0, F.concat(F.lit("### Tableau\n\n"), "text")).otherwise(
        F.concat(F.lit("mot Tableau "), "text")
    )
    return join_pages(page_texts(spark, sf_dir).withColumn("text", text), separator="\n").select("doc", "text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR block graph from orders: a table per order, a cell per line item, counted anew inside the order.

    Line items are dealt and read once, an order's last one also brings its table; the blocks stay dealt by order.
    They are many times larger than their line items, so the parts stay as many as set and aren't merged by size.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    kinds = lambda letters: F.array(*[F.lit(k) for k in letters])
    kind, n = F.col("kind"), F.col("n")
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(parts, "l_orderkey")
    items = dealt.select(
        "l_orderkey", "l_partkey", F.row_number().over(in_order).alias("n"), F.lead(F.lit(False), 1, True).over(in_order).alias("last")
    ).select("*", F.explode(F.when(F.col("last"), kinds("cwvlt")).otherwise(kinds("cwvl"))).alias("kind"))
    child = lambda ids: F.array(F.struct(F.lit("CHILD").alias("type"), ids.alias("ids")))
    none = F.array().cast("array<struct<type:string,ids:array<string>>>")
    number, part = n.cast("string"), F.col("l_partkey").cast("string")
    label = F.concat(F.lit("x"), number)
    words = F.array(F.concat(F.lit("w"), number), F.concat(F.lit("v"), number), F.lit("gone"))
    cells = F.sort_array(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    return items.select(
        F.col("l_orderkey").alias("doc"),
        F.when(kind == "t", 0).otherwise(n).alias("ord"),
        F.when(kind == "t", "t").otherwise(F.concat(kind, number)).alias("id"),
        F.when(kind == "c", "CELL").when(kind.isin("w", "v"), "WORD").when(kind == "l", "LINE").otherwise("TABLE").alias("block_type"),
        F.when(kind == "w", part).when(kind == "v", label).when(kind == "l", F.concat_ws(" ", part, label)).alias("text"),
        F.when(kind == "c", n).alias("row_index"),
        F.when(kind == "c", F.lit(1) + F.col("l_partkey") % 3).cast("int").alias("column_index"),
        F.when(kind == "c", child(words)).when(kind == "t", child(cells)).otherwise(none).alias("relationships"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    failed = i % 13 == 0
    number = lambda c: F.when(failed, 0).otherwise(c).cast("int")
    return docs.select(
        _pick(i % 4, [F.lit(t) for t in ("pypdf", "marker", "docling", "tabula")]).alias("outil"),
        F.when(i % 8 < 4, "lattice").otherwise("stream").alias("mode"),
        F.format_string("doc_%d.pdf", i).alias("fichier"),
        number(F.floor(F.col("n_chars") / 1800) + 1).alias("nb_pages"),
        number(F.col("n_chars")).alias("nb_chars"),
        number(i % 5).alias("nb_tableaux"),
        ((i % 97) / 10.0).alias("temps_secondes"),
        F.when(failed, "illisible").alias("erreur"),
    )
