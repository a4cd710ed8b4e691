"""The fan-out to questions and models, prompts, providers, incremental runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sentivote import vocab
from sentivote.functions import parse
from sentivote.functions.money import cost_units, eur, usd


def shown(name: str, chars: int | None) -> Column:
    """A text column, whole unless a number of characters is given."""
    return F.col(name) if chars is None else F.substring(name, 1, chars)


def call_plan(
    units: DataFrame,
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
    models: Sequence[str] = tuple(m.name for m in vocab.MODELS),
) -> DataFrame:
    """Every unit with every question and model.

    The two closed lists are exploded from a literal, in the unit's own task.
    """
    asked = F.array(
        *[F.struct(F.lit(q).alias("question_key"), F.lit(m).alias("model")) for q in questions for m in models]
    )
    return units.select("*", F.inline(asked))


def fill(template: str, fields: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` fields and doubled literal braces.

    The template is cut at its fields, so text put in is never searched for
    fields again.
    """
    parts: list[Column] = []
    text, i = "", 0
    while i < len(template):
        pair = template[i : i + 2]
        if pair in ("{{", "}}"):
            text, i = text + pair[0], i + 2
        elif template[i] == "{":
            end = template.index("}", i)
            parts += [F.lit(text), fields[template[i + 1 : end]]]
            text, i = "", end + 1
        else:
            text, i = text + template[i], i + 1
    return F.concat(*parts, F.lit(text))


def question_text(question_key: Column, questions: Sequence[vocab.Question] = tuple(vocab.QUESTIONS)) -> Column:
    known = F.create_map(*[c for q in questions for c in (F.lit(q.key), F.lit(q.text))])
    return F.element_at(known, question_key)


def phrase_prompt(template: str = vocab.PHRASE_PROMPT) -> Column:
    return fill(template, {"phrase": F.col("phrase"), "question_text": question_text(F.col("question_key"))})


def paragraph_prompt(template: str = vocab.PARAGRAPH_PROMPT, chars: int | None = None) -> Column:
    return fill(
        template,
        {
            "full_paragraph": shown("full_paragraph", chars),
            "phrase": F.col("phrase"),
            "question_text": question_text(F.col("question_key")),
        },
    )


def paragraph_prompts(
    contexts: DataFrame,
    questions: Sequence[vocab.Question] = tuple(vocab.QUESTIONS),
    models: Sequence[str] = tuple(m.name for m in vocab.MODELS),
    template: str = vocab.PARAGRAPH_PROMPT,
    chars: int | None = None,
    then: Callable[[Column], Column] = lambda prompt: prompt,
) -> DataFrame:
    """Every unit of ``segment.paragraph_contexts`` with every question and model, and ``then`` of its prompt.

    Prompts are made on the paragraph's row, where the context is held once, and the
    models share them; only what ``then`` makes of a prompt, such as a digest, is multiplied.
    """
    keys = [c for c in contexts.columns if c not in ("full_paragraph", "units")]

    def asked(unit: Column) -> Column:
        prompt = lambda q: fill(
            template, {"full_paragraph": shown("full_paragraph", chars), "phrase": unit["phrase"], "question_text": F.lit(q.text)}
        )
        return F.array(
            *[
                F.struct(unit["phrase_index"].alias("phrase_index"), F.lit(q.key).alias("question_key"), then(prompt(q)).alias("prompt"))
                for q in questions
            ]
        )

    calls = contexts.select(*keys, F.inline(F.flatten(F.transform("units", asked))))
    return calls.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))


def with_prompts(calls: DataFrame, prompt: Column, system: str = "") -> DataFrame:
    """Add the two messages of a call for a provider: ``system`` and ``prompt``."""
    return calls.withColumns({"system": F.lit(system), "prompt": prompt})


def segment_prompt(standard: str, for_qwen: str | None = None, chars: int | None = None) -> Column:
    """Prompt for a whole segment; models named qwen may get their own template."""
    fields = {"section_title": F.col("section_title"), "paragraph": shown("paragraph", chars)}
    usual = fill(standard, fields)
    if for_qwen is None:
        return usual
    return F.when(F.lower("model").contains("qwen"), fill(for_qwen, fields)).otherwise(usual)


def judge_prompt(template: str, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS), chars: int | None = None) -> Column:
    """Prompt for the judge: segment, first verdict and its nine answers."""
    answers = F.array_join(
        F.transform(
            F.array(*[F.lit(q) for q in questions]),
            lambda q: F.concat(F.lit("  "), q, F.lit(": "), F.coalesce(F.try_element_at(F.col("answers"), q), F.lit("non"))),
        ),
        "\n",
    )
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    return fill(
        template,
        {
            "section_title": F.col("section_title"),
            "paragraph": shown("paragraph", chars),
            "raisonnement": text("raisonnement", ""),
            "categorie_proposee": text("categorie", "Description"),
            "confiance": text("confiance", "0.5"),
            "reponses_str": answers,
        },
    )


# --- providers -------------------------------------------------------------------

RAW_SCHEMA = "raw string, tok_in int, tok_out int, duration_s double, erreur string"
Ask = Callable[[pd.DataFrame], pd.DataFrame]
#: Calls that a provider gets at once.
PER_ASK = 500


def ask_external(calls: DataFrame, ask: Callable[[], Ask], keep: Sequence[str] | None = None) -> DataFrame:
    """Answer calls with user code, batch by batch.

    ``calls`` carries the messages, see ``with_prompts``.  The result has the columns of ``keep``, all by default,
    and the reply; what isn't kept doesn't come back from Python.
    ``ask()`` runs once per task and returns a function from a batch of calls to
    a frame with the columns of ``RAW_SCHEMA``, row for row.  If a batch of calls
    raises, its calls are asked one by one, and those that raise again become
    error rows.  A reply with other columns or another number of rows is a
    fault of the provider and fails the job.  Write the result to a table
    before using it twice, or the calls are asked twice.  Spark's batches are handed
    on in parts of ``PER_ASK`` calls, so that few prompts are Python objects at one time.
    """
    replies = StructType.fromDDL(RAW_SCHEMA)
    names = replies.names
    kept = calls.columns if keep is None else list(keep)

    schema = to_arrow_schema(replies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = ask()

        def asked(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                found = answer(batch)
            except Exception as e:
                if len(batch) > 1:
                    return pd.concat([asked(batch.iloc[[i]]) for i in range(len(batch))])
                return pd.DataFrame({"raw": [None], "tok_in": 0, "tok_out": 0, "duration_s": 0.0, "erreur": str(e)})
            if len(found) != len(batch) or not set(names) <= set(found.columns):
                raise ValueError(f"a provider returned {len(found)} rows of {list(found.columns)} for {len(batch)} calls")
            return found[names]

        for batch in batches:
            for at in range(0, batch.num_rows, PER_ASK):
                part = batch.slice(at, PER_ASK)
                found = pa.RecordBatch.from_pandas(asked(part.to_pandas()), schema=schema, preserve_index=False)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *found.columns], names=[*kept, *names])

    return calls.mapInArrow(run, StructType([calls.schema[c] for c in kept] + replies.fields))


def answer_from_recorded(calls: DataFrame, responses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Answer calls from a table of recorded replies; a missing reply is an error."""
    joined = calls.join(responses, list(on), "left")
    missing = F.col("raw").isNull() & F.col("erreur").isNull()
    return joined.withColumn("erreur", F.when(missing, parse.EMPTY).otherwise(F.col("erreur"))).fillna(
        0, ["tok_in", "tok_out"]
    )


def answers_from_recorded(calls: DataFrame, responses: DataFrame, on: Sequence[str], strict: bool = False) -> DataFrame:
    """``read_answers`` over ``answer_from_recorded`` without ``raw``.

    A reply that many calls share is read once, and its text isn't moved to them.
    """
    empty = F.when(F.col("raw").isNull(), parse.EMPTY)
    answers = read_answers(responses.withColumn("erreur", F.coalesce("erreur", empty)), strict)
    read = answers.select(*on, "answer", "tok_in", "tok_out", "erreur", F.lit(True).alias("_found"))
    joined = calls.join(read, list(on), "left")
    return joined.withColumns(
        {
            "answer": F.coalesce("answer", F.lit("non")),
            "erreur": F.when(F.col("_found").isNull(), parse.EMPTY).otherwise(F.col("erreur")),
        }
    ).fillna(0, ["tok_in", "tok_out"]).drop("_found")


def answer_by_rules(calls: DataFrame, patterns: Mapping[str, str], text: str = "phrase") -> DataFrame:
    """Answer with one regular expression per question, no model involved."""
    hit = F.lit(False)
    for q, pattern in patterns.items():
        hit = F.when(F.col("question_key") == q, F.col(text).rlike(pattern)).otherwise(hit)
    return calls.withColumn("answer", F.when(hit, "oui").otherwise("non")).withColumns(
        {"tok_in": F.lit(0), "tok_out": F.lit(0), "duration_s": F.lit(0.0), "erreur": F.lit(None).cast("string")}
    )


def read_answers(replied: DataFrame, strict: bool = False) -> DataFrame:
    """Turn raw replies into answers; a failed call stays as "non" with its error.

    ``strict`` reads replies the way paragraph calls are read.
    """
    reply = (parse.yes_no_strict if strict else parse.yes_no)(F.col("raw"))
    ok = F.col("erreur").isNull()
    return (
        replied.withColumn("_reply", F.when(ok, reply))
        .withColumns(
            {
                "answer": F.coalesce("_reply.answer", F.lit("non")),
                "erreur": F.coalesce("erreur", "_reply.erreur"),
            }
        )
        .withColumns({c: F.when(F.col("erreur").isNull(), F.col(c)).otherwise(0).cast("int") for c in ("tok_in", "tok_out")})
        .drop("_reply")
    )


def call_costs(calls: DataFrame) -> DataFrame:
    """Cost of every call in dollars and euros, 10 digits."""
    return calls.withColumns({"cost_usd": usd(cost_units(), 10), "cost_eur": eur(cost_units(), 10)})


# --- incremental runs ------------------------------------------------------------


def pending(units: DataFrame, done: DataFrame, file_key: Sequence[str] = tuple(vocab.FILE_KEY)) -> DataFrame:
    """Units of files that have no result yet."""
    return units.join(done.select(*file_key).distinct(), list(file_key), "left_anti")


def with_cached(fresh: DataFrame, done: DataFrame) -> DataFrame:
    """Fresh and cached results together, missing columns null."""
    return fresh.unionByName(done, allowMissingColumns=True)


def first_results(results: DataFrame, order: Sequence[str], key: Sequence[str] = tuple(vocab.PHRASE_KEY)) -> DataFrame:
    """The first result of each key in ``order`` (source path, then position).

    The row of the least order, so many copies of one key shrink before the
    exchange instead of meeting in one window.  Rows may hold maps.
    """
    rest = [c for c in results.columns if c not in key]
    first = results.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*key, "r.*").select(*results.columns)
