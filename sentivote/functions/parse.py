"""Reading model replies: yes/no answers and structured predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.text import WS, let, strip

INVALID = "JSON invalide"
NOT_AN_OBJECT = "réponse JSON sans objet"
EMPTY = "Réponse vide"


def without_fences(raw: Column) -> Column:
    """Drop a code fence around the whole reply."""
    opened = F.regexp_replace(raw, rf"(?d)^```(?:json)?{WS}*", "")
    return strip(F.regexp_replace(opened, rf"(?d){WS}*```$", ""))


def outer_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, empty when there is no such span."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _yes(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("non")).isin(vocab.YES_WORDS), "oui").otherwise("non")


def _field(v: Column, name: str) -> Column:
    """Lower-cased text of a field; a fraction such as 1.0 keeps its point."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = F.lower(F.try_variant_get(v, f"$.{name}", "string"))
    return F.when(kind.startswith("DECIMAL") | kind.startswith("DOUBLE"), F.concat(text, F.lit("."))).otherwise(text)


def _reply(answer: Column, erreur: Column) -> Column:
    return F.struct(answer.alias("answer"), erreur.alias("erreur"))


def yes_no(raw: Column) -> Column:
    """Answer of a phrase call: struct (answer, erreur).

    A JSON object gives its ``reponse``; text that is no JSON says yes when it
    contains "oui"; JSON that is no object is an error and counts as "non".
    """

    def read(text: Column) -> Column:
        return let(
            F.try_parse_json(text),
            lambda v: F.when(
                v.isNull(),
                _reply(
                    F.when(F.lower(text).contains("oui"), "oui").otherwise("non"), F.lit(None).cast("string")
                ),
            )
            .when(_is_object(v), _reply(_yes(strip(_field(v, "reponse"))), F.lit(None).cast("string")))
            .otherwise(_reply(F.lit("non"), F.lit(NOT_AN_OBJECT))),
        )

    return let(without_fences(raw), read)


def json_object(raw: Column) -> Column:
    """The reply as a variant object; else from its first to its last brace; else null."""

    def read(text: Column) -> Column:
        return let(
            F.try_parse_json(text),
            lambda v: F.when(v.isNotNull(), v).otherwise(F.try_parse_json(outer_braces(text))),
        )

    return let(without_fences(raw), read)


def yes_no_strict(raw: Column) -> Column:
    """Answer of a paragraph call: struct (answer, erreur), JSON required.

    The value is compared without stripping.
    """
    return let(
        json_object(raw),
        lambda v: F.when(v.isNull(), _reply(F.lit("non"), F.lit(INVALID)))
        .when(_is_object(v), _reply(_yes(_field(v, "reponse")), F.lit(None).cast("string")))
        .otherwise(_reply(F.lit("non"), F.lit(NOT_AN_OBJECT))),
    )


def canonical_category(name: Column) -> Column:
    """Map a category name to the shared vocabulary; unknown is Description."""
    known = F.create_map(*[c for k, v in vocab.CATEGORY_ALIASES.items() for c in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, F.upper(name)), F.lit("Description"))


def confidence(v: Column, name: str = "confiance") -> Column:
    """Confidence clamped to [0, 1]; 0.5 when missing or unreadable; NaN counts as 1."""
    value = F.coalesce(F.try_variant_get(v, f"$.{name}", "double"), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def canonical_question(key: Column) -> Column:
    """Map a short question key such as ``not_1`` to the shared vocabulary."""
    return F.regexp_replace(F.lower(key), "^not_", "notoriete_")


def _question_field(v: Column, name: str, question: str) -> Column:
    short = question.replace("notoriete_", "not_")
    found = _field(v, f"{name}.{question}")
    return found if short == question else F.coalesce(found, _field(v, f"{name}.{short}"))


def answers_map(v: Column, name: str = "reponses_questions", questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> Column:
    """All questions answered oui or non, missing ones non."""
    return F.map_from_arrays(
        F.array(*[F.lit(q) for q in questions]), F.array(*[_yes(_question_field(v, name, q)) for q in questions])
    )


def prediction(raw: Column, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> Column:
    """Structured reply: (categorie, confiance, justification, answers, erreur).

    An unreadable reply becomes Description with confidence 0 and an error.
    """

    def row(cat: Column, conf: Column, why: Column, answers: Column, erreur: Column) -> Column:
        return F.struct(
            cat.alias("categorie"), conf.alias("confiance"), why.alias("justification"),
            answers.alias("answers"), erreur.alias("erreur"),
        )

    def failed(reason: str) -> Column:
        return row(
            F.lit("Description"), F.lit(0.0), F.lit(""),
            F.map_from_arrays(F.array(*[F.lit(q) for q in questions]), F.array(*[F.lit("non") for _ in questions])),
            F.lit(reason),
        )

    return let(
        json_object(raw),
        lambda v: F.when(v.isNull(), failed(INVALID))
        .when(
            _is_object(v),
            row(
                canonical_category(F.try_variant_get(v, "$.categorie", "string")),
                confidence(v),
                F.coalesce(F.try_variant_get(v, "$.justification", "string"), F.lit("")),
                answers_map(v, questions=questions),
                F.lit(None).cast("string"),
            ),
        )
        .otherwise(failed(NOT_AN_OBJECT)),
    )


def content_and_usage(response: Column) -> Column:
    """Chat response JSON: struct (raw, tok_in, tok_out, erreur).

    The content, else the reasoning; neither is an error.  Missing token counts
    are 0.
    """

    def read(v: Column) -> Column:
        text = lambda f: F.nullif(strip(F.try_variant_get(v, f"$.choices[0].message.{f}", "string")), F.lit(""))
        count = lambda f: F.coalesce(F.try_variant_get(v, f"$.usage.{f}", "int"), F.lit(0))
        raw = F.coalesce(text("content"), text("reasoning"))
        return F.struct(
            raw.alias("raw"),
            F.when(raw.isNull(), 0).otherwise(count("prompt_tokens")).alias("tok_in"),
            F.when(raw.isNull(), 0).otherwise(count("completion_tokens")).alias("tok_out"),
            F.when(raw.isNull(), EMPTY).alias("erreur"),
        )

    return let(F.try_parse_json(response), read)
