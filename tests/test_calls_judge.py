from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions import parse
from sentivote.operators import calls, judge


@pytest.mark.parametrize(
    "raw, answer, failed",
    [
        ('{"reponse": "oui"}', "oui", False),
        ('```json\n{"reponse": " YES "}\n```', "oui", False),
        ('{"reponse": true}', "oui", False),
        ('{"reponse": 1}', "oui", False),
        ('{"reponse": 1.0}', "non", False),
        ('{"reponse": null}', "non", False),
        ("{}", "non", False),
        ("Bien sûr, OUI.", "oui", False),
        ("", "non", False),
        ('["oui"]', "non", True),
        ('"oui"', "non", True),
    ],
)
def test_yes_no(one, raw, answer, failed):
    r = one(parse.yes_no, c=raw)
    assert (r["answer"], r["erreur"] is not None) == (answer, failed)


@pytest.mark.parametrize(
    "raw, answer, failed",
    [
        ('Voici {"reponse": "oui"} fin', "oui", False),
        ('{"reponse": " oui"}', "non", False),
        ("oui", "non", True),
        ("{a} {b}", "non", True),
        ("[1]", "non", True),
    ],
)
def test_yes_no_strict(one, raw, answer, failed):
    r = one(parse.yes_no_strict, c=raw)
    assert (r["answer"], r["erreur"] is not None) == (answer, failed)


@pytest.mark.parametrize(
    "conf, want",
    [("0.3", 0.3), ("7", 1.0), ("-1", 0.0), ('"0.4"', 0.4), ('"x"', 0.5), ("null", 0.5), ('"NaN"', 1.0), ("true", 1.0)],
)
def test_confidence(one, conf, want):
    r = one(parse.prediction, c='{"categorie": "notoriété", "confiance": %s}' % conf)
    assert (r["categorie"], r["confiance"]) == ("Notoriete", want) and not math.isnan(r["confiance"])


def test_prediction_answers_and_failure(one):
    r = one(parse.prediction, c='{"categorie": "x", "reponses_questions": {"not_1": "Yes", "obl_2": "peut-être"}}')
    assert (r["categorie"], r["confiance"], r["justification"]) == ("Description", 0.5, "")
    assert [k for k, v in r["answers"].items() if v == "oui"] == ["notoriete_1"]
    bad = one(parse.prediction, c="rien")
    assert (bad["categorie"], bad["confiance"], set(bad["answers"].values())) == ("Description", 0.0, {"non"})
    assert bad["erreur"]


def test_chat_content(one):
    full = '{"choices": [{"message": {"content": " a ", "reasoning": "b"}}], "usage": {"prompt_tokens": 3}}'
    assert tuple(one(parse.content_and_usage, c=full)) == ("a", 3, 0, None)
    assert one(parse.content_and_usage, c='{"choices": [{"message": {"content": "", "reasoning": "b"}}]}')["raw"] == "b"
    assert one(parse.content_and_usage, c='{"choices": [{"message": {}}]}')["erreur"] == parse.EMPTY


def test_prompt_leaves_braces_of_the_text_alone(spark):
    df = spark.createDataFrame([("a {question_text} {{b}}", "roi_1")], "phrase string, question_key string")
    prompt = df.select(calls.phrase_prompt()).first()[0]
    assert prompt.startswith('Phrase : "a {question_text} {{b}}"\n\nQuestion : La phrase évoque')
    assert prompt.endswith('{"reponse": "oui"} ou {"reponse": "non"}')


def test_context_is_cut_for_the_prompt(spark):
    df = spark.createDataFrame([("§" * 2000, "p", "roi_1")], "full_paragraph string, phrase string, question_key string")
    prompt = df.select(calls.paragraph_prompt(chars=1200)).first()[0]
    assert prompt.count("§") == 1200


def test_qwen_gets_its_own_template(spark):
    df = spark.createDataFrame([("t", "p" * 900, "Qwen/x"), ("t", "p", "y")], "section_title string, paragraph string, model string")
    rows = df.select(calls.segment_prompt("S {section_title} {paragraph}", "Q {paragraph}", chars=800)).collect()
    assert [r[0] for r in rows] == ["Q " + "p" * 800, "S t p"]


def test_judge_prompt_lists_the_answers(spark):
    df = spark.createDataFrame(
        [("t", "p" * 700, "why", "ROI", 0.5, {"roi_1": "oui"})],
        "section_title string, paragraph string, raisonnement string, categorie string, confiance double, answers map<string,string>",
    )
    got = df.select(calls.judge_prompt("{paragraph}|{raisonnement}|{categorie_proposee}|{confiance}|{reponses_str}", ["roi_1", "obl_1"], chars=600)).first()[0]
    assert got == "p" * 600 + "|why|ROI|0.5|  roi_1: oui\n  obl_1: non"


def units(spark, n=3):
    return spark.createDataFrame([("c", "f", i, f"phrase {i}") for i in range(n)], "source_folder string, source_file string, phrase_index int, phrase string")


def test_a_failing_provider_yields_error_rows(spark):
    def ask():
        def answer(batch: pd.DataFrame) -> pd.DataFrame:
            raise RuntimeError("no network")

        return answer

    planned = calls.call_plan(units(spark), ["roi_1"], ["m"])
    rows = calls.read_answers(calls.ask_external(planned, ask)).collect()
    assert len(rows) == 3
    assert {(r["answer"], r["tok_in"], r["erreur"]) for r in rows} == {("non", 0, "no network")}


def test_plan_asks_everything_once(spark):
    planned = calls.call_plan(units(spark))
    assert planned.count() == 3 * 45
    assert planned.select("phrase_index", "question_key", "model").distinct().count() == 135


def test_rerun_has_nothing_to_do(spark):
    u = units(spark)
    assert calls.pending(u, u.limit(0)).count() == 3
    assert calls.pending(u, u).count() == 0
    assert calls.with_cached(u.limit(0), u.drop("phrase")).count() == 3


def test_first_result_wins(spark):
    df = spark.createDataFrame(
        [("c", "f", 0, "b", 0, "late"), ("c", "f", 0, "a", 1, "early"), ("c", "f", 0, "a", 2, "early2"), ("d", "f", 0, "z", 0, "other")],
        "source_folder string, source_file string, phrase_index int, source_path string, pos int, categorie string",
    )
    rows = calls.first_results(df, ["source_path", "pos"]).collect()
    assert sorted(r["categorie"] for r in rows) == ["early", "other"]


def test_rules_answer_without_a_model(spark):
    answered = calls.answer_by_rules(calls.call_plan(units(spark), ["roi_1", "obl_1"], ["m"]), {"roi_1": "1$"})
    assert sorted((r["phrase_index"], r["question_key"]) for r in answered.filter("answer = 'oui'").collect()) == [(1, "roi_1")]


# --- judge ----------------------------------------------------------------------------


def segments(spark):
    return spark.createDataFrame(
        [("c", "f", 0, "ROI", 0.9), ("c", "f", 1, "ROI", 0.9), ("c", "g", 2, "Description", 0.1), ("c", "g", 3, "ROI", 0.1)],
        "source_folder string, source_file string, paragraph_index int, categorie_cot string, confiance_cot double",
    )


def truth(spark):
    return spark.createDataFrame(
        [(" f ", " 0", "Obligation", 0), ("f", "0", " ROI ", 1), ("f", "un", "ROI", 2), ("g", "2", "ROI", 3)],
        "source_file string, paragraph_index string, category string, ord long",
    )


def test_ground_truth_last_row_wins_and_bad_index_is_skipped(spark):
    rows = {r["paragraph_index"]: r["categorie_gt"] for r in judge.match_ground_truth(segments(spark), truth(spark)).collect()}
    assert rows == {0: "ROI", 1: "N/A", 2: "ROI", 3: "N/A"}
    acc = judge.accuracy(judge.match_ground_truth(segments(spark), truth(spark)), "categorie_cot").first()
    assert tuple(acc) == (2, 1, 50.0)
    none = judge.accuracy(judge.match_ground_truth(segments(spark), truth(spark).limit(0)), "categorie_cot").first()
    assert tuple(none) == (0, 0, 0.0)


def test_numeric_index_is_truncated(spark):
    gt = spark.createDataFrame([("f", 1.0, "ROI", 0), ("g", float("nan"), "ROI", 1)], "source_file string, paragraph_index double, category string, ord long")
    rows = judge.match_ground_truth(segments(spark), gt).filter("categorie_gt <> 'N/A'").collect()
    assert [r["paragraph_index"] for r in rows] == [1]


def test_verdict_defaults_and_report(spark):
    verdicts = spark.createDataFrame(
        [("c", "f", 0, True, "ROI", 0.8, "j", "k"), ("c", "g", 2, None, "ROI", None, None, None)],
        "source_folder string, source_file string, paragraph_index int, accord boolean, categorie_juge string, "
        "confiance_juge double, justification_juge string, analyse_critique string",
    )
    judged = judge.match_ground_truth(judge.merge_verdicts(segments(spark), verdicts), truth(spark))
    rows = {r["paragraph_index"]: r for r in judged.collect()}
    assert (rows[1]["accord_avec_modele"], rows[1]["categorie_juge"], rows[1]["confiance_juge"], rows[1]["justification_juge"]) == (False, "ROI", 0.0, "")
    assert (rows[2]["accord_avec_modele"], rows[2]["categorie_juge"]) == (False, "ROI")
    report = judge.judge_report(judged).first().asDict()
    assert report == {
        "total": 4, "n_accords": 1, "n_desaccords": 3, "pct_accords": 25.0, "pct_desaccords": 75.0,
        "n_gt": 2, "accuracy_cot": 50.0, "accuracy_juge": 100.0, "delta_points": 50.0,
    }


def test_custom_question_text_is_used(spark):
    own = [vocab.Question("roi_1", "ROI", "Pourquoi ?")]
    df = spark.createDataFrame([("roi_1",)], "question_key string")
    assert df.select(calls.question_text(F.col("question_key"), own)).first()[0] == "Pourquoi ?"
