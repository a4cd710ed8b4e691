"""Whole runs: one call from inputs to the named report tables of a stage.

Each function returns tables by name; ``sources.files.write_report`` stores them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from sentivote import vocab
from sentivote.operators import ballots as B
from sentivote.operators.answer_store import AnswerStore, ask_once
from sentivote.operators import calls, clean, ensemble, judge, report, segment, sensitivity, vote
from sentivote.sources import files

MODELS = tuple(m.name for m in vocab.MODELS)
Tables = dict[str, DataFrame]


def answered_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Folder and file of the answers at ``path``, or None if there are none yet."""
    try:
        return spark.read.schema("source_folder string, source_file string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def asked_once(units: DataFrame, provider: Callable[[], calls.Ask], prompt: Column, system: str, path: str,
               models: Sequence[str] = MODELS, store: AnswerStore | None = None) -> DataFrame:
    """Answers of all ``units``, kept at ``path``: files that have answers there aren't asked again.

    New answers are appended, so a run can be resumed and a folder can grow.  Each call is made once.  With a
    ``store``, calls with equal messages are one call, and what any run with that store has asked isn't asked again.
    """
    spark = units.sparkSession
    done = answered_files(spark, path)
    todo = units if done is None else calls.pending(units, done)
    plan = calls.with_prompts(calls.call_plan(todo, models=models), prompt, system)
    replied = calls.ask_external(plan, provider) if store is None else ask_once(plan, store, provider).drop("reused")
    answers = calls.read_answers(replied).drop("system", "prompt", "raw")
    files.write_dataset(answers, path, mode="append")
    return spark.read.schema(answers.schema).parquet(path)


def phrase_reports(answers: DataFrame, texts: DataFrame, models: Sequence[str] = MODELS) -> Tables:
    """Reports of phrase mode.  ``answers`` is a written table, as every report reads it."""
    classified = vote.classify(answers)
    votes = B.ballots(answers, models, with_cost=True)
    return {
        "phrases": report.phrase_rows(classified),
        "phrases_modeles": report.wide_phrases(answers, models),
        "reponses": B.compact_answers(votes, models),
        "fichiers": report.file_summary(classified),
        "modeles": report.model_stats(answers, models),
        "couts": report.file_costs(answers),
        "accord_questions": report.question_agreement(vote.unanimity(vote.tally(answers))),
        "accord_phrases": report.agreement_per_phrase(classified, texts),
        "categories": report.category_distribution(classified),
        "global": report.global_stats(classified, models),
        "liste": report.flat_listing(classified, texts),
        "tenseur": B.tensor_coo(votes, models),
        "tenseur_phrases": B.phrase_axis(texts),
        "tenseur_modeles": B.model_axis(answers.sparkSession, models),
        "tenseur_questions": B.question_axis(answers.sparkSession),
    }


def phrase_run(spark: SparkSession, folder: str, provider: Callable[[], calls.Ask], path: str, system: str = "",
               models: Sequence[str] = MODELS) -> Tables:
    """Markdown files below ``folder`` to the reports of phrase mode; phrases and answers are kept below ``path``."""
    docs = clean.clean_documents(files.markdown_files(spark, folder)).select("source_folder", "source_file", "text")
    found = segment.phrases_flat(docs)
    files.write_dataset(found, f"{path}/phrases")
    phrases = spark.read.schema(found.schema).parquet(f"{path}/phrases")
    answers = asked_once(phrases, provider, calls.phrase_prompt(), system, f"{path}/answers", models)
    return phrase_reports(answers.drop("phrase"), phrases.select(*vocab.PHRASE_KEY, "phrase"), models)


def sensitivity_reports(predictions: DataFrame, segments: DataFrame, answers: DataFrame, models: Sequence[str] = MODELS) -> Tables:
    """Weighted vote, subsets and labelled dataset of segments."""
    folded = sensitivity.fold(predictions, models)
    subsets = sensitivity.leave_k_out(folded, models)
    rates = sensitivity.change_rates(subsets)
    dataset = sensitivity.labelled_dataset(segments, folded, vote.classify(answers, vocab.SEGMENT_KEY), models)
    return {
        "votes": sensitivity.weighted_labels(folded, models),
        "taux": rates,
        "stabilite": sensitivity.stability(rates),
        "rapport": sensitivity.stability_report(rates),
        "combinaisons": sensitivity.top_combinations(subsets, models),
        "dataset": dataset,
        "fichiers": sensitivity.file_synthesis(dataset),
        "instables": sensitivity.unstable(dataset),
    }


def ensemble_reports(
    answers: DataFrame, models: Sequence[str], texts: DataFrame | None = None, key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    ensembles: Mapping[str, Sequence[str]] = vocab.ENSEMBLES, reference: str = vocab.REFERENCE_ENSEMBLE,
) -> Tables:
    """Comparison of ensembles of models with a reference ensemble."""
    pairs = ensemble.pairs(B.ballots(answers, models, key), models, ensembles, reference, key)
    matches = ensemble.concordance(pairs, ensembles, reference)
    changed = ensemble.question_divergence(pairs)
    return {
        "concordance": matches,
        "classes": ensemble.concordance_by_class(pairs),
        "questions": changed,
        "divergents": ensemble.divergent_segments(pairs, key, texts),
        "influence": ensemble.model_influence(matches),
        "sensibilite": ensemble.question_sensitivity(changed),
        "instables": ensemble.unstable_segments(pairs, key, ensembles, reference, texts),
        "stables": ensemble.stable_segments(pairs, key, texts),
        "resume": ensemble.stability_headline(pairs, key),
        "vue_globale": ensemble.global_view(pairs, ensembles, reference),
    }


def judge_reports(segments: DataFrame, verdicts: DataFrame, truth: DataFrame) -> Tables:
    """A second model's verdicts on the first one's labels, and both against the truth.

    ``segments`` holds key, section title, paragraph, ``categorie_cot`` and ``confiance_cot``.
    """
    judged = judge.match_ground_truth(judge.merge_verdicts(segments, verdicts), truth)
    return {
        "rapport": judge.judge_report(judged),
        "precision": judge.accuracy(judged, "categorie_cot"),
        "detail": judge.judge_detail(judged),
    }
