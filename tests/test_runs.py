"""Whole runs over a small folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.operators import judge
from sentivote.plans import fixtures as fx
from sentivote.plans import queries, runs
from sentivote.sources import files

MODELS = runs.MODELS[:3]


def provider(counter):
    def load():
        def answer(batch):
            counter.add(len(batch))
            out = batch[[]].copy()
            out["raw"] = (batch["prompt"].str.len() % 2).map({0: '{"reponse": "oui"}', 1: '{"reponse": "non"}'})
            out["tok_in"], out["tok_out"], out["duration_s"], out["erreur"] = 5, 1, 0.5, None
            return out

        return answer

    return load


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for folder in ("c1", "2024"):
        (root / folder).mkdir(parents=True)
        (root / folder / "a.md").write_text("# Titre\n\nUne phrase assez longue pour rester. Une autre phrase la suit ici.\n", encoding="utf-8")
    return root


def test_phrase_run_can_be_resumed(spark, corpus, tmp_path):
    out, asked = str(tmp_path / "out"), spark.sparkContext.accumulator(0)
    tables = runs.phrase_run(spark, str(corpus), provider(asked), out, models=MODELS)
    n = tables["phrases"].count()
    assert n == 4 or n == 6
    assert asked.value == n * len(MODELS) * 9
    files.write_report(tables, f"{out}/report")
    assert asked.value == n * len(MODELS) * 9  # reports read what was written
    assert {r["source_folder"] for r in spark.read.parquet(f"{out}/report/fichiers").collect()} == {"c1", "2024"}
    (corpus / "c1" / "b.md").write_text("Encore une phrase, dans un autre fichier.\n", encoding="utf-8")
    again = runs.phrase_run(spark, str(corpus), provider(asked), out, models=MODELS)
    m = again["phrases"].count()
    assert m > n and asked.value == m * len(MODELS) * 9
    assert again["tenseur_phrases"].count() == m


def test_reports_of_recorded_answers(spark, sf):
    models = fx.ENSEMBLE_MODELS
    tables = runs.ensemble_reports(fx.votes(spark, sf, models), models, fx.unit_texts(spark, sf))
    assert tables["resume"].first()["n_total"] == fx.units(spark, sf).count()
    assert "phrase" in tables["divergents"].columns
    tables = runs.sensitivity_reports(
        fx.predictions(spark, sf), queries._segment_texts(spark, sf), queries._segment_votes(spark, sf), fx.ANSWER_MODELS)
    assert set(tables) >= {"votes", "rapport", "dataset", "instables"} and tables["dataset"].count() == fx.units(spark, sf).count()
    first = fx.predictions(spark, sf, fx.ANSWER_MODELS[:1]).select(
        *vocab.SEGMENT_KEY, F.col("categorie").alias("categorie_cot"), F.col("confiance").alias("confiance_cot"))
    tables = runs.judge_reports(first.join(queries._segment_texts(spark, sf), list(vocab.SEGMENT_KEY)), fx.verdicts(spark, sf), fx.ground_truth(spark, sf))
    assert tables["rapport"].count() == 1 and tables["detail"].count() == fx.units(spark, sf).count()


def test_the_last_row_of_the_truth_counts_in_file_order(spark, tmp_path):
    for n, label in enumerate(("ROI", "Obligation", "Notoriete")):
        rows = "".join(f"{i},a.md,{label}\n" for i in range(2000 - 900 * n))
        (tmp_path / f"{n}.csv").write_text("paragraph_index,source_file,category\n" + rows, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        units = spark.range(2000).select(F.lit("c").alias("source_folder"), F.lit("a.md").alias("source_file"), F.col("id").cast("int").alias("paragraph_index"))
        got = judge.match_ground_truth(units, files.read_ground_truth(spark, str(tmp_path)))
        counts = {r["categorie_gt"]: r["count"] for r in got.groupBy("categorie_gt").count().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == {"Notoriete": 200, "Obligation": 900, "ROI": 900}
