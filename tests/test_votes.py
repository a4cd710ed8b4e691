from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.operators import ballots as B
from sentivote.operators import ensemble, report, sensitivity, vote
from sentivote.plans import fixtures as fx

CALLS = "source_folder string, source_file string, phrase_index int, model string, question_key string, answer string, tok_in int, tok_out int, duration_s double, erreur string"
M = [m.name for m in vocab.MODELS]


def calls(spark, *rows):
    """Rows of (unit, model number, question, answer); answer ERR is a failed call."""
    data = [
        ("c", "f", u, M[m], q, "non" if a == "ERR" else a, 0 if a == "ERR" else 100, 0 if a == "ERR" else 10, 0.5,
         "timeout" if a == "ERR" else None)
        for u, m, q, a in rows
    ]
    return spark.createDataFrame(data, CALLS)


def long(spark, df):
    return {(r["phrase_index"], r["question_key"]): r for r in vote.per_question(vote.tally(df)).collect()}


def test_majority_cases(spark):
    df = calls(
        spark,
        *[(0, m, "roi_1", a) for m, a in enumerate(["oui", "oui", "non", "non"])],  # tie
        *[(0, m, "roi_2", "ERR") for m in range(5)],  # no valid vote
        (0, 0, "roi_3", "oui"), *[(0, m, "roi_3", "ERR") for m in range(1, 5)],  # one valid vote
        *[(0, m, "obl_1", a) for m, a in enumerate(["oui", "oui", "oui", "non", "ERR"])],
    )
    rows = long(spark, df)
    get = lambda q: (rows[0, q]["answer"], rows[0, q]["agreement"])
    assert get("roi_1") == ("non", 0.5)
    assert get("roi_2") == ("non", 0.5)
    assert get("roi_3") == ("oui", 0.5)
    assert get("obl_1") == ("oui", 0.75)
    assert get("notoriete_1") == ("non", 0.5)


def test_errors_can_count_as_no(spark):
    df = calls(spark, (0, 0, "roi_1", "oui"), (0, 1, "roi_1", "ERR"))
    assert vote.classify(df).first()["categorie"] == "ROI"
    assert vote.classify(df, errors_as_no=True).first()["categorie"] == "Description"


@pytest.mark.parametrize(
    "roi, noto, obl, want",
    [(0, 0, 0, "Description"), (1, 1, 1, "ROI"), (0, 2, 2, "Obligation"), (1, 3, 2, "Notoriete"), (0, 1, 0, "Notoriete")],
)
def test_label_priority(one, roi, noto, obl, want):
    assert one(vote.label, r=roi, n=noto, o=obl) == want


def test_costs_with_known_and_default_price(spark):
    df = calls(spark, (0, 0, "roi_1", "oui"))
    assert vote.classify(df).first()["cost_usd_phrase"] == pytest.approx((100 * 0.10 + 10 * 0.32) / 1e6)
    other = df.withColumn("model", F.lit("someone/else"))
    row = vote.classify(other).first()
    assert row["cost_usd_phrase"] == pytest.approx(110 * 0.10 / 1e6)
    assert row["cost_eur_phrase"] == pytest.approx(110 * 0.10 / 1e6 / 1.08, abs=1e-7)


def test_unanimity_leaves_single_votes_out(spark):
    df = calls(spark, (0, 0, "roi_1", "oui"), (0, 1, "roi_1", "oui"), (1, 0, "roi_1", "oui"), (1, 1, "roi_1", "ERR"),
               (2, 0, "roi_1", "oui"), (2, 1, "roi_1", "non"))
    rows = {r["question_key"]: r for r in vote.unanimity(vote.tally(df)).collect()}
    assert (rows["roi_1"]["n_comparaisons"], rows["roi_1"]["n_unanimes"], rows["roi_1"]["taux"]) == (2, 1, 0.5)
    assert rows["obl_1"]["taux"] == 0.0


def test_votes_do_not_depend_on_order_or_partitions(spark, sf):
    df = fx.votes(spark, sf)
    a = vote.classify(df).drop("duration_ticks").collect()
    b = vote.classify(df.orderBy(F.rand(3)).repartition(7)).drop("duration_ticks").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_tensor_counts_the_valid_yes_answers(spark, sf):
    df = fx.votes(spark, sf)
    coo = B.tensor_coo(B.ballots(df, M), M)
    assert coo.count() == df.filter("answer = 'oui' and erreur is null").count()
    shape = B.tensor_shape(B.ballots(df, M), M).first()
    top = coo.agg(F.max("client_pos"), F.max("phrase_pos"), F.max("model_pos"), F.max("question_pos")).first()
    assert all(t < s for t, s in zip(top, shape))


def test_wide_cells_show_missing_and_failed_calls(spark):
    row = report.wide_phrases(calls(spark, (0, 0, "roi_1", "oui"), (0, 1, "roi_1", "ERR")), M).first()
    assert row["llama-3.3-70b-instruct__roi_1"] == "oui"
    assert row["gemma-3-27b-it__roi_1"] == "ERR"
    assert row["mistral-nemo__roi_1"] == "?"
    assert row["ROI_Score"] == "1/3"


def test_reports_on_an_empty_corpus(spark):
    empty = vote.classify(calls(spark).limit(0))
    assert {(r[0], r[1], r[2]) for r in report.category_distribution(empty).collect()} == {(c, 0, 0.0) for c in vocab.CATEGORIES}
    row = report.global_stats(empty, M).first()
    assert (row["total_phrases"], row["cout_total_usd"], row["cout_phrase_eur"]) == (0, 0.0, 0.0)
    stats = report.model_stats(calls(spark).limit(0), M).collect()
    assert len(stats) == 5 and all(r["nb_appels"] == 0 and r["taux_erreur"] == 0.0 for r in stats)


def test_call_details_hold_all_calls(spark):
    """Repeated calls stay, as they count in the vote."""
    df = calls(spark, (0, 0, "roi_1", "oui"), (0, 1, "roi_1", "ERR"))
    detail = vote.call_details(df.union(df)).first()["detail_appels"]
    assert [(d["model_short"], d["reponse"], d["erreur"]) for d in detail] == [
        *[("gemma-3-27b-it", "non", "timeout")] * 2, *[("llama-3.3-70b-instruct", "oui", None)] * 2
    ]


def test_unlisted_models_fail_by_name_or_are_shown(spark):
    df = calls(spark, (0, 0, "roi_1", "oui"), (0, 1, "roi_1", "oui"))
    for folded_calls in (B.ballots(df, M[:1]), report.wide_phrases(df, M[:1])):
        with pytest.raises(Exception, match=f"not listed: {M[1]}"):
            folded_calls.collect()
    predictions = spark.createDataFrame([("c", "f", 0, "new/model", "ROI", 0.5, None)], PRED)
    with pytest.raises(Exception, match="not listed: new/model"):
        sensitivity.fold(predictions, M).collect()
    assert {r["model"]: r["nb_appels"] for r in report.model_stats(df, M[:1]).collect()} == {M[0]: 1, M[1]: 1}


# --- sensitivity ---------------------------------------------------------------------

PRED = "source_folder string, source_file string, paragraph_index int, model string, categorie string, confiance double, erreur string"


def folded(spark, *preds, models=M):
    """One segment; preds are (category, confidence), or None for a failed model."""
    rows = [("c", "f", 0, models[i], *(("Description", 0.0, "x") if p is None else (*p, None))) for i, p in enumerate(preds)]
    return sensitivity.fold(spark.createDataFrame(rows, PRED), models)


@pytest.mark.parametrize(
    "preds, want",
    [
        ([("ROI", 0.5), ("Obligation", 0.6), ("Obligation", 0.2), None, None], ("Obligation", 0.615)),
        ([("Obligation", 0.5), ("ROI", 0.5), None, None, None], ("Obligation", 0.5)),  # tie: first in model order
        ([None] * 5, ("Description", 0.0)),
        ([("ROI", 0.0), ("Obligation", 0.0), None, None, None], ("ROI", 0.0)),
    ],
)
def test_weighted_vote(spark, preds, want):
    row = sensitivity.weighted_labels(folded(spark, *preds), M).first()
    assert (row["label"], row["confidence"]) == want


def test_every_subset_survives_even_with_failed_members(spark):
    df = folded(spark, ("ROI", 1.0), None, None, None, None)
    subsets = sensitivity.leave_k_out(df, M)
    rows = subsets.collect()
    assert len(rows) == 30
    assert {r["subset_id"] for r in rows if not r["changed"]} == {s for s in range(1, 31) if s & 16}
    rates = {r["k"]: r for r in sensitivity.change_rates(subsets).collect()}
    assert [(rates[k]["nb_combinations"], rates[k]["nb_changes"]) for k in (1, 2, 3, 4)] == [(5, 1), (10, 4), (10, 6), (5, 4)]
    score = sensitivity.stability(sensitivity.change_rates(subsets)).first()["stability_score"]
    assert score == 50.0
    assert sensitivity.with_stability(df, M).first()["stability_score"] == score


def test_one_model_has_no_subsets(spark):
    df = folded(spark, ("ROI", 1.0), models=M[:1])
    assert sensitivity.leave_k_out(df, M[:1]).count() == 0
    assert sensitivity.with_stability(df, M[:1]).first()["stability_score"] == 100.0


def test_combinations_are_ranked_with_stable_ties(spark):
    top = sensitivity.top_combinations(sensitivity.leave_k_out(folded(spark, ("ROI", 1.0), None, None, None, None), M), M)
    first = top.filter("k = 4").orderBy("rank").collect()
    assert [r["models_kept"] for r in first][0] == "gemma-3-27b-it"
    assert first[-1]["models_kept"] == "llama-3.3-70b-instruct" and first[-1]["nb_changes"] == 0
    two = top.filter("k = 3").orderBy("rank").first()
    assert two["models_kept"] == "gemma-3-27b-it + mistral-nemo"


# --- ensembles --------------------------------------------------------------------------

ENS = {"ref": M[:3], "alt": M[:2], "gone": ["x/y"]}


def pairs_of(spark, df):
    return ensemble.pairs(B.ballots(df, M), M, ENS, "ref")


def test_ensemble_without_members_falls_back_to_all(spark):
    df = calls(spark, (0, 3, "roi_1", "oui"), (0, 4, "roi_1", "oui"))
    rows = {r["ensemble"]: r for r in ensemble.revote(B.ballots(df, M), M, ENS).collect()}
    assert all((r["n_modeles_actifs"], r["categorie"]) == (0, "ROI") for r in rows.values())


def test_a_prediction_without_an_answer_counts_in_the_vote(spark):
    """Three valid predictions, one of them with roi_1: one oui of three is no majority."""
    df = calls(spark, (0, 0, "roi_1", "oui"), (0, 1, "obl_1", "non"), (0, 2, "obl_1", "non"))
    rows = {r["ensemble"]: r["categorie"] for r in ensemble.revote(B.ballots(df, M), M, ENS | {"one": M[:1]}).collect()}
    assert (rows["ref"], rows["one"]) == ("Description", "ROI")


def test_divergence_and_absent_class(spark):
    df = calls(
        spark,
        *[(0, m, "roi_1", a) for m, a in enumerate(["oui", "non", "oui"])],  # ref oui, alt tie -> non
        *[(1, m, "obl_1", "oui") for m in range(3)],
    )
    p = pairs_of(spark, df).filter("ensemble = 'alt'")
    by_class = {r["categorie"]: (r["n_ref"], r["n_concordants"], r["taux"]) for r in ensemble.concordance_by_class(p).collect()}
    assert by_class == {"ROI": (1, 0, 0.0), "Notoriete": (0, 0, None), "Obligation": (1, 1, 100.0), "Description": (0, 0, None)}
    div = {r["question_key"]: r["taux"] for r in ensemble.question_divergence(p).collect()}
    assert div["roi_1"] == 100.0 and div["obl_1"] == 0.0
    row = ensemble.divergent_segments(p).first()
    assert (row["ref_categorie"], row["alt_categorie"], row["questions_changees"]) == ("ROI", "Description", "roi_1")
    assert (row["ref_scores"], row["alt_scores"]) == ("ROI:1 NOT:0 OBL:0", "ROI:0 NOT:0 OBL:0")
    texts = df.select(*vocab.PHRASE_KEY).distinct().withColumn("phrase", F.concat(F.lit("text "), "phrase_index"))
    assert ensemble.divergent_segments(p, texts=texts).first()["phrase"] == "text 0"
    stable = [r["phrase_index"] for r in ensemble.stable_segments(pairs_of(spark, df)).collect()]
    assert stable == [1]


def test_concordance_of_an_empty_corpus_is_zero(spark):
    rows = ensemble.concordance(pairs_of(spark, calls(spark).limit(0)), ENS, "ref").collect()
    assert {(r["ensemble"], r["n_segments"], r["taux_concordance"]) for r in rows} == {("alt", 0, 0.0), ("gone", 0, 0.0)}
    assert {r["ensemble"]: (r["modeles_retires"], r["modeles_ajoutes"]) for r in rows}["alt"] == ([M[2]], [])


def test_too_many_models_are_refused(spark):
    with pytest.raises(ValueError):
        B.ballots(calls(spark).limit(0), [f"m{i}" for i in range(63)])
