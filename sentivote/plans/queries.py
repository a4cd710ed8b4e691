"""The registered queries: every operator applied to the supplied tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions import text as T
from sentivote.operators import ballots as B
from sentivote.functions import language, parse
from sentivote.operators.answer_store import AnswerStore, ask_units_once
from sentivote.operators import blocks as blocked
from sentivote.operators.call_table import CallTable
from sentivote.operators import boundaries, calls, clean, docstruct, ensemble, judge, report, segment, sensitivity, subset_sums, vote
from sentivote.plans import fixtures as fx
from sentivote.session import shared_path
from sentivote.sources.published import publish_run, read_run
from sentivote.streaming import votes

Query = Callable[[SparkSession, str], DataFrame]
SEG = tuple(vocab.SEGMENT_KEY)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_documents(fx.md_docs(spark, sf)).select("source_folder", "source_file", "text")


def text_queries() -> dict[str, Query]:
    def sentences_merged(spark: SparkSession, sf: str) -> DataFrame:
        blocks = segment.tokens(fx.md_docs(spark, sf)).filter("kind = 'text'")
        return blocks.select(
            "source_folder", "source_file", "tok_pos",
            F.posexplode(segment.sentences(F.col("text"))).alias("sent_pos", "sentence"),
        )

    def model_phrases(spark: SparkSession, sf: str) -> DataFrame:
        """Phrases cut by Python code loaded once per task."""

        def load():
            import re

            end = re.compile(r"(?<=[.!?…])\s+")
            return lambda block, lang: end.split(block)

        return segment.phrases_flat(segment.with_model_pieces(_cleaned(spark, sf), load), segment.model_splitter)

    def abbreviated(spark: SparkSession, sf: str) -> DataFrame:
        docs = clean.clean_documents(fx.md_docs(spark, sf, fx.abbreviated))
        return docs.select("source_folder", "source_file", "text")

    def blocks(docs: DataFrame) -> DataFrame:
        return segment.tokens(docs).where("kind = 'text'").select("text")

    def boundary_words(spark: SparkSession, sf: str) -> DataFrame:
        learnt = boundaries.learn(blocks(abbreviated(spark, sf)))
        return learnt.select("kind", "word", "n", F.round("score", 4).alias("score"))

    def learned_phrases(spark: SparkSession, sf: str) -> DataFrame:
        docs = boundaries.numbered(abbreviated(spark, sf))
        return segment.phrases_flat(*boundaries.learned_splitter(docs, blocks(docs)))

    def clean_blocks(spark: SparkSession, sf: str) -> DataFrame:
        return blocked.clean_blocks(blocked.split_documents(fx.md_docs(spark, sf), 5))

    def documents_of_blocks(spark: SparkSession, sf: str) -> DataFrame:
        """Documents cleaned in blocks, put together again to be compared."""
        parts = F.sort_array(F.collect_list(F.struct("block_no", "text")))
        return clean_blocks(spark, sf).groupBy(*vocab.FILE_KEY).agg(parts.alias("p")).select(
            *vocab.FILE_KEY, F.array_join("p.text", "\n").alias("text")
        )

    return {
        "blocked_documents": documents_of_blocks,
        "blocked_phrases": lambda s, d: blocked.phrases_of_blocks(clean_blocks(s, d)),
        "phrases_by_model": model_phrases,
        "boundary_words": boundary_words,
        "phrases_learned": learned_phrases,
        "clean_lines": lambda s, d: clean.clean_lines(fx.md_docs(s, d)),
        "clean_documents": lambda s, d: clean.clean_documents(fx.md_docs(s, d)),
        "clean_report": lambda s, d: clean.clean_report(clean.clean_documents(fx.md_docs(s, d))),
        "tokens": lambda s, d: segment.tokens(fx.md_docs(s, d)).fillna(0, ["level"]),
        "sentences_merged": sentences_merged,
        "phrases_flat": lambda s, d: segment.phrases_flat(_cleaned(s, d)),
        "paragraphs": lambda s, d: segment.paragraph_phrases(segment.paragraphs(_cleaned(s, d))).fillna(-1, ["phrase_index"]),
        "phrase_counts": lambda s, d: segment.phrase_counts(_cleaned(s, d)),
        "scored_units": lambda s, d: segment.scored_units(segment.paragraphs(_cleaned(s, d))),
        "paragraph_contexts": lambda s, d: segment.paragraph_contexts(segment.paragraphs(_cleaned(s, d))).withColumn(
            "n_units", F.size("units")
        ).drop("units"),
        "segmentation_report": lambda s, d: segment.segment_report(segment.phrases_flat(_cleaned(s, d)), vocab.FILE_KEY),
        "simple_segments": lambda s, d: segment.simple_segments(fx.md_docs(s, d)),
        "html_strip": lambda s, d: fx.table(s, d, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text")),
    }


def vote_queries() -> dict[str, Query]:
    def per_question(s: SparkSession, d: str) -> DataFrame:
        return vote.per_question(vote.tally(fx.votes(s, d)))

    def answer_maps(s: SparkSession, d: str) -> DataFrame:
        maps = vote.answer_maps(vote.classify(fx.votes(s, d)))
        pairs = F.transform(
            F.map_entries("reponses_questions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        )
        total = F.aggregate(F.map_values("agreement_rates"), F.lit(0.0), lambda a, x: a + x)
        return maps.select(
            *vocab.PHRASE_KEY, "categorie", F.array_join(pairs, ",").alias("answers"), total.alias("agreement_sum")
        )

    def call_details(s: SparkSession, d: str) -> DataFrame:
        shown = F.transform(
            "detail_appels",
            lambda c: F.concat(
                c["model_short"], F.lit(":"), c["question_key"], F.lit(":"), c["reponse"],
                F.when(c["erreur"].isNotNull(), "!").otherwise(""),
            ),
        )
        return vote.call_details(fx.votes(s, d)).select(
            *vocab.PHRASE_KEY, F.size("detail_appels").alias("n_details"), F.array_join(shown, ",").alias("details")
        )

    def stored(s: SparkSession, d: str) -> CallTable:
        """All calls: those that went well first, then those that failed."""
        table = CallTable.create(fx.votes(s, d).where(vote.is_valid()), shared_path(s, "calls"))
        table.add(fx.votes(s, d).where(~vote.is_valid()))
        return table

    def streamed(s: SparkSession, d: str) -> DataFrame:
        """All calls as a stream of files, failed ones in files of their own, so that a unit's calls come in several batches."""
        made, root = fx.votes(s, d), shared_path(s, "stream")
        for part in (vote.is_valid(), ~vote.is_valid()):
            made.where(part).write.mode("append").parquet(f"{root}/calls")
        arriving = s.readStream.schema(made.schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/calls")
        votes.follow(arriving, f"{root}/tallies", f"{root}/state")
        return vote.per_question(votes.tallies(s, f"{root}/tallies"))

    models = fx.ANSWER_MODELS
    return {
        "streamed_votes": streamed,
        "stored_votes": lambda s, d: vote.per_question(stored(s, d).tally()),
        "stored_costs": lambda s, d: stored(s, d).classify().select(
            *vocab.PHRASE_KEY, "cost_usd_phrase", "cost_eur_phrase", "duration_s_phrase"
        ),
        "stored_wide": lambda s, d: stored(s, d).wide(models),
        "majority_vote": per_question,
        "scores_labels": lambda s, d: vote.classify(fx.votes(s, d)).select(
            *vocab.PHRASE_KEY, "scores_roi", "scores_notoriete", "scores_obligation", "categorie"
        ),
        "unanimity": lambda s, d: vote.unanimity(vote.tally(fx.votes(s, d))),
        "answer_maps": answer_maps,
        "phrase_costs": lambda s, d: vote.classify(fx.votes(s, d)).select(
            *vocab.PHRASE_KEY, "cost_usd_phrase", "cost_eur_phrase", "duration_s_phrase"
        ),
        "call_details": call_details,
        "tensor_coo": lambda s, d: B.tensor_coo(B.ballots(fx.votes(s, d), models), models),
        "tensor_phrases": lambda s, d: B.phrase_axis(fx.unit_texts(s, d)),
        "tensor_clients": lambda s, d: B.client_axis(fx.units(s, d)),
        "tensor_shape": lambda s, d: B.tensor_shape(fx.units(s, d), models),
    }


def report_queries() -> dict[str, Query]:
    classified = lambda s, d: vote.classify(fx.votes(s, d))
    models = fx.ANSWER_MODELS

    def published(s: SparkSession, d: str) -> DataFrame:
        """The summary as a reader of a published run sees it."""
        labels, root = classified(s, d), shared_path(s, "reports")
        publish_run({"summary": report.file_summary(labels), "distribution": report.category_distribution(labels)}, root, "first")
        return read_run(s, root, "summary")

    def wide_units(s: SparkSession, d: str) -> DataFrame:
        units = segment.scored_units(segment.paragraphs(_cleaned(s, d)))
        seed = F.concat_ws("/", "source_file", "paragraph_index", "phrase_index")
        return report.wide_units(fx.hashed_answers(units.select(*report.UNIT), seed), units, models)

    return {
        "wide_units": wide_units,
        "phrase_rows": lambda s, d: report.phrase_rows(classified(s, d)),
        "wide_phrases": lambda s, d: report.wide_phrases(fx.votes(s, d), models),
        "compact_answers": lambda s, d: B.compact_answers(B.ballots(fx.votes(s, d), models, with_cost=True), models),
        "file_summary": lambda s, d: report.file_summary(classified(s, d)),
        "published_summary": published,
        "model_stats": lambda s, d: report.model_stats(fx.votes(s, d), models),
        "file_costs": lambda s, d: report.file_costs(fx.votes(s, d)),
        "question_agreement": lambda s, d: report.question_agreement(vote.unanimity(vote.tally(fx.votes(s, d)))),
        "category_distribution": lambda s, d: report.category_distribution(classified(s, d)),
        "global_stats": lambda s, d: report.global_stats(classified(s, d), models),
        "agreement_per_phrase": lambda s, d: report.agreement_per_phrase(classified(s, d), fx.unit_texts(s, d)),
        "flat_listing": lambda s, d: report.flat_listing(classified(s, d), fx.unit_texts(s, d)),
    }


def _segment_texts(s: SparkSession, d: str) -> DataFrame:
    return fx.unit_texts(s, d).select(
        "source_folder", "source_file", F.col("phrase_index").alias("paragraph_index"),
        F.lit("Introduction").alias("section_title"), F.col("phrase").alias("paragraph"),
    )


def _segment_votes(s: SparkSession, d: str) -> DataFrame:
    return fx.votes(s, d).withColumnRenamed("phrase_index", "paragraph_index")


def sensitivity_queries() -> dict[str, Query]:
    models = fx.ANSWER_MODELS
    folded = lambda s, d: sensitivity.fold(fx.predictions(s, d), models)
    subsets = lambda s, d: sensitivity.leave_k_out(folded(s, d), models)
    rates = lambda s, d: sensitivity.change_rates(subsets(s, d))

    def dataset(s: SparkSession, d: str) -> DataFrame:
        return sensitivity.labelled_dataset(
            _segment_texts(s, d), folded(s, d), vote.classify(_segment_votes(s, d), SEG), models
        )

    return {
        "weighted_vote": lambda s, d: sensitivity.weighted_labels(folded(s, d), models),
        "leave_k_out": subsets,
        "change_rates": rates,
        "stability": lambda s, d: sensitivity.stability(rates(s, d)),
        "change_rates_in_row": lambda s, d: subset_sums.change_rates(folded(s, d), models),
        "stability_in_row": lambda s, d: subset_sums.with_stability(folded(s, d), models).select(*SEG, "stability_score"),
        "stability_report": lambda s, d: sensitivity.stability_report(rates(s, d)),
        "top_combinations": lambda s, d: sensitivity.top_combinations(subsets(s, d), models),
        "labelled_dataset": dataset,
        "file_synthesis": lambda s, d: sensitivity.file_synthesis(dataset(s, d)),
        "unstable_dataset": lambda s, d: sensitivity.unstable(dataset(s, d)),
    }


def ensemble_queries() -> dict[str, Query]:
    models = fx.ENSEMBLE_MODELS
    base = lambda s, d: B.ballots(fx.votes(s, d, models), models)
    pairs = lambda s, d: ensemble.pairs(base(s, d), models)

    def revote(s: SparkSession, d: str) -> DataFrame:
        answers = F.concat_ws(",", *[F.when(F.col(f"a_{q}"), "oui").otherwise("non") for q in vocab.QUESTION_KEYS])
        return ensemble.revote(base(s, d), models).select(
            *vocab.PHRASE_KEY, "ensemble", "n_modeles_actifs", "roi", "not", "obl", "categorie", answers.alias("answers")
        )

    def concordance(s: SparkSession, d: str) -> DataFrame:
        short = lambda c: F.array_join(F.transform(c, lambda m: F.element_at(F.split(m, "/"), -1)), " | ").alias(c)
        return ensemble.concordance(pairs(s, d)).select(
            "ensemble", short("modeles_retires"), short("modeles_ajoutes"), "n_segments", "n_concordants", "taux_concordance"
        )

    return {
        "ensemble_revote": revote,
        "concordance": concordance,
        "concordance_by_class": lambda s, d: ensemble.concordance_by_class(pairs(s, d)),
        "question_divergence": lambda s, d: ensemble.question_divergence(pairs(s, d)),
        "divergent_segments": lambda s, d: ensemble.divergent_segments(pairs(s, d), texts=fx.unit_texts(s, d)),
        "model_influence": lambda s, d: ensemble.model_influence(ensemble.concordance(pairs(s, d))),
        "question_sensitivity": lambda s, d: ensemble.question_sensitivity(ensemble.question_divergence(pairs(s, d))),
        "unstable_segments": lambda s, d: ensemble.unstable_segments(pairs(s, d), texts=fx.unit_texts(s, d)),
        "stable_segments": lambda s, d: ensemble.stable_segments(pairs(s, d), texts=fx.unit_texts(s, d)),
        "stability_headline": lambda s, d: ensemble.stability_headline(pairs(s, d)),
        "ensemble_global_view": lambda s, d: ensemble.global_view(pairs(s, d)),
    }


def judge_queries() -> dict[str, Query]:
    def first(s: SparkSession, d: str) -> DataFrame:
        return fx.predictions(s, d, fx.ANSWER_MODELS[:1]).select(
            *SEG, F.col("categorie").alias("categorie_cot"), F.col("confiance").alias("confiance_cot")
        )

    def judged(s: SparkSession, d: str) -> DataFrame:
        return judge.match_ground_truth(judge.merge_verdicts(first(s, d), fx.verdicts(s, d)), fx.ground_truth(s, d))

    def consistency(s: SparkSession, d: str) -> DataFrame:
        own = vote.classify(
            fx.votes(s, d, fx.ANSWER_MODELS[:1]).withColumnRenamed("phrase_index", "paragraph_index"), SEG
        )
        return judge.self_consistency(first(s, d), own)

    return {
        "ground_truth_match": lambda s, d: judge.match_ground_truth(first(s, d), fx.ground_truth(s, d)).select(
            *SEG, "categorie_cot", "categorie_gt"
        ),
        "ground_truth_accuracy": lambda s, d: judge.accuracy(
            judge.match_ground_truth(first(s, d), fx.ground_truth(s, d)), "categorie_cot"
        ),
        "judge_report": lambda s, d: judge.judge_report(judged(s, d)),
        "self_consistency": consistency,
        "consistency_rate": lambda s, d: judge.consistency_rate(consistency(s, d)),
        "judge_detail": lambda s, d: judge.judge_detail(judged(s, d).join(_segment_texts(s, d), list(SEG))),
    }


def call_queries() -> dict[str, Query]:
    def answers(strict: bool) -> Query:
        reader = parse.yes_no_strict if strict else parse.yes_no
        return lambda s, d: fx.raw_replies(s, d).withColumn("r", reader(F.col("raw"))).select(
            "doc_id", "question_key", "r.answer", F.col("r.erreur").isNotNull().alias("failed")
        )

    def predictions(s: SparkSession, d: str) -> DataFrame:
        read = fx.raw_predictions(s, d).withColumn("p", parse.prediction(F.col("raw")))
        said = F.concat_ws(",", *[F.element_at(F.col("p.answers"), q) for q in vocab.QUESTION_KEYS])
        return read.select(
            "doc_id", "p.categorie", "p.confiance", "p.justification", said.alias("answers"),
            F.col("p.erreur").isNotNull().alias("failed"),
        )

    def plan(s: SparkSession, d: str) -> DataFrame:
        return calls.call_plan(fx.units(s, d))

    def phrase_prompts(s: SparkSession, d: str) -> DataFrame:
        asked = calls.call_plan(fx.unit_texts(s, d))
        return asked.select(*vocab.PHRASE_KEY, "question_key", "model", F.md5(calls.phrase_prompt()).alias("prompt_md5"))

    def paragraph_prompts(s: SparkSession, d: str) -> DataFrame:
        asked = calls.paragraph_prompts(segment.paragraph_contexts(segment.paragraphs(_cleaned(s, d))), then=F.md5)
        return asked.select(
            "source_folder", "source_file", "paragraph_index", "phrase_index", "question_key", "model",
            F.col("prompt").alias("prompt_md5"),
        )

    def segment_prompts(s: SparkSession, d: str) -> DataFrame:
        plan = _segment_texts(s, d).select("*", F.explode(F.array(*[F.lit(m) for m in fx.ANSWER_MODELS])).alias("model"))
        prompt = calls.segment_prompt(fx.SEGMENT_TEMPLATE, fx.QWEN_TEMPLATE)
        return plan.select(*SEG, "model", F.md5(prompt).alias("prompt_md5"))

    def judge_prompts(s: SparkSession, d: str) -> DataFrame:
        said = F.create_map(F.lit("roi_1"), F.when(F.col("categorie") == "ROI", "oui").otherwise("non"))
        judged = fx.predictions(s, d, fx.ANSWER_MODELS[:1]).join(_segment_texts(s, d), list(SEG)).withColumns(
            {"answers": said, "raisonnement": F.lit(None).cast("string")}
        )
        return judged.select(*SEG, F.md5(calls.judge_prompt(fx.JUDGE_TEMPLATE)).alias("prompt_md5"))

    def ask():
        def answer(batch):
            yes = batch["prompt"].str.len() % 2 == 0
            out = batch[[]].copy()
            out["raw"] = yes.map({True: '{"reponse": "oui"}', False: '{"reponse": "non"}'})
            out["tok_in"] = (batch["system"].str.len() + batch["prompt"].str.len()).astype("int32")
            out["tok_out"], out["duration_s"], out["erreur"] = 5, 0.0, None
            return out

        return answer

    def external(s: SparkSession, d: str) -> DataFrame:
        asked = calls.with_prompts(calls.call_plan(fx.unit_texts(s, d)), calls.phrase_prompt(), "oui ou non").drop("phrase")
        replied = calls.read_answers(calls.ask_external(asked, ask, keep=[*vocab.PHRASE_KEY, "question_key", "model"]))
        return replied.select(*vocab.PHRASE_KEY, "question_key", "model", "answer", "tok_in", "tok_out")

    def answers_once(s: SparkSession, d: str) -> DataFrame:
        """The calls of some files, then those of all: prompts that were asked before aren't asked again."""
        store = AnswerStore(shared_path(s, "answers"))
        units = fx.unit_texts(s, d)
        once = lambda some: ask_units_once(some, calls.phrase_prompt(), "oui ou non", store, ask)
        once(units.where(F.col("source_file").startswith("src1")))
        replied = calls.read_answers(once(units))
        return replied.select(*vocab.PHRASE_KEY, "question_key", "model", "answer", "tok_in", "tok_out", "reused")

    def recorded(s: SparkSession, d: str) -> DataFrame:
        replies = fx.raw_replies(s, d).filter("doc_id % 10 <> 3").select(
            F.col("doc_id").cast("int").alias("phrase_index"), "question_key", "raw",
            F.lit(10).alias("tok_in"), F.lit(2).alias("tok_out"), F.lit(None).cast("string").alias("erreur"),
        )
        asked = calls.call_plan(fx.units(s, d))
        answered = calls.answers_from_recorded(asked, replies, ["phrase_index", "question_key"])
        return answered.select(
            *vocab.PHRASE_KEY, "question_key", "model", "answer", "tok_in", F.col("erreur").isNotNull().alias("failed")
        )

    def rules(s: SparkSession, d: str) -> DataFrame:
        asked = calls.call_plan(fx.unit_texts(s, d))
        return calls.answer_by_rules(asked, fx.RULES).select(*vocab.PHRASE_KEY, "question_key", "model", "answer")

    done = lambda s, d: fx.units(s, d).filter(F.col("source_file").startswith("src1")).select(*vocab.FILE_KEY)

    def results(s: SparkSession, d: str) -> DataFrame:
        labelled = vote.classify(fx.votes(s, d)).select(*vocab.PHRASE_KEY, "categorie")
        fresh = labelled.withColumn("source_path", F.lit("b/new.json"))
        cached = labelled.filter("phrase_index % 3 = 0").select(
            *vocab.PHRASE_KEY, F.lit("cached").alias("categorie"), F.lit("a/old.json").alias("source_path")
        )
        return calls.with_cached(fresh, cached)

    def language_accuracy(s: SparkSession, d: str) -> DataFrame:
        routed = language.routed(fx.documents(s, d, "lang", "text"))
        return routed.groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("lang_detected")).alias("n_right")
        )

    return {
        "parse_answers": answers(False),
        "parse_answers_strict": answers(True),
        "parse_predictions": predictions,
        "chat_content": lambda s, d: fx.chat_responses(s, d).withColumn("r", parse.content_and_usage(F.col("response"))).select(
            "conv_id", "turn", F.coalesce("r.raw", F.lit("")).alias("raw"), "r.tok_in", "r.tok_out",
            F.col("r.erreur").isNotNull().alias("failed"),
        ),
        "call_plan": plan,
        "call_costs": lambda s, d: calls.call_costs(fx.votes(s, d)).select(
            *vocab.PHRASE_KEY, "model", "question_key", "cost_usd", "cost_eur"
        ),
        "phrase_prompts": phrase_prompts,
        "paragraph_prompts": paragraph_prompts,
        "segment_prompts": segment_prompts,
        "judge_prompts": judge_prompts,
        "external_answers": external,
        "answers_once": answers_once,
        "recorded_answers": recorded,
        "rule_answers": rules,
        "incremental_skip": lambda s, d: calls.pending(fx.units(s, d), done(s, d)),
        "dedup_results": lambda s, d: calls.first_results(results(s, d), ["source_path"]),
        "language_route": lambda s, d: language.routed(fx.documents(s, d, "lang", "text")).select(
            "doc_id", F.coalesce("lang_detected", F.lit("-")).alias("lang_detected"), "lang_routed"
        ),
        "language_accuracy": language_accuracy,
    }


def structure_queries() -> dict[str, Query]:
    def boxes(s: SparkSession, d: str) -> DataFrame:
        shown = F.array_join(F.transform("blocs_detail", lambda b: F.array_join(b["bbox"].cast("array<string>"), ",")), ";")
        return docstruct.page_boxes(fx.boxes(s, d)).select("doc", "page", "texte", "nb_blocs", "nb_chars", shown.alias("bboxes"))

    def preview(s: SparkSession, d: str) -> DataFrame:
        values = F.transform("apercu", lambda c: F.coalesce(c["value"], F.lit("")))
        return docstruct.table_preview(fx.cells(s, d)).select(
            "doc", "table_no", "n_rows", "n_cols", F.array_join("colonnes", ",").alias("colonnes"),
            F.array_join(values, ",").alias("apercu"),
        )

    def paths(s: SparkSession, d: str) -> DataFrame:
        listed = fx.table(s, d, "pages").select(
            F.col("url").alias("path"), F.col("page_id").alias("seen_no")
        )
        return docstruct.distinct_paths(listed, "seen_no")

    return {
        "page_concat": lambda s, d: docstruct.join_pages(fx.page_texts(s, d)),
        "page_concat_titled": lambda s, d: docstruct.join_pages(fx.page_texts(s, d), titled=True),
        "page_boxes": boxes,
        "structure_markdown": lambda s, d: docstruct.structure_markdown(fx.elements(s, d)),
        "element_stats": lambda s, d: docstruct.element_stats(fx.elements(s, d)),
        "rebuild_with_tables": lambda s, d: docstruct.rebuild_with_tables(fx.elements(s, d), fx.tables_of_docs(s, d)),
        "splice_tables": lambda s, d: docstruct.splice_tables(fx.docs_with_headings(s, d), fx.tables_of_docs(s, d)),
        "table_markdown": lambda s, d: docstruct.table_markdown(fx.cells(s, d)),
        "table_preview": preview,
        "markdown_tables": lambda s, d: docstruct.markdown_tables(fx.md_docs(s, d)),
        "table_cells": lambda s, d: docstruct.table_cells(docstruct.markdown_tables(fx.md_docs(s, d))),
        "block_text": lambda s, d: docstruct.block_text(fx.blocks(s, d)),
        "block_grid": lambda s, d: docstruct.block_tables(fx.blocks(s, d)),
        "extraction_leaderboard": lambda s, d: docstruct.extraction_leaderboard(fx.extractions(s, d)),
        "extraction_by_mode": lambda s, d: docstruct.extraction_leaderboard(fx.extractions(s, d), ["outil", "mode"]),
        "path_dedup": paths,
    }


def flagship() -> dict[str, Query]:
    def labelled_phrases(s: SparkSession, d: str) -> DataFrame:
        """Markdown, cleaned and cut to phrases, asked, voted and labelled."""
        phrases = segment.phrases_flat(_cleaned(s, d))
        keyed = phrases.select(*vocab.PHRASE_KEY, T.fingerprint(F.col("phrase")).alias("_fp"))
        return vote.classify(fx.hashed_answers(keyed, F.col("_fp")))

    return {
        "labelled_phrases": lambda s, d: labelled_phrases(s, d).select(
            *vocab.PHRASE_KEY, "scores_roi", "scores_notoriete", "scores_obligation", "categorie", "cost_eur_phrase"
        ),
        "labelled_files": lambda s, d: report.file_summary(labelled_phrases(s, d), ["source_folder"]),
    }


def registry() -> dict[str, Query]:
    return {
        **flagship(),
        **text_queries(),
        **call_queries(),
        **vote_queries(),
        **report_queries(),
        **sensitivity_queries(),
        **ensemble_queries(),
        **judge_queries(),
        **structure_queries(),
    }
