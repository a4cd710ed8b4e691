from __future__ import annotations

import json

import pytest

from sentivote import vocab
from sentivote.operators import segment
from sentivote.sources import files
from sentivote.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    (root / "client a" / "lot+1").mkdir(parents=True)
    (root / "top.md").write_bytes("# Été\r\na\rb".encode())
    (root / "client a" / "lot+1" / "dé 100%.md").write_text("- x\n- y", encoding="utf-8")
    (root / "client a" / "note.txt").write_text("no", encoding="utf-8")
    (root / "client a" / "scan.pdf").write_bytes(b"%PDF")
    return root


def test_markdown_tree(spark, tree):
    rows = {(r["source_folder"], r["source_file"]): r["text"] for r in files.markdown_files(spark, str(tree)).collect()}
    assert rows == {(".", "top.md"): "# Été\na\nb", ("client a/lot+1", "dé 100%.md"): "- x\n- y"}


def test_pdf_listing(spark, tree):
    assert [r["length"] for r in files.pdf_files(spark, str(tree)).collect()] == [4]
    assert files.pdf_files(spark, str(tree), recursive=False).count() == 0


def test_json_lists_default_and_skip_results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"phrase": "p", "phrase_index": 0, "extra": 1}, {"phrase": "  ", "phrase_index": 1},
        {"phrase": "q", "phrase_index": 2, "source_file": "z.md", "source_folder": "c"},
    ]), encoding="utf-8")
    (tmp_path / "a_classification.json").write_text(json.dumps([{"phrase": "r", "phrase_index": 9}]), encoding="utf-8")
    rows = files.read_phrases(spark, str(tmp_path)).orderBy("phrase_index").collect()
    assert [(r["phrase"], r["source_file"], r["source_folder"]) for r in rows] == [("p", "a.json", ""), ("q", "z.md", "c")]
    cached = files.read_results(spark, str(tmp_path), "phrase string, phrase_index int").collect()
    assert [(r["phrase"], r["source_path"].endswith("a_classification.json")) for r in cached] == [("r", True)]


def test_paragraph_and_segment_lists(spark, tmp_path):
    (tmp_path / "d_paragraphs.json").write_text(json.dumps([
        {"paragraph_index": 0, "section_title": "T", "source_file": "d.md", "source_folder": "c", "phrases": [{"phrase_index": 0, "phrase": "x"}]},
        {"section_title": "U", "source_file": "d.md"},
    ]), encoding="utf-8")
    (tmp_path / "d_segments.json").write_text(json.dumps([{"paragraph": "p", "paragraph_index": 4, "source_file": "d.md"}]), encoding="utf-8")
    paragraphs = files.read_paragraphs(spark, str(tmp_path)).filter("section_title <> ''")
    assert segment.scored_units(paragraphs.drop("source_json")).count() == 2
    assert [r["paragraph_index"] for r in files.read_segments(spark, str(tmp_path)).collect()] == [4]


def test_questions_file(spark, tmp_path):
    path = tmp_path / "questions.txt"
    path.write_text("\n[ROI] Un ?\n\n[NOT]Deux ?\nhors sujet\n [ROI]  Trois ? \n[XYZ] non\n[OBL] Quatre ?\n", encoding="utf-8")
    got = files.load_questions(spark, str(path))
    assert [(q.key, q.category, q.text) for q in got] == [
        ("roi_1", "ROI", "Un ?"), ("notoriete_1", "Notoriete", "Deux ?"), ("roi_2", "ROI", "Trois ?"), ("obl_1", "Obligation", "Quatre ?"),
    ]
    assert [r["line"] for r in files.rejected_questions(spark, str(path)).orderBy("line_no").collect()] == ["hors sujet", "[XYZ] non"]


def test_template_and_ground_truth(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n a {phrase}\n b \n", encoding="utf-8")
    assert files.load_template(spark, str(tmp_path / "t.txt")) == "a {phrase}\n b"
    (tmp_path / "gt.csv").write_text(" paragraph_index ,source_file, category\n1,a.md,ROI\n", encoding="utf-8")
    gt = files.read_ground_truth(spark, str(tmp_path / "gt.csv"))
    assert gt.columns == ["paragraph_index", "source_file", "category", "ord"]


def test_sinks_round_trip(spark, tree, tmp_path):
    phrases = segment.phrases_flat(files.markdown_files(spark, str(tree)))
    files.write_dataset(phrases, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*phrases.columns).collect())) == sorted(map(tuple, phrases.collect()))
    files.write_report({"par_fichier": phrases.groupBy("source_file").count(), "phrases": phrases}, str(tmp_path / "run"), "csv")
    assert spark.read.csv(str(tmp_path / "run" / "phrases"), header=True).count() == phrases.count()


def test_labelled_dataset_export(spark, tmp_path):
    columns = ", ".join(f"Q_{q} string" for q in vocab.QUESTION_KEYS)
    row = ("c", "f", 0, "T", "p", "ROI", 0.5, 90.0, "secret", *["oui"] * 9)
    df = spark.createDataFrame([row], "source_folder string, source_file string, paragraph_index int, section_title string, "
                               "paragraph string, label string, confidence double, stability_score double, detail string, " + columns)
    files.write_labelled_dataset(df, str(tmp_path / "ds"))
    back = spark.read.json(str(tmp_path / "ds")).first().asDict(recursive=True)
    assert "detail" not in back and back["reponses_questions"]["obl_3"] == "oui"


def test_stream_works_on_new_files_only(spark, tree, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: incremental.process_new(incremental.markdown_stream(spark, str(tree)), segment.phrases_flat, out, state)
    assert run() == 1
    assert incremental.results(spark, out).count() == 4
    assert run() == 0
    (tree / "new.md").write_text("- z", encoding="utf-8")
    assert run() == 1
    rows = incremental.results(spark, out).collect()
    assert len(rows) == 5 and {r["source_file"] for r in rows if r["batch"] == 1} == {"new.md"}
