from __future__ import annotations

from sentivote.operators import docstruct as D

EL = "doc long, el_no int, path string, text string, page int, text_size double"


def markdown(spark, rows, build=D.structure_markdown):
    return build(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], EL)).first()["markdown"]


def test_structure_markdown(spark):
    got = markdown(spark, [
        ("/H1", " Titre ", None, 20.0), ("/H2", "Sous", 1, 14.0), ("/P", "texte", 1, None), ("/Table", None, 1, None),
        ("/Table/TR", "", 1, None), ("/Table/TR/TD", "a", 1, None), ("/P", " ", 1, None), ("/Table/TD", "b", 1, None),
        ("/Table/TD", "c", 2, None), ("/P", "fin", 2, None),
    ])
    assert got == "\n".join([
        "\n## Titre\n", "\n### Sous\n", "texte ", "\n### Tableau\n", "\n", "| a |", "\n", "\n### Tableau\n", "| b |",
        "\n---\n## Page 2\n", "\n### Tableau\n", "| c |", "\n", "fin ",
    ])


def test_element_stats(spark):
    df = spark.createDataFrame([(1, 0, "/P", "a", 1, None), (1, 1, "/Table/TD", None, 1, None), (1, 2, "/P", "b", 1, None)], EL)
    assert tuple(D.element_stats(df).first()) == (1, 3, 1, "a\nb", 3)


def tables(spark, *markdowns):
    return spark.createDataFrame([(1, i + 1, m) for i, m in enumerate(markdowns)], "doc long, table_no int, markdown string")


def test_rebuild_takes_tables_in_order(spark):
    df = spark.createDataFrame([
        (1, 0, "/P", "a", 1, None), (1, 1, "/Table", "x", 1, None), (1, 2, "/Table/TD", "y", 1, None),
        (1, 3, "/Table[2]", "", 2, None), (1, 4, "/Table[3]", "", 2, None), (2, 0, "/P", "seul", 1, None)], EL)
    rows = {r["doc"]: r["markdown"] for r in D.rebuild_with_tables(df, tables(spark, "T1", "T2")).collect()}
    assert rows[1] == "\n".join(["a ", "\n### Tableau 1\n", "T1", "", "\n---\n## Page 2\n", "\n### Tableau 2\n", "T2", ""])
    assert rows[2] == "seul "


def splice(spark, text, *markdowns):
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    listed = tables(spark, *markdowns) if markdowns else tables(spark, "x").limit(0)
    return D.splice_tables(docs, listed).first()["text"]


def test_splice_tables(spark):
    assert splice(spark, "a\n### Tableau\nb") == "a\n### Tableau\nb"
    assert splice(spark, "a\n### Tableau\n\n \nb", "T1") == "a\n### Tableau\n\n \n\nT1\n\nb"
    assert splice(spark, "### TABLEAU\n## mon Tableau", "T1") == "### TABLEAU\n\nT1\n\n## mon Tableau\n\n*Tableau non disponible*\n"
    assert splice(spark, "Tableau sans dièse\n", "T1") == (
        "Tableau sans dièse\n\n\n## Tableaux supplémentaires\n\n\n### Tableau 1\n\nT1\n"
    )
    assert splice(spark, "### Tableau\n", "T1", "T2", "T3") == (
        "### Tableau\n\n\nT1\n\n\n## Tableaux supplémentaires\n\n\n### Tableau 2\n\nT2\n\n\n### Tableau 3\n\nT3\n"
    )


CELLS = "doc long, table_no int, row int, col int, value string"


def test_table_markdown_and_preview(spark):
    rows = [(1, 1, 0, c, n) for c, n in ((1, "h"), (2, "k"))]
    rows += [(1, 1, r, c, None if (r, c) == (2, 2) else f"{r}{c}") for r in range(1, 23) for c in (1, 2)]
    rows += [(1, 2, 0, 1, "vide")]
    df = spark.createDataFrame(rows, CELLS)
    got = {r["table_no"]: r["markdown"] for r in D.table_markdown(df, rows=20).collect()}
    lines = got[1].split("\n")
    assert lines[:4] == ["| h | k |", "|---|---|", "| 11 | 12 |", "| 21 | nan |"]
    assert lines[-2:] == ["", "*... et 2 lignes supplémentaires*"] and len(lines) == 24
    assert got[2] == "*Tableau vide*"
    seen = {r["table_no"]: r for r in D.table_preview(df, rows=3).collect()}
    assert (seen[1]["n_rows"], seen[1]["n_cols"], seen[1]["colonnes"], len(seen[1]["apercu"])) == (22, 2, ["h", "k"], 6)


def test_markdown_tables_and_cells(spark):
    text = "x\n | a | b |\n|---|---|\n|:-:|--|\n| 1 |\ny\n| only |\n|--|\n\n|p|q|r|\n||s||"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    found = D.markdown_tables(docs)
    assert [r["table"].count("\n") for r in found.orderBy("table_no").collect()] == [3, 1, 1]
    cells = [(r["table_no"], r["row"], r["col"], r["value"]) for r in D.table_cells(found).orderBy("table_no", "row", "col").collect()]
    assert cells == [
        (0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, ":-:"), (0, 1, 1, "--"), (0, 2, 0, "1"), (0, 2, 1, ""),
        (2, 0, 0, "p"), (2, 0, 1, "q"), (2, 0, 2, "r"), (2, 1, 0, "s"), (2, 1, 1, ""), (2, 1, 2, ""),
    ]


def test_block_grid_and_text(spark):
    child = lambda *ids: [("CHILD", list(ids))]
    rows = [
        (1, 0, "t", "TABLE", None, None, None, [("OTHER", ["z"]), *child("c1", "c2", "c3", "w1", "missing")]),
        (1, 1, "c1", "CELL", None, 1, 1, child("w1", "w2", "c2")),
        (1, 2, "c2", "CELL", None, 3, 2, None),
        (1, 3, "c3", "CELL", None, 1, 1, child("w3")),  # same place as c1, later
        (1, 4, "w1", "WORD", "un", None, None, None), (1, 5, "w2", "WORD", "deux", None, None, None),
        (1, 6, "w3", "WORD", "trois", None, None, None), (1, 7, "l1", "LINE", "ligne a", None, None, None),
        (1, 8, "l2", "LINE", None, None, None, None), (1, 9, "l3", "LINE", "ligne b", None, None, None),
        (1, 10, "t2", "TABLE", None, None, None, child("w1")),
    ]
    df = spark.createDataFrame(rows, "doc long, ord int, id string, block_type string, text string, row_index int, "
                               "column_index int, relationships array<struct<type:string,ids:array<string>>>")
    grid = {(r["table_id"], r["row"], r["col"]): r["value"] for r in D.block_tables(df).collect()}
    assert grid == {("t", r, c): "trois" if (r, c) == (1, 1) else "" for r in (1, 2, 3) for c in (1, 2)}
    assert D.block_text(df).first()["text"] == "ligne a\nligne b"


BLOCKS = ("doc long, ord int, id string, block_type string, text string, row_index int, column_index int, "
          "relationships array<struct<type:string,ids:array<string>>>")


def test_block_grid_in_the_row_and_by_joins(spark):
    child = lambda *ids: [("CHILD", list(ids))]
    word = lambda i, text: (i, "WORD", text, None, None, None)
    plain = [
        ("t", "TABLE", None, None, None, child("b", "a", "gone", None, "w1")), ("a", "CELL", None, 2, 2, child("w2", "w1", "a")),
        ("b", "CELL", None, None, None, [("CHILD", ["w1"]), ("OTHER", ["w2"]), ("CHILD", ["w3"])]), ("l", "LINE", "x", None, None, None),
        word("w1", "un"), word("w2", " deux "), word("w3", None), ("t2", "TABLE", None, None, None, child("a")), ("t3", "TABLE", None, None, None, None),
    ]
    repeated = [
        *plain, word("w1", "autre"), ("a", "CELL", "x", 1, 3, child("w3", "w2")), ("t", "TABLE", None, None, None, child("c", "c")),
        ("c", "CELL", None, 3, 1, child("w2")), ("c", "WORD", "mot", None, None, None), (None, "TABLE", None, None, None, child("c")),
        (None, "CELL", None, 1, 1, child("w1")), (None, "WORD", "rien", None, None, None),
    ]
    rows = [(doc, n, *b) for doc, listed in ((1, plain), (2, repeated), (None, plain)) for n, b in enumerate(listed)]
    df = spark.createDataFrame(rows, BLOCKS)
    whole, joined, mixed = ([tuple(r) for r in D.block_tables(df, in_row=n).orderBy("doc", "table_id", "row", "col").collect()] for n in (1000, 0, 10))
    assert whole == joined == mixed
    first = [r[1:] for r in whole if r[0] == 1]
    assert first == [("t", 1, 1, "un"), ("t", 1, 2, ""), ("t", 2, 1, ""), ("t", 2, 2, "deux  un"),
                     ("t2", 1, 1, ""), ("t2", 1, 2, ""), ("t2", 2, 1, ""), ("t2", 2, 2, "deux  un")]
    second = {r[1:4]: r[4] for r in whole if r[0] == 2}
    assert second["t", 2, 2] == second["t", 1, 3] == "deux   deux  autre un" and second["t", 3, 1] == second[None, 3, 1] == "deux"
    assert {r[0] for r in whole} == {1, 2}


def test_block_grid_moves_line_items_once(spark, sf):
    """Small documents follow their edges where they lie: no join on ids, no second exchange."""
    from sentivote.plans import queries

    df = queries.registry()["block_grid"](spark, sf)
    assert len(df.collect()) > 0
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [l for l in ran.split("\n") if "Exchange hashpartitioning" in l and "ReusedExchange" not in l]
    assert "isFinalPlan=true" in ran and len(moved) <= 1 and "SortMergeJoin" not in ran


def test_pages_and_boxes(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, None)], "doc long, page int, text string")
    assert tuple(D.join_pages(pages).first()) == (1, "\n\n--- PAGE SUIVANTE ---\n\nb", 2, 26)
    assert D.join_pages(pages, titled=True).first()["text"] == "--- Page 1 ---\n\n\n--- Page 2 ---\nb"
    assert D.join_pages(pages, separator=D.RULED).first()["text"] == "\n\n---\n\nb"
    boxes = spark.createDataFrame([(1, 1, 1, [1.239, 2.0], " a\n"), (1, 1, 2, [0.0], "  "), (1, 1, 0, [0.5], "é"), (1, 2, 0, [0.0], None)],
                                  "doc long, page int, box_no int, bbox array<double>, text string")
    rows = {r["page"]: r for r in D.page_boxes(boxes).collect()}
    assert (rows[1]["texte"], rows[1]["nb_blocs"], rows[1]["nb_chars"]) == ("é\na", 2, 2)
    assert rows[1]["blocs_detail"][1]["bbox"] == [1.24, 2.0]
    assert (rows[2]["texte"], rows[2]["nb_blocs"], rows[2]["nb_chars"]) == ("", 0, 0)


def test_leaderboard_and_paths(spark):
    df = spark.createDataFrame([("a", 3, 10, 1, 0.1, None), ("a", 0, 0, 0, 0.2, "x"), ("b", 1, 5, 0, 1.0, "")],
                               "outil string, nb_pages int, nb_chars int, nb_tableaux int, temps_secondes double, erreur string")
    rows = {r["outil"]: tuple(r)[1:] for r in D.extraction_leaderboard(df).collect()}
    assert rows == {"a": (2, 1, 1, 3, 10, 1, 0.3), "b": (1, 1, 0, 1, 5, 0, 1.0)}
    files = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 3, "z")], "path string, no int, v string")
    assert sorted(map(tuple, D.distinct_paths(files, "no").collect())) == [("p", 2, "y"), ("q", 3, "z")]


def test_splice_behind_very_many_blank_lines(spark):
    text = "### Tableau 1" + "\n \n" * 50_000 + "suite"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    tables = spark.createDataFrame([("d", 0, "|x|")], "doc string, table_no int, markdown string")
    got = D.splice_tables(docs, tables).first()["text"]
    assert got.count("|x|") == 1 and got.endswith("suite")


def test_path_dedup_takes_rows_that_hold_maps(spark):
    from sentivote.operators import docstruct

    rows = [("a", 1, {"x": 1}), ("a", 2, {"y": 2}), ("b", 1, None)]
    got = docstruct.distinct_paths(spark.createDataFrame(rows, "path string, seen int, meta map<string,int>"), "seen").collect()
    assert sorted((r["path"], r["seen"], r["meta"]) for r in got) == [("a", 2, {"y": 2}), ("b", 1, None)]
