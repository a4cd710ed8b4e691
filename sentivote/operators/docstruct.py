"""Document structure: pages, layout boxes, PDF elements, OCR blocks, tables.

The PDF readers themselves are not part of this package; their output enters
as tables and is turned into text, Markdown and table cells here.  A grouping
by document collects at most that document, since the result is one text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivote.functions.text import WS_IN_LINE, begins_between, let, strip

NEXT_PAGE = "\n\n--- PAGE SUIVANTE ---\n\n"
RULED = "\n\n---\n\n"
EMPTY_TABLE = "*Tableau vide*"
NO_TABLE = "*Tableau non disponible*"


def _ordered(column: Column, *order: str) -> Column:
    """Values of a group in the given order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, column.alias("_value"))))
    return F.transform(listed, lambda e: e["_value"])


# --- pages and boxes ---------------------------------------------------------------


def join_pages(pages: DataFrame, key: Sequence[str] = ("doc",), separator: str = NEXT_PAGE, titled: bool = False) -> DataFrame:
    """Pages of a document joined in order; ``titled`` heads each with its number."""
    text = F.coalesce("text", F.lit(""))
    if titled:
        text, separator = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), text), "\n\n"
    joined = pages.groupBy(*key).agg(
        F.array_join(_ordered(text, "page"), separator).alias("text"), F.count(F.lit(1)).alias("n_pages")
    )
    return joined.withColumn("n_chars", F.length("text"))


def page_boxes(boxes: DataFrame, key: Sequence[str] = ("doc",)) -> DataFrame:
    """Layout boxes to pages: blank boxes dropped, texts joined by line breaks."""
    text = strip(F.coalesce("text", F.lit("")))
    box = F.struct(
        F.transform("bbox", lambda x: F.round(x, 2)).alias("bbox"), F.when(text != "", text).alias("texte")
    )
    pages = boxes.groupBy(*key, "page").agg(F.filter(_ordered(box, "box_no"), lambda b: b["texte"].isNotNull()).alias("blocs"))
    texts = F.transform("blocs", lambda b: b["texte"])
    return pages.select(
        *key,
        "page",
        F.array_join(texts, "\n").alias("texte"),
        F.size("blocs").alias("nb_blocs"),
        F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t)).alias("nb_chars"),
        F.col("blocs").alias("blocs_detail"),
    )


# --- PDF structure elements -----------------------------------------------------------


def _with_page_breaks(elements: DataFrame, key: Sequence[str]) -> DataFrame:
    """Defaults for missing fields, and whether the element starts another page."""
    filled = elements.withColumns(
        {
            "page": F.coalesce("page", F.lit(1)),
            "path": F.coalesce("path", F.lit("")),
            "text": F.coalesce("text", F.lit("")),
            "text_size": F.coalesce("text_size", F.lit(12.0)),
        }
    )
    in_order = Window.partitionBy(*key).orderBy("el_no")
    return filled.withColumn("new_page", F.col("page") != F.lag("page", 1, 1).over(in_order)).withColumn(
        "is_table", F.col("path").contains("Table")
    )


def _lines(*candidates: Column) -> Column:
    """The lines that are not null."""
    return F.filter(F.array(*candidates), lambda l: l.isNotNull())


def _page_break() -> Column:
    return F.when(F.col("new_page"), F.concat(F.lit("\n---\n## Page "), F.col("page").cast("string"), F.lit("\n")))


def structure_markdown(elements: DataFrame, key: Sequence[str] = ("doc",)) -> DataFrame:
    """PDF elements to Markdown: page breaks, table runs, titles by text size."""
    in_order = Window.partitionBy(*key).orderBy("el_no")
    rows = _with_page_breaks(elements, key).withColumn(
        "in_table", F.lag("is_table", 1, False).over(in_order) & ~F.col("new_page")
    )
    text = strip(F.col("text"))
    table, inside = F.col("is_table"), F.col("in_table")
    heading = lambda mark: F.concat(F.lit(f"\n{mark} "), text, F.lit("\n"))
    lines = _lines(
        _page_break(),
        F.when(table & ~inside, F.lit("\n### Tableau\n")),
        F.when(table & F.col("path").contains("TD"), F.concat(F.lit("| "), "text", F.lit(" |"))).when(
            table & F.col("path").contains("TR"), F.lit("\n")
        ),
        F.when(~table & inside, F.lit("\n")),
        F.when(~table & (text != ""), F.when(F.col("text_size") >= 18, heading("##"))
               .when(F.col("text_size") >= 14, heading("###"))
               .otherwise(F.concat(text, F.lit(" ")))),
    )
    return (
        rows.withColumn("_lines", lines)
        .groupBy(*key)
        .agg(F.array_join(F.flatten(_ordered(F.col("_lines"), "el_no")), "\n").alias("markdown"))
    )


def element_stats(elements: DataFrame, key: Sequence[str] = ("doc",)) -> DataFrame:
    """Elements, table elements, and the joined text of a document."""
    said = F.when(F.col("text") != "", F.col("text"))
    joined = F.array_join(F.filter(_ordered(said, "el_no"), lambda t: t.isNotNull()), "\n")
    return (
        elements.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("nb_elements"),
            F.count_if(F.col("path").contains("Table")).alias("nb_tableaux"),
            joined.alias("texte_complet"),
        )
        .withColumn("nb_chars", F.length("texte_complet"))
    )


def _table_lists(tables: DataFrame, key: Sequence[str]) -> DataFrame:
    return tables.groupBy(*key).agg(_ordered(F.col("markdown"), "table_no").alias("_tables"))


def rebuild_with_tables(elements: DataFrame, tables: DataFrame, key: Sequence[str] = ("doc",)) -> DataFrame:
    """Markdown from elements, the n-th table element replaced by the n-th table."""
    in_order = Window.partitionBy(*key).orderBy("el_no")
    top = F.col("is_table") & ~F.col("path").contains("TD")
    rows = _with_page_breaks(elements, key).withColumn("nth", F.count_if(top).over(in_order))
    text = strip(F.col("text"))
    part = F.struct(
        _page_break().alias("brk"),
        F.when(top, F.col("nth").cast("int")).alias("nth"),
        F.when(~F.col("is_table") & (text != ""), F.concat(text, F.lit(" "))).alias("line"),
    )
    parts = rows.withColumn("_part", part).groupBy(*key).agg(_ordered(F.col("_part"), "el_no").alias("_parts"))
    joined = parts.join(_table_lists(tables, key), list(key), "left")
    table = lambda p: F.get(F.coalesce("_tables", F.array().cast("array<string>")), p["nth"] - 1)

    def write(p: Column) -> Column:
        placed = table(p)
        has = placed.isNotNull()
        title = F.concat(F.lit("\n### Tableau "), p["nth"].cast("string"), F.lit("\n"))
        return _lines(p["brk"], F.when(has, title), placed, F.when(has, F.lit("")), p["line"])

    return joined.select(*key, F.array_join(F.flatten(F.transform("_parts", write)), "\n").alias("markdown"))


def splice_tables(docs: DataFrame, tables: DataFrame, key: Sequence[str] = ("doc",)) -> DataFrame:
    """Put the n-th table under the n-th "Tableau" heading of a Markdown text.

    Headings without a table say so, tables without a heading go to a section
    at the end, documents without tables stay as they are.
    """
    heading = rf"\n(?=[^\n]*### T(?:ableau|ABLEAU)|{WS_IN_LINE}*#[^\n]*Tableau)"
    cut = F.split(F.concat(F.lit("\n"), F.col("text")), heading)
    top = rf"(?s)^([^\n]*(?:\n{WS_IN_LINE}*(?=\n|\z))*+)(.*)\z"  # possessive: it neither recurses nor steps back

    def insert(piece: Column, i: Column, found: Column) -> Column:
        table = F.coalesce(F.get(found, i - 1), F.lit(NO_TABLE))
        return F.when(i == 0, F.substring(piece, 2, 2**31 - 1)).otherwise(
            F.concat(
                F.regexp_extract(piece, top, 1), F.lit("\n\n"), table, F.lit("\n"), F.regexp_extract(piece, top, 2)
            )
        )

    def spliced(pieces: Column) -> Column:
        found = F.col("_tables")
        with_tables = F.transform(pieces, lambda p, i: insert(p, i, found))
        # A text that starts with a heading has an empty first piece.
        body = F.array_join(F.filter(with_tables, lambda p, i: (i > 0) | (F.element_at(pieces, 1) != "")), "\n")
        unused = F.filter(
            F.transform(found, lambda t, i: F.when(i + 1 >= F.size(pieces), F.concat(
                F.lit("\n### Tableau "), (i + 1).cast("string"), F.lit("\n\n"), t, F.lit("\n")))),
            lambda t: t.isNotNull(),
        )
        extra = F.concat(F.lit("\n\n## Tableaux supplémentaires\n\n"), F.array_join(unused, "\n"))
        return F.concat(body, F.when(F.size(unused) > 0, extra).otherwise(""))

    joined = docs.join(_table_lists(tables, key), list(key), "left")
    return joined.select(
        *key, F.when(F.col("_tables").isNull(), F.col("text")).otherwise(let(cut, spliced)).alias("text")
    )


# --- tables ---------------------------------------------------------------------------


def _top_cells(cells: DataFrame, key: Sequence[str], rows: int | None) -> DataFrame:
    """Per table its size and its cells, only those of the header (row 0) and the first ``rows`` if given."""
    cell = F.struct("row", "col", "value")
    shown = cell if rows is None else F.when(F.col("row") <= rows, cell)
    return cells.groupBy(*key, "table_no").agg(
        F.max("row").alias("n_rows"),
        F.max("col").alias("n_cols"),
        F.sort_array(F.collect_list(shown)).alias("_cells"),
    )


def table_markdown(cells: DataFrame, key: Sequence[str] = ("doc",), rows: int | None = None) -> DataFrame:
    """Cells (row 0 is the header) to a Markdown table, of at most ``rows`` rows if given."""

    def write(c: Column, i: Column) -> Column:
        value = F.coalesce(c["value"], F.lit("nan"))
        last = F.coalesce(F.get("_cells", i + 1)["row"] != c["row"], F.lit(True))
        rule = F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit("---"), F.col("n_cols").cast("int")), "|"), F.lit("|"))
        ending = F.when(~last, F.lit(" | ")).when(c["row"] == 0, F.concat(F.lit(" |"), rule)).otherwise(" |")
        first = F.coalesce(F.get("_cells", i - 1)["row"] != c["row"], F.lit(True))
        opening = F.when(~first, "").when(i == 0, "| ").otherwise("\n| ")
        return F.concat(opening, value, ending)

    body = F.array_join(F.transform("_cells", write), "")
    if rows is not None:
        more = F.concat(F.lit("\n\n*... et "), (F.col("n_rows") - rows).cast("string"), F.lit(" lignes supplémentaires*"))
        body = F.concat(body, F.when(F.col("n_rows") > rows, more).otherwise(""))
    return _top_cells(cells, key, rows).select(
        *key, "table_no", F.when(F.col("n_rows") < 1, EMPTY_TABLE).otherwise(body).alias("markdown")
    )


def table_preview(cells: DataFrame, key: Sequence[str] = ("doc",), rows: int | None = None) -> DataFrame:
    """Shape, column names and the cells of each table, of its first ``rows`` if given."""
    named = lambda keep: F.transform(F.filter("_cells", keep), lambda c: F.coalesce(c["value"], F.lit("")))
    return _top_cells(cells, key, rows).select(
        *key,
        "table_no",
        "n_rows",
        "n_cols",
        named(lambda c: c["row"] == 0).alias("colonnes"),
        F.filter("_cells", lambda c: c["row"] > 0).alias("apercu"),
    )


def markdown_tables(docs: DataFrame) -> DataFrame:
    """Maximal runs of lines starting with ``|``, one row per table."""
    keys = [c for c in docs.columns if c != "text"]
    lines = F.transform(F.split("text", "\n"), strip)
    marked = F.transform(lines, lambda s: F.when(s.startswith("|"), F.concat(s, F.lit("\n"))).otherwise("\n"))
    runs = F.transform(F.split(F.array_join(marked, ""), r"\n{2,}"), lambda r: F.btrim(r, F.lit("\n")))
    found = F.filter(runs, lambda r: r != "")
    return docs.select(*keys, F.posexplode(found).alias("table_no", "table"))


def table_cells(tables: DataFrame) -> DataFrame:
    """Cells of Markdown tables: row 0 is the header, short rows are padded.

    Rows of dashes are dropped (alignment colons survive); a table with fewer
    than two remaining rows has no cells.
    """
    keys = [c for c in tables.columns if c != "table"]
    kept = F.filter(F.split(strip(F.col("table")), "\n"), lambda l: F.regexp_replace(l, r"[|\- ]", "") != "")
    rows = F.transform(kept, lambda l: F.transform(F.split(F.btrim(strip(l), F.lit("|")), r"\|"), strip))
    parsed = tables.select(*keys, rows.alias("_rows")).filter(F.size("_rows") >= 2)
    widest = parsed.withColumn("_n", F.array_max(F.transform("_rows", lambda r: F.size(r))))
    by_row = widest.select(*keys, "_n", F.posexplode("_rows").alias("row", "_values"))
    padded = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.get("_values", i), F.lit(""))
    )
    return by_row.select(*keys, "row", F.posexplode(padded).alias("col", "value"))


# --- OCR blocks ------------------------------------------------------------------------


def block_text(blocks: DataFrame, key: Sequence[str] = ("doc",)) -> DataFrame:
    """LINE blocks of a document in order."""
    lines = blocks.filter((F.col("block_type") == "LINE") & F.col("text").isNotNull())
    return lines.groupBy(*key).agg(F.array_join(_ordered(F.col("text"), "ord"), "\n").alias("text"))


IN_ROW = 1000
"""Documents of up to so many blocks of tables are looked up inside one row: its maps are read from end to end."""


def block_tables(blocks: DataFrame, key: Sequence[str] = ("doc",), in_row: int = IN_ROW) -> DataFrame:
    """Table cells from the block graph: one row per grid position, holes empty.

    Documents of at most ``in_row`` blocks are collected and follow their edges in the row; the edges of larger ones are
    joined to the blocks, so no document has to fit into one group.  Blocks already dealt by ``key`` are not moved.
    """
    kind = F.col("block_type")
    children = F.flatten(F.transform(F.filter("relationships", lambda r: r["type"] == "CHILD"), lambda r: r["ids"]))
    first = F.get("relationships", F.lit(0))
    children = F.when((F.size("relationships") == 1) & (first["type"] == "CHILD"), first["ids"]).otherwise(children)
    block = F.struct(
        kind.alias("kind"),
        "id",
        F.when(kind == "WORD", F.coalesce("text", F.lit(""))).alias("word"),
        F.when(kind == "CELL", F.coalesce("row_index", F.lit(1))).alias("row"),
        F.when(kind == "CELL", F.coalesce("column_index", F.lit(1))).alias("col"),
        F.when(kind != "WORD", F.coalesce(children, F.array().cast("array<string>"))).alias("ids"),
    )
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    used = blocks.filter(kind.isin("TABLE", "CELL", "WORD") & known)
    large = F.broadcast(used.groupBy(*key).count().filter(F.col("count") > in_row).select(*key))
    used = used.select(*key, block.alias("_block"))
    small = _cells_in_row(used.join(large, list(key), "left_anti"), key)
    joined = _cells_by_join(used.join(large, list(key), "left_semi").select(*key, "_block.*"), key)
    return _grid(small.unionByName(joined), key)


def _said(words: Column) -> Column:
    """The words of a cell; its ends are stripped once the cell has a row of its own."""
    return F.array_join(words, " ")


def _cells_in_row(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """The cells of each table in order, found in the collected blocks of its document."""
    of = lambda kind: F.filter("_blocks", lambda b: b["kind"] == kind)
    named = lambda kind: F.filter(of(kind), lambda b: b["id"].isNotNull())
    ids = lambda listed: F.transform(listed, lambda b: b["id"])
    by_id = lambda listed, value: F.map_from_arrays(ids(listed), F.transform(listed, value))
    same = lambda listed, i: F.filter(listed, lambda b: b["id"] == i)
    spot = lambda c, pos, value: F.struct(c["row"].alias("row"), c["col"].alias("col"), pos.alias("_pos"), value.alias("value"))

    docs = blocks.groupBy(*key).agg(F.collect_list("_block").alias("_blocks")).select(
        *key, of("TABLE").alias("tables"), named("CELL").alias("cells"), named("WORD").alias("words")
    )
    once = reduce(and_, [F.size(F.array_distinct(ids(c))) == F.size(c) for c in ("cells", "words")])

    def cells_of(word_of: Column) -> Column:
        value = lambda c: _said(F.transform(c["ids"], lambda i: F.try_element_at(word_of, i)))
        return by_id("cells", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), value(c).alias("value")))

    docs = docs.select("*", F.when(once, let(by_id("words", lambda w: w["word"]), cells_of)).alias("cell_of"))

    def spots(children: Column) -> Column:
        return F.transform(children, lambda i, pos: let(
            F.try_element_at("cell_of", i), lambda c: F.when(c.isNotNull(), spot(c, pos, c["value"]))))

    def spots_of_repeated(children: Column) -> Column:
        """The same if ids are repeated: an id stands for all its blocks, a cell says the words of all of them."""
        words = lambda c: F.flatten(F.transform(c["ids"], lambda i, pos: F.transform(
            same("words", i), lambda w: F.struct(pos.alias("_pos"), w["word"].alias("word")))))
        value = lambda found: _said(F.transform(F.sort_array(F.flatten(F.transform(found, words))), lambda w: w["word"]))
        return F.flatten(F.transform(children, lambda i, pos: let(same("cells", i), lambda found: let(
            value(found), lambda v: F.transform(found, lambda c: spot(c, pos, v))))))

    def listed(i: Column) -> Column:
        """The cells of all tables with this id."""
        found = F.transform(
            F.filter("tables", lambda t: t["id"].eqNullSafe(i)),
            lambda t: F.when(F.col("cell_of").isNotNull(), spots(t["ids"])).otherwise(spots_of_repeated(t["ids"])),
        )
        return F.sort_array(F.filter(F.flatten(found), lambda c: c.isNotNull()))

    tables = F.transform(F.array_distinct(ids("tables")), lambda i: F.struct(i.alias("table_id"), listed(i).alias("_cells")))
    return docs.select(*key, F.inline(tables)).filter(F.size("_cells") > 0)


def _cells_by_join(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same by joins.

    Both edges, table to cell and cell to word, go through one join on the
    block id and meet again in one grouping by cell.
    """
    edges = blocks.filter(F.col("kind") != "WORD").select(
        *key, F.col("id").alias("parent"), (F.col("kind") == "TABLE").alias("from_table"), F.posexplode("ids").alias("_pos", "id")
    )
    ends = blocks.filter(F.col("kind") != "TABLE").select(
        *key, "id", (F.col("kind") == "CELL").alias("from_table"), "word", "row", "col"
    )
    # A table's children must be cells, a cell's children words.
    pairs = edges.join(ends, [*key, "id", "from_table"])
    in_table = F.col("from_table")
    spot = F.struct(F.col("parent").alias("table_id"), "_pos", "row", "col")
    by_cell = pairs.groupBy(*key, F.when(in_table, F.col("id")).otherwise(F.col("parent")).alias("cell_id")).agg(
        F.collect_list(F.when(in_table, spot)).alias("spots"),
        F.sort_array(F.collect_list(F.when(~in_table, F.struct("_pos", "word")))).alias("words"),
    )
    said = _said(F.transform("words", lambda w: w["word"]))
    filled = by_cell.select(*key, said.alias("value"), F.inline("spots"))
    # A table's cells are listed in its own block, so they also fit into one row here.
    return filled.groupBy(*key, "table_id").agg(
        F.sort_array(F.collect_list(F.struct("row", "col", "_pos", "value"))).alias("_cells")
    )


def _grid(tables: DataFrame, key: Sequence[str]) -> DataFrame:
    """All positions of each table; of two cells at one position the later one counts."""
    largest = lambda field: F.array_max(F.transform("_cells", lambda c: c[field]))
    sized = tables.withColumns({"_rows": largest("row"), "_cols": largest("col")})
    cols = F.col("_cols")
    place = lambda c: (c["row"] - 1) * cols + c["col"] - 1

    def span(c: Column, i: Column) -> Column:
        """A cell with the positions from its own, the first from the table's start, up to the next cell."""
        following = F.coalesce(place(F.get("_cells", i + 1)), F.col("_rows") * cols)
        start = F.when(i == 0, F.least(F.lit(0), place(c))).otherwise(place(c))
        end = F.when(following == place(c), place(c) - 1).otherwise(F.greatest(following - 1, place(c)))
        return F.struct(c.alias("cell"), place(c).alias("place"), start.alias("start"), end.alias("end"))

    spans = sized.select(*key, "table_id", "_cols", F.inline(F.transform("_cells", span)))
    each = spans.select("*", F.explode(F.when(F.col("end") >= F.col("start"), F.sequence("start", "end"))).alias("_at"))
    at, own = F.col("_at"), F.col("_at") == F.col("place")
    value = F.col("cell.value")
    plain = begins_between(value, "!", "~") & F.substring(value.cast("binary"), -1, 1).between(F.lit(b"!"), F.lit(b"~"))
    return each.select(
        *key,
        "table_id",
        F.when(own, F.col("cell.row")).otherwise((F.floor(at / cols) + 1).cast("int")).alias("row"),
        F.when(own, F.col("cell.col")).otherwise((at % cols + 1).cast("int")).alias("col"),
        F.when(~own, "").when(plain, value).otherwise(strip(value)).alias("value"),
    )


# --- extraction runs ---------------------------------------------------------------------


def extraction_leaderboard(extractions: DataFrame, by: Sequence[str] = ("outil",)) -> DataFrame:
    """Per tool: files, successes, failures, pages, characters, tables, seconds."""
    ok = F.col("erreur").isNull() | (F.col("erreur") == "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return extractions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fichiers"),
        F.count_if(ok).alias("succes"),
        F.count_if(~ok).alias("echecs"),
        total("nb_pages"),
        total("nb_chars"),
        total("nb_tableaux"),
        F.sum(F.col("temps_secondes").cast("decimal(18,3)")).cast("double").alias("temps_total_s"),
    )


def distinct_paths(files: DataFrame, order: str, path: str = "path") -> DataFrame:
    """One row per path, the last one in ``order``; of equal places the last as JSON.  Rows may hold maps."""
    rest = [c for c in files.columns if c not in (path, order)]
    place = F.struct(order, F.to_json(F.struct(*rest)).alias("rest"))
    last = files.groupBy(path).agg(F.max_by(F.struct(order, *rest), place).alias("_r"))
    return last.select(path, "_r.*").select(*files.columns)
