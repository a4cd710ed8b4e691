"""Segmentation: documents to tokens, sentences, phrases, paragraphs, segments.

Everything up to the final ``explode`` happens inside the document's own row,
so a segmentation job is a map over the corpus without an exchange.

Grouping consecutive lines (text blocks, sections, tables) is done by writing
each line with the separator its kind asks for and cutting the result again:
a text line ends in a blank, everything else in a line break, and a title line
starts with a tab.  Text never contains a line break and never starts with
whitespace here, so the marks cannot be mistaken for content, and the work is
linear in the length of the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sentivote.functions import text as T
from sentivote.operators.clean import fence_pieces

# --- fixed values: line patterns and thresholds ------------------------------
HEADING = rf"(?d)^(#{{1,6}}){T.WS}+(.+)"
BULLET = rf"(?d)^[-*+]{T.WS}+(.+)"
NUMBERED = rf"(?d)^\p{{Nd}}+\.{T.WS}+(.+)"
SEPARATOR_LIKE = rf"^[|\-:{T.WS_RANGES}]+$"
SENTENCE_END = rf"([.!?…]{T.WS}+)"
MIN_MERGE_CHARS = 80
MIN_SEGMENT_CHARS = 30
DEFAULT_SECTION = "Introduction"
# --- end of fixed values -----------------------------------------------------

TITLE_MARK = "\t"
BULLET_MARK = " "
_CHUNK = 512  # sentences per inner array in the merge fold

SentenceSplitter = Callable[[Column], Column]


def document_keys(docs: DataFrame) -> list[str]:
    """The columns that go with each row found in a document."""
    return [c for c in docs.columns if c not in ("text", "_pieces", "_known")]


# --- tokens -------------------------------------------------------------------


def _outside_lines(text: Column) -> Column:
    """Stripped lines outside code; the fence lines themselves stay."""
    pieces = F.transform(
        fence_pieces(text),
        lambda lines, i: F.when(i % 2 == 1, F.slice(lines, 1, 1)).otherwise(lines),
    )
    return F.transform(F.flatten(pieces), T.strip)


def _without_table_separators(lines: Column) -> Column:
    """Drop separator rows that continue a table.

    One letter per line - (t)able, (f)ence, (s)eparator-like, (o)ther - makes
    the table state a pattern over a short string: a separator continues a
    table when only fences and separators lie between it and a table line.
    """
    letter = lambda s: (
        F.when(s.startswith("```"), "f").when(s.startswith("|"), "t")
        .when((s.startswith("-") | s.startswith(":")) & s.rlike(SEPARATOR_LIKE), "s").otherwise("o")
    )

    def without(lines: Column, letters: Column) -> Column:
        marked = F.regexp_replace(letters, r"((?:t|(?!^)\G)f*)s", "$1x")
        paired = F.zip_with(lines, F.split(marked, ""), lambda s, k: F.struct(s.alias("s"), k.alias("k")))
        kept = F.filter(paired, lambda p: p["s"].isNotNull() & (p["k"] != "x"))
        return F.transform(kept, lambda p: p["s"])

    def read(lines: Column) -> Column:
        letters = F.array_join(F.transform(lines, letter), "")
        return T.let(letters, lambda k: F.when(k.contains("s"), without(lines, k)).otherwise(lines))

    return T.let(lines, read)


def _write_line(s: Column) -> Column:
    """One stripped line in the marked form described in the module docstring."""
    def marked(mark: Column, payload: Column) -> Column:
        cleaned = T.clean_inline(T.strip(payload))
        return T.let(
            cleaned, lambda c: F.when(c == "", "\n").otherwise(F.concat(F.lit("\n"), mark, c, F.lit("\n")))
        )

    level = F.length(F.regexp_extract(s, HEADING, 1)).cast("string")
    heading = marked(F.concat(F.lit(TITLE_MARK), level), F.regexp_extract(s, HEADING, 2))
    item = F.when(s.rlike(BULLET), F.regexp_extract(s, BULLET, 1)).otherwise(F.regexp_extract(s, NUMBERED, 1))
    bullet = marked(F.lit(BULLET_MARK), item)
    plain = T.let(T.clean_inline(s), lambda c: F.when(c == "", "").otherwise(F.concat(c, F.lit(" "))))
    is_bullet = T.begins_between(s, "*", "-") & s.rlike(BULLET)
    is_numbered = ~T.begins_between(s, "A", "z") & s.rlike(NUMBERED)
    return (
        F.when(s.startswith("```") | s.startswith("|") | (s == ""), "\n")
        .when(s.startswith("![") | T.is_url_only(s), "")
        .when(s.startswith("#") & s.rlike(HEADING), heading)
        .when(is_bullet | is_numbered, bullet)
        .otherwise(plain)
    )


def marked_text(text: Column) -> Column:
    lines = _without_table_separators(_outside_lines(text))
    return F.array_join(F.transform(lines, _write_line), "")


def read_piece(piece: Column) -> Column:
    """A piece of marked text between line breaks as (kind, level, text)."""
    is_title = piece.startswith(TITLE_MARK)
    is_bullet = piece.startswith(BULLET_MARK)
    return F.struct(
        F.when(is_title, "title").when(is_bullet, "bullet").otherwise("text").alias("kind"),
        F.when(is_title, F.substring(piece, 2, 1).cast("int")).alias("level"),
        F.when(is_title, F.substring(piece, 3, 2**31 - 1))
        .when(is_bullet, F.substring(piece, 2, 2**31 - 1))
        .otherwise(T.strip(piece))
        .alias("text"),
    )


def token_array(text: Column) -> Column:
    """Array of (kind, level, text) in document order."""
    tokens = F.transform(F.filter(F.split(marked_text(text), "\n"), lambda p: p != ""), read_piece)
    return F.filter(tokens, lambda t: (t["kind"] != "text") | ~T.is_noise(t["text"]))


def tokens(docs: DataFrame) -> DataFrame:
    keys = document_keys(docs)
    return docs.select(*keys, F.posexplode(token_array(F.col("text"))).alias("tok_pos", "tok")).select(
        *keys, "tok_pos", "tok.kind", "tok.level", "tok.text"
    )


# --- sentences ----------------------------------------------------------------


def rule_pieces(block: Column) -> Column:
    """Cut a block after sentence punctuation; each piece keeps its gap."""
    return F.filter(F.split(F.regexp_replace(block, SENTENCE_END, "$1\n"), "\n"), lambda p: p != "")


def merge_short(block: Column, pieces: Column, min_chars: int = MIN_MERGE_CHARS) -> Column:
    """Greedy left-to-right merge of sentences shorter than ``min_chars``.

    A short sentence takes the next one as long as its merged text still occurs
    literally in the block, with the next sentence behind it.  Where single
    blanks join the sentences to the block again, that always holds and a merge
    ends at the first boundary at or behind ``min_chars``: one expression finds
    them all, in linear time.  Other blocks are folded sentence by sentence.
    """
    group = rf"(?s)(.{{{min_chars},}}?(?=\n|\z)|.+)(?:\n|\z)"

    def merge(found: Column) -> Column:
        groups = F.regexp_extract_all(F.array_join(found, "\n"), F.lit(group), 1)
        regular = F.transform(groups, lambda g: F.replace(g, F.lit("\n"), F.lit(" ")))
        return F.when(F.array_join(found, " ") == block, regular).otherwise(_fold_short(block, pieces, min_chars))

    return T.let(F.transform(pieces, T.strip), merge)


def _fold_short(block: Column, pieces: Column, min_chars: int) -> Column:
    """The merge, step by step.

    The block is searched only after a gap that is not a single blank; finished
    sentences are collected in chunks to keep the appends cheap.
    """
    fields = ["full", "out", "cur", "literal", "blank_gap"]
    no_text = F.array().cast("array<string>")

    def state(*cols: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(cols, fields)])

    def push(acc: Column) -> tuple[Column, Column]:
        grown = F.concat(acc["out"], F.array(acc["cur"]))
        is_full = F.size(acc["out"]) >= _CHUNK - 1
        return (
            F.when(is_full, F.concat(acc["full"], F.array(grown))).otherwise(acc["full"]),
            F.when(is_full, no_text).otherwise(grown),
        )

    def in_sequence(cur: Column, nxt: Column) -> Column:
        at = F.position(cur, block)
        return (at > 0) & (F.position(nxt, block, at + F.length(cur)) > 0)

    def step(acc: Column, piece: Column) -> Column:
        sentence = T.strip(piece)
        blank_gap = piece == F.concat(sentence, F.lit(" "))
        takes = (F.length(acc["cur"]) < min_chars) & (acc["literal"] | in_sequence(acc["cur"], sentence))
        joined = F.concat(acc["cur"], F.lit(" "), sentence)
        full, out = push(acc)
        return (
            F.when(acc["cur"].isNull(), state(acc["full"], acc["out"], sentence, F.lit(True), blank_gap))
            .when(takes, state(acc["full"], acc["out"], joined, acc["literal"] & acc["blank_gap"], blank_gap))
            .otherwise(state(full, out, sentence, F.lit(True), blank_gap))
        )

    def finish(acc: Column) -> Column:
        full, out = push(acc)
        return F.when(acc["cur"].isNull(), no_text).otherwise(F.concat(F.flatten(full), out))

    empty = state(
        F.array().cast("array<array<string>>"), no_text, F.lit(None).cast("string"), F.lit(True), F.lit(True)
    )
    return F.aggregate(pieces, empty, step, finish)


def sentences(block: Column, splitter: SentenceSplitter = rule_pieces) -> Column:
    """Sentences of a block after merging; a block without any yields itself."""
    return T.let(
        block,
        lambda b: T.let(
            merge_short(b, splitter(b)), lambda out: F.when(F.size(out) == 0, F.array(b)).otherwise(out)
        ),
    )


Split = Callable[[str, str | None], list[str]]


def with_model_pieces(docs: DataFrame, load: Callable[[], Split], lang: str | None = None) -> DataFrame:
    """Let user code, such as a sentence model, cut the text blocks.

    ``load()`` runs once per task and returns a function from a block and the
    document's language (the column ``lang``) to its sentences.  The distinct
    blocks of a document travel to Python as one array; ``_pieces`` maps each to
    its sentences, and ``model_splitter`` reads them there.
    """
    blocks = F.transform(F.filter(token_array(F.col("text")), lambda t: t["kind"] == "text"), lambda t: t["text"])
    sent = docs.withColumn("_blocks", F.array_distinct(blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = load()
        for batch in batches:
            langs = batch[lang] if lang else [None] * len(batch)
            batch["_cut"] = [
                ["\n".join(" ".join(s.split("\n")) for s in split(b, code)) for b in row]
                for row, code in zip(batch["_blocks"], langs)
            ]
            yield batch

    schema = StructType([*sent.schema.fields, StructField("_cut", ArrayType(StringType()))])
    cut = sent.mapInPandas(run, schema)
    return cut.withColumn("_pieces", F.map_from_arrays("_blocks", "_cut")).drop("_blocks", "_cut")


def model_splitter(block: Column) -> Column:
    """Splitter for documents that went through ``with_model_pieces``."""
    return F.filter(F.split(F.try_element_at(F.col("_pieces"), block), "\n"), lambda p: T.strip(p) != "")


# --- sections, phrases, paragraphs ---------------------------------------------


def section_array(text: Column, splitter: SentenceSplitter = rule_pieces) -> Column:
    """Array of (title, phrases): section 0 comes before the first title.

    ``title`` is null there and where the title is noise; phrases are stripped
    and free of noise, not yet deduplicated.
    """

    def phrases_of(pieces: Column) -> Column:
        units = F.flatten(
            F.transform(
                pieces,
                lambda p: F.when(p.startswith(BULLET_MARK), F.array(F.substring(p, 2, 2**31 - 1))).otherwise(
                    T.let(
                        T.strip(p),
                        lambda b: F.when(T.is_noise(b), F.array().cast("array<string>")).otherwise(
                            sentences(b, splitter)
                        ),
                    )
                ),
            )
        )
        return F.filter(F.transform(units, T.strip), lambda u: ~T.is_noise(u))

    def read(section: Column, ordinal: Column) -> Column:
        def with_lines(lines: Column) -> Column:
            title = F.when(ordinal > 0, F.substring(F.element_at(lines, 1), 2, 2**31 - 1))
            body = F.when(ordinal > 0, F.slice(lines, 2, F.size(lines))).otherwise(lines)
            return F.struct(
                F.when(~T.is_noise(title), title).alias("title"),
                phrases_of(F.filter(body, lambda p: p != "")).alias("phrases"),
            )

        return T.let(F.split(section, "\n"), with_lines)

    return F.transform(F.split(marked_text(text), "\n" + TITLE_MARK), read)


def _first_of_each(items: Column) -> Column:
    """Of structs led by ``fp`` keep the smallest of each ``fp``."""
    return T.let(
        F.sort_array(items),
        lambda s: F.filter(s, lambda x, j: (j == 0) | (x["fp"] != F.get(s, j - 1)["fp"])),
    )


def _listed(sections: Column) -> Column:
    """Titles and phrases in order."""
    return F.flatten(
        F.transform(
            sections,
            lambda s: F.when(s["title"].isNull(), s["phrases"]).otherwise(
                F.concat(F.array(s["title"]), s["phrases"])
            ),
        )
    )


def phrase_array(sections: Column) -> Column:
    """Distinct phrases of a document in order of first appearance, titles included."""
    keyed = F.transform(
        _listed(sections), lambda p, i: F.struct(T.fingerprint(p).alias("fp"), i.alias("pos"), p.alias("phrase"))
    )
    by_position = F.transform(_first_of_each(keyed), lambda e: F.struct(e["pos"], e["phrase"]))
    return F.transform(F.sort_array(by_position), lambda e: e["phrase"])


def phrases_flat(docs: DataFrame, splitter: SentenceSplitter = rule_pieces) -> DataFrame:
    """One row per distinct phrase of a document, ``phrase_index`` from 0."""
    keys = document_keys(docs)
    found = phrase_array(section_array(F.col("text"), splitter))
    return docs.select(*keys, F.posexplode(found).alias("phrase_index", "phrase"))


def paragraph_array(sections: Column) -> Column:
    """Array of (paragraph_index, section_title, phrases).

    Each section contributes its phrases and then its title as events; an event
    counts when it is the first of its fingerprint in the document.  A section
    is emitted when one of its phrases or its title event counts.
    """

    def events_of(s: Column, j: Column) -> Column:
        phrases = F.transform(
            s["phrases"],
            lambda p, k: F.struct(
                T.fingerprint(p).alias("fp"), j.alias("sec"), F.lit(0).alias("closing"), k.alias("pos"), p.alias("text")
            ),
        )
        no_title = s["title"].isNull()
        close = F.struct(
            F.when(no_title, F.concat(F.lit("-"), j.cast("string"))).otherwise(T.fingerprint(s["title"])).alias("fp"),
            j.alias("sec"),
            F.lit(1).alias("closing"),
            F.lit(0).alias("pos"),
            s["title"].alias("text"),
        )
        return F.concat(phrases, F.array(close))

    def marked(events: Column) -> Column:
        return F.transform(
            events,
            lambda e, i: F.struct(
                e["sec"],
                e["closing"],
                e["pos"],
                ((i == 0) | (e["fp"] != F.get(events, i - 1)["fp"])).alias("first"),
                e["text"],
            ),
        )

    def write(e: Column) -> Column:
        emitted = F.when(e["first"] & e["text"].isNotNull(), "1").otherwise("0")
        return (
            F.when(e["closing"] == 1, F.concat(F.lit(TITLE_MARK), emitted, F.coalesce(e["text"], F.lit("")), F.lit("\n\n")))
            .when(e["first"], F.concat(e["text"], F.lit("\n")))
            .otherwise("")
        )

    def read(section: Column) -> Column:
        return T.let(
            F.split(section, "\n"),
            lambda lines: F.struct(
                F.substring(F.element_at(lines, -1), 3, 2**31 - 1).alias("section_title"),
                (F.substring(F.element_at(lines, -1), 2, 1) == "1").alias("title_counts"),
                F.slice(lines, 1, F.size(lines) - 1).alias("phrases"),
            ),
        )

    events = F.flatten(F.transform(sections, events_of))
    in_order = F.sort_array(T.let(F.sort_array(events), marked))
    cut = F.split(F.array_join(F.transform(in_order, write), ""), "\n\n")
    emitted = F.filter(
        F.transform(F.filter(cut, lambda p: p != ""), read),
        lambda p: p["title_counts"] | (F.size(p["phrases"]) > 0),
    )
    return F.transform(
        emitted,
        lambda p, i: F.struct(
            i.alias("paragraph_index"),
            p["section_title"].alias("section_title"),
            F.transform(
                p["phrases"], lambda x, k: F.struct(k.alias("phrase_index"), x.alias("phrase"))
            ).alias("phrases"),
        ),
    )


def paragraphs(docs: DataFrame, splitter: SentenceSplitter = rule_pieces) -> DataFrame:
    """One row per paragraph with its phrases as an array of structs."""
    keys = document_keys(docs)
    found = paragraph_array(section_array(F.col("text"), splitter))
    return docs.select(*keys, F.inline(found))


def paragraph_phrases(paragraphs_df: DataFrame) -> DataFrame:
    """Normalised twin of ``paragraphs``: one row per phrase, null when there is none."""
    keys = [c for c in paragraphs_df.columns if c != "phrases"]
    return paragraphs_df.select(*keys, F.inline_outer("phrases"))


def phrase_counts(docs: DataFrame, splitter: SentenceSplitter = rule_pieces) -> DataFrame:
    """Distinct fingerprints over titles and phrases of each document's paragraphs.

    The first title or phrase of a fingerprint always makes it into a paragraph, so those of the sections are the same.
    """
    keys = document_keys(docs)
    distinct = F.size(F.array_distinct(F.transform(_listed(section_array(F.col("text"), splitter)), T.fingerprint)))
    return docs.select(*keys, distinct.alias("n_phrases"))


def full_text(phrases: Column, limit: int | None = None) -> Column:
    """Phrases of a paragraph joined by blanks, cut to ``limit`` for a prompt."""
    joined = F.array_join(F.transform(phrases, lambda p: p["phrase"]), " ")
    return joined if limit is None else F.substring(joined, 1, limit)


def paragraph_contexts(paragraphs_df: DataFrame) -> DataFrame:
    """One row per paragraph: its text once, and an array of what gets classified.

    ``units`` holds the title as phrase -1, then the phrases.  Paragraphs
    without phrases are skipped, so a bare title is never classified.
    """
    keys = [c for c in paragraphs_df.columns if c != "phrases"]
    title = F.struct(F.lit(-1).alias("phrase_index"), F.col("section_title").alias("phrase"))
    units = F.when(F.col("section_title") == "", F.col("phrases")).otherwise(
        F.concat(F.array(title), F.col("phrases"))
    )
    return paragraphs_df.filter(F.size("phrases") > 0).select(
        *keys, full_text(F.col("phrases")).alias("full_paragraph"), units.alias("units")
    )


def scored_units(paragraphs_df: DataFrame) -> DataFrame:
    """The units of ``paragraph_contexts``, one row each.

    The paragraph's text isn't repeated on them; it is found there, under the same key.
    """
    contexts = paragraph_contexts(paragraphs_df)
    keys = [c for c in contexts.columns if c not in ("full_paragraph", "units")]
    return contexts.select(*keys, F.inline("units"))


def segment_report(phrases: DataFrame, key: list[str]) -> DataFrame:
    """Phrases per file, and the corpus total in the row marked ``is_total``."""
    return (
        phrases.rollup(F.struct(*key).alias("file"))
        .agg(F.count(F.lit(1)).alias("n_phrases"), F.grouping_id().alias("level"))
        .select(*[F.col(f"file.{k}").alias(k) for k in key], (F.col("level") == 1).alias("is_total"), "n_phrases")
    )


# --- simple segments -------------------------------------------------------------


def simple_segments(docs: DataFrame, min_chars: int = MIN_SEGMENT_CHARS) -> DataFrame:
    """Paragraphs between blank lines and titles, at least ``min_chars`` long."""
    keys = document_keys(docs)

    def write(s: Column) -> Column:
        title = T.strip(F.regexp_replace(s, "^#+", ""))
        return (
            F.when(s.startswith("#"), F.concat(F.lit("\n" + TITLE_MARK), title, F.lit("\n")))
            .when(s == "", "\n")
            .otherwise(F.concat(s, F.lit(" ")))
        )

    lines = F.transform(F.split("text", "\n"), T.strip)
    cut = F.split(F.array_join(F.transform(lines, write), ""), "\n" + TITLE_MARK)

    def read(section: Column, ordinal: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            title = F.when(ordinal == 0, DEFAULT_SECTION).otherwise(F.element_at(pieces, 1))
            body = F.when(ordinal == 0, pieces).otherwise(F.slice(pieces, 2, F.size(pieces)))
            long_enough = F.filter(F.transform(body, T.strip), lambda p: F.length(p) >= min_chars)
            return F.transform(
                long_enough, lambda p: F.struct(title.alias("section_title"), p.alias("paragraph"))
            )

        return T.let(F.split(section, "\n"), with_pieces)

    found = F.flatten(F.transform(cut, read))
    return docs.select(*keys, F.posexplode(found).alias("paragraph_index", "seg")).select(
        *keys, "paragraph_index", "seg.section_title", "seg.paragraph"
    )
