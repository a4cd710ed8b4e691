"""Cleaning and segmentation of documents that are too large for one row.

A document is stored as blocks of whole lines, (keys..., ``block_no``, ``text``).  The line
readers have little state: inside a code fence or not, inside a table or not, a text
block left open or not.  So a block is read once for what it does to each state it can be
entered in, these transitions are composed in block order over rows of a few numbers, and
then every block is read by itself with its entry state put before it as a line.  What
crosses a border, an open text block or a run of empty lines, is joined there alone.

Results equal those of the row form at any block size.  One sentence-bearing text block is
still one value.  Blocks without text are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivote.functions import ranking
from sentivote.functions import text as T
from sentivote.operators import segment
from sentivote.operators.clean import surviving_lines
from sentivote.session import checkpointed

FENCE, TABLE = "```\n", "|\n"


def keys_of(blocks: DataFrame) -> list[str]:
    return [c for c in blocks.columns if c not in ("block_no", "text")]


def split_documents(docs: DataFrame, lines_per_block: int) -> DataFrame:
    """Documents in rows as blocks of so many lines."""
    keys = segment.document_keys(docs)
    lines = F.split("text", "\n")
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(lines) / lines_per_block).cast("int") - 1),
        lambda b: F.array_join(F.slice(lines, b * lines_per_block + 1, F.lit(lines_per_block)), "\n"),
    )
    return docs.where("text is not null").select(*keys, F.posexplode(blocks).alias("block_no", "text"))


def in_order(keys: Sequence[str]):
    """The window over the blocks before a block."""
    return Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)


def _ends_in_table(text: Column) -> Column:
    """Whether the lines outside code leave a table open; null if they leave the state as it was."""
    def last(lines: Column) -> Column:
        passing = lambda s: s.startswith("```") | ((s != "") & ~s.startswith("|") & s.rlike(segment.SEPARATOR_LIKE))
        return F.try_element_at(F.filter(lines, lambda s: ~passing(s)), F.lit(-1)).startswith("|")

    return last(segment._outside_lines(text))


def entry_states(blocks: DataFrame) -> DataFrame:
    """keys, block_no, in_code, in_table: the state that each block is entered in."""
    keys = keys_of(blocks)
    fences = F.size(F.filter(F.split("text", "\n"), lambda s: T.strip(s).startswith("```")))
    moves = blocks.where("text is not null").select(
        *keys, "block_no", fences.alias("fences"), _ends_in_table(F.col("text")).alias("from_text"),
        _ends_in_table(F.concat(F.lit(FENCE), F.col("text"))).alias("from_code"),
    )
    before = in_order(keys)
    entered = moves.withColumn("in_code", F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2 == 1)
    left = F.when(F.col("in_code"), F.col("from_code")).otherwise(F.col("from_text"))
    tables = F.coalesce(F.last(left, ignorenulls=True).over(before), F.lit(False))
    return entered.select(*keys, "block_no", "in_code", tables.alias("in_table"))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> list[Column]:
    return [left[c].eqNullSafe(right[c]) for c in names]


def _entered(blocks: DataFrame) -> DataFrame:
    """The blocks with their entry states; texts are moved if the states aren't few enough to be sent to them."""
    states = checkpointed(entry_states(blocks))
    names = [*keys_of(blocks), "block_no"]
    return blocks.join(states, _same(blocks, states, names)).drop(*[states[c] for c in names])


def clean_blocks(blocks: DataFrame, protect_bullets: bool = False) -> DataFrame:
    """Cleaned blocks; those of a document joined by line breaks are its cleaned text.

    Blocks of which nothing is left are dropped.
    """
    keys = keys_of(blocks)
    start = F.when(F.col("in_code"), F.lit(FENCE)).otherwise("")
    lines = surviving_lines(F.concat(start, F.col("text")), protect_bullets)
    own = F.slice(lines, F.when(F.col("in_code"), 2).otherwise(1), F.size(lines))
    read = _entered(blocks).select(*keys, "block_no", own.alias("lines"))
    joined = read.select(*keys, "block_no", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("joined"))
    body = F.regexp_replace(F.btrim("joined", F.lit("\n")), r"\n{3,}", "\n\n")
    bodies = checkpointed(
        joined.select(*keys, "block_no", "n", body.alias("body"), F.col("joined").startswith("\n").alias("head"), F.col("joined").endswith("\n").alias("tail"))
    )
    full, solid = F.col("body") != "", T.strip(F.col("body")) != ""
    facts = bodies.select(
        *keys, "block_no", full.alias("full"), solid.alias("solid"), (full & F.col("head")).alias("head"),
        F.when(full, F.col("tail")).otherwise(F.col("n") > 0).cast("int").alias("blank"),
    )
    before, whole = in_order(keys), Window.partitionBy(*keys)
    facts = facts.withColumn("blanks", F.coalesce(F.sum("blank").over(before), F.lit(0)))
    # empty lines since the last block with text, that block's own last ones included
    since = F.last(F.when(F.col("full"), F.col("blanks")), ignorenulls=True).over(before)
    facts = facts.withColumns({"since": since, "last_solid": F.max(F.when(F.col("solid"), F.col("block_no"))).over(whole)})
    kept = facts.where("full and block_no <= last_solid").select(
        *keys, "block_no", F.col("since").isNull().alias("first"), (F.col("block_no") == F.col("last_solid")).alias("last"),
        (F.col("since").isNotNull() & (F.col("head") | (F.col("blanks") > F.col("since")))).alias("gap"),
    )
    kept = checkpointed(kept)
    names = [*keys, "block_no"]
    found = bodies.join(kept, _same(bodies, kept, names)).drop(*[kept[c] for c in names])
    ends = F.lit(T._WS_CHARS)
    text = F.when(F.col("first"), F.ltrim("body", ends)).otherwise(F.col("body"))
    return found.withColumn("text", text).withColumn(
        "text", F.concat(F.when(F.col("gap"), "\n").otherwise(""), F.when(F.col("last"), F.rtrim("text", ends)).otherwise(F.col("text")))
    ).select(*names, "text")


def tokens_of_blocks(blocks: DataFrame) -> DataFrame:
    """keys, block_no, piece_no, kind, level, text: the tokens of documents, in the order of the two numbers.

    A text block that goes over borders has the numbers of its first part.
    """
    keys = keys_of(blocks)
    state = F.concat(F.when(F.col("in_table"), F.lit(TABLE)).otherwise(""), F.when(F.col("in_code"), F.lit(FENCE)).otherwise(""))
    # every marked text begins with a break of its own
    marked = F.substring(segment.marked_text(F.concat(state, F.col("text"))), 2, 2**31 - 1)
    cut = checkpointed(_entered(blocks).select(*keys, "block_no", F.split(marked, "\n").alias("pieces")))
    last = F.size("pieces") - 1
    inner = cut.where(last > 1).select(*keys, "block_no", F.posexplode(F.slice("pieces", F.lit(2), last - 1)).alias("at", "piece"))
    inner = inner.select(*keys, "block_no", (F.col("at") + 1).alias("piece_no"), "piece")
    # the first piece goes on where the last block with a break left off
    before = in_order(keys)
    borders = cut.select(*keys, "block_no", last.alias("last"), F.get("pieces", F.lit(0)).alias("head"), F.when(last > 0, F.get("pieces", last)).alias("tail"))
    open_at = F.struct(F.col("block_no"), F.col("last").alias("piece_no"))
    begins = F.struct(F.first("block_no").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("block_no"), F.lit(0).alias("piece_no"))
    # before the first break all hangs on the first block
    head_of = F.coalesce(F.last(F.when(F.col("last") > 0, open_at), ignorenulls=True).over(before), begins)
    heads = borders.select(*keys, head_of.alias("of"), "block_no", F.lit(0).alias("side"), F.col("head").alias("piece"))
    tails = borders.where("last > 0").select(*keys, open_at.alias("of"), "block_no", F.lit(1).alias("side"), F.col("tail").alias("piece"))
    joined = heads.union(tails).groupBy(*keys, "of").agg(F.sort_array(F.collect_list(F.struct("block_no", "side", "piece"))).alias("parts"))
    crossing = joined.select(*keys, "of.block_no", "of.piece_no", F.array_join(F.col("parts.piece"), "").alias("piece"))
    pieces = inner.unionByName(crossing).where("piece <> ''")
    found = pieces.select(*keys, "block_no", "piece_no", segment.read_piece(F.col("piece")).alias("t")).select(*keys, "block_no", "piece_no", "t.*")
    return found.where((F.col("kind") != "text") | ~T.is_noise(F.col("text")))


def phrases_of_blocks(blocks: DataFrame, splitter: segment.SentenceSplitter = segment.rule_pieces) -> DataFrame:
    """keys, phrase_index, phrase: as ``segment.phrases_flat``, for documents in blocks.

    The first of equal phrases is an aggregate, and phrases are numbered by ranges, so no
    document is gathered in one task.
    """
    keys = keys_of(blocks)
    units = F.when(F.col("kind") == "text", segment.sentences(F.col("text"), splitter)).otherwise(F.array("text"))
    spoken = tokens_of_blocks(blocks).select(*keys, "block_no", "piece_no", F.posexplode(units).alias("unit_no", "unit"))
    spoken = spoken.withColumn("phrase", T.strip(F.col("unit"))).where(~T.is_noise(F.col("phrase")))
    place = ["block_no", "piece_no", "unit_no"]
    first = spoken.groupBy(*keys, T.fingerprint(F.col("phrase")).alias("fp")).agg(F.min(F.struct(*place, "phrase")).alias("f"))
    kept = checkpointed(first.select(*keys, "f.*"))
    return ranking.numbered(kept, place, "phrase_index", keys).select(*keys, F.col("phrase_index").cast("int").alias("phrase_index"), "phrase")
