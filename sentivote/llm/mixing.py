"""Mixing sources to target weights.

Words are counted per source in one aggregate.  The total of the mix is shared among
the sources by weight; a source whose share would repeat it too often stops at its limit,
and what it leaves goes to the others by weight, until no source is above its limit.
Target by size is a source's repetition rate.  Each of its documents is emitted
floor(rate) times, and once more with the fraction as probability, drawn from a hash of its id.

Sources may be few or many: they are numbered by ranges, and shared out by aggregates
that return two sums.  Only tables of checked size are broadcast, and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.functions import ranking
from sentivote.llm.common import column, fresh, written

#: Weights of the sources, in order and over again.
WEIGHTS = (3, 1, 2)
#: Size of the mix in per cent of all sizes, and how often a source may be repeated.
SHARE, MOST = 150, 2
#: Seed of the draws.
SEED = 12
#: Sources up to this number are broadcast to the documents (some 100 bytes each).
BROADCAST_ROWS = 100_000

#: A word is a run of what is neither a blank nor one of the control characters from tab to carriage return.
WORD_RUN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    one_each = F.regexp_replace(text, WORD_RUN, "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(one_each)).otherwise(0).cast("long")


def draw(key: Column, seed: int = SEED) -> Column:
    """A number of 52 bits from the digest of seed and key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    """src, n_docs, source_size of the rows (src, size)."""
    return sized.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))


def weighed(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Adds ``weight``: the weights dealt over and over to the sources by code point, null last."""
    ordered = sources.withColumn("last", F.col("src").isNull())
    placed = ranking.numbered(ordered, ["last", "src"], "place")
    dealt = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return placed.select("src", "n_docs", "source_size", dealt.alias("weight"))


def targeted(sources: DataFrame, share: int = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target``: words of the mix that come from the source.

    ``sources`` (src, source_size, weight) is a written table.  The sources at their limit are those whose
    limit is at most ``level`` words per unit of weight; each round finds the level that shares what they leave.  The
    rounds end when no source is added to them.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    if share > 100 * most:
        raise ValueError("the share is above what the limit allows")
    wanted = total * share / 100
    limit = F.col("source_size") * most
    at_limit, level = -1, (0.0, 1)
    while True:
        per_weight = limit * F.lit(level[1]) <= F.col("weight") * F.lit(level[0])
        # before the first round nothing but empty sources is at its limit
        stopped = limit == 0 if at_limit < 0 else per_weight
        n, held, free = sources.agg(
            F.count_if(stopped), F.sum(F.when(stopped, limit).otherwise(0)), F.sum(F.when(~stopped, F.col("weight")).otherwise(0))
        ).first()
        if n == at_limit or not free:
            break
        at_limit, level = n, (wanted - held, free)
    target = F.col("weight") * F.lit(float(level[0])) / F.lit(level[1])
    capped = F.when(limit <= target, limit.cast("double")).otherwise(target)
    return sources.withColumn("target", capped)


def goals(sized: DataFrame, weights: Sequence[int], share: int, most: int) -> DataFrame:
    """src, source_size, target of the rows (src, size); broadcast where it has few enough rows."""
    sources = written(weighed(written(source_sizes(sized), "sources"), weights), "weights")
    goal = written(targeted(sources, share, most), "targets").select("src", "source_size", "target")
    return F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal


def draw_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What a row's draw hashes: its id, or a digest of its text where it has none."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    return F.coalesce(column(docs, id_col).cast("string"), F.sha2(text, 256))


def copies(size: Column, target: Column, key: Column, seed: int = SEED) -> Column:
    """How often a document is emitted: floor(rate) times, and once more if its draw is below the fraction.

    ``size`` and ``target`` are those of its source.
    """
    rate = F.when(size > 0, target / size).otherwise(0.0)
    whole = F.floor(rate)
    extra = draw(key, seed) < (rate - whole) * float(1 << 52)
    return whole + extra.cast("long")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: int = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, size (words), source_size, target (both of its source), copies, taken (size times copies).

    A null source is a source of its own, the last; an empty one is another.  A null or wordless
    text has size 0: it's copied at its source's rate and takes nothing.  A source without
    words has target 0.  A row without an id is drawn by its text.  Repeated rows share
    their draw.  An empty table gives no row.  Other columns of ``docs`` play no part.
    """
    text = column(docs, text_col).cast("string")
    rows = docs.select(
        column(docs, id_col).alias("id"), column(docs, source_col).cast("string").alias("src"),
        n_words(column(docs, text_col).cast("string")).alias("size"), draw_key(docs, id_col, text_col).alias("key"),
    )
    sized = written(rows, "sizes")
    goal = goals(sized, weights, share, most)
    joined = sized.join(goal, sized["src"].eqNullSafe(goal["src"])).drop(goal["src"])
    times = copies(F.col("source_size"), F.col("target"), F.col("key"), seed)
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"))


def emitted(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: int = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` says, and a last column ``copy`` that counts them from 0.

    The rate is a property of the source and the draw one of the id, so the copies are made where the row is
    read.  If ``docs`` has a column of that name, the new one is called ``_copy``, and so on.
    """
    src = column(docs, source_col).cast("string")
    goal = goals(docs.select(src.alias("src"), n_words(column(docs, text_col).cast("string")).alias("size")), weights, share, most)
    times = copies(goal["source_size"], goal["target"], draw_key(docs, id_col, text_col), seed)
    names = [column(docs, c) for c in docs.columns]
    counted = docs.join(goal, src.eqNullSafe(goal["src"])).where(times > 0)
    return counted.select(*names, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias(fresh(docs, "copy")))


