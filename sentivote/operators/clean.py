"""Corpus cleaning: documents in, cleaned documents out, no shuffle.

A document is one row, so its lines are handled inside that row with array
functions.  Exploding lines and windowing over them would ship the whole corpus
through an exchange only to glue each document together again.

The code-fence state needs no running sum either: the text is cut in front of
every fence line, after which piece 0 is outside, and every later piece starts
with its fence line and is inside when its ordinal is odd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.functions import text as T

FENCE_CUT = rf"\n(?={T.WS_IN_LINE}*```)"


def fence_pieces(text: Column) -> Column:
    """Array of line arrays; the first line of each piece is its fence line.

    Piece 0 has an empty pseudo line in that place.
    """
    cut = F.split(F.concat(F.lit("\n"), text), FENCE_CUT)
    return F.transform(cut, lambda piece: F.split(piece, "\n"))


def surviving_lines(text: Column, protect_bullets: bool = False) -> Column:
    """Cleaned lines of a document; fenced lines pass unchanged."""

    def keep(line: Column) -> Column:
        return T.let(T.strip(line), lambda s: ~T.is_rule_line(s) & ~T.is_image_only(s))

    def clean_piece(lines: Column, ordinal: Column) -> Column:
        body = F.slice(lines, 2, F.size(lines))
        cleaned = F.transform(F.filter(body, keep), lambda l: T.clean_markup(l, protect_bullets))
        fence = F.when(ordinal == 0, F.slice(lines, 1, 0)).otherwise(F.slice(lines, 1, 1))
        return F.when(ordinal % 2 == 1, lines).otherwise(F.concat(fence, cleaned))

    return F.flatten(F.transform(fence_pieces(text), clean_piece))


def clean_lines(docs: DataFrame, protect_bullets: bool = False) -> DataFrame:
    """One row per surviving line, numbered from 0 in document order."""
    keys = [c for c in docs.columns if c != "text"]
    return docs.select(
        *keys, F.posexplode(surviving_lines(F.col("text"), protect_bullets)).alias("line_no", "line")
    )


def clean_documents(docs: DataFrame, protect_bullets: bool = False) -> DataFrame:
    """Replace ``text`` by its cleaned form; add newline counts before and after.

    A null text cannot be cleaned: its row stays, flagged ``bad``.
    """
    keys = [c for c in docs.columns if c != "text"]
    joined = F.array_join(surviving_lines(F.col("text"), protect_bullets), "\n")
    cleaned = T.strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
    return docs.select(
        *keys,
        cleaned.alias("text"),
        T.newline_count(F.col("text")).alias("n_before"),
        F.col("text").isNull().alias("bad"),
    ).withColumn("n_after", T.newline_count(F.col("text")))


def clean_report(cleaned: DataFrame) -> DataFrame:
    """Corpus totals: files read, files failed, newlines before and after."""
    return cleaned.agg(
        F.count_if(~F.col("bad")).alias("files_ok"),
        F.count_if("bad").alias("files_failed"),
        F.coalesce(F.sum("n_before"), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n_after"), F.lit(0)).alias("lines_after"),
    )
