"""Secrets in text, with DataFrame functions only.

Three base kinds are patterns.  The fourth, ``entropy``, looks at long runs of key
characters: a window slides over the run, the counts of its characters and the entropy
are updated by the one that enters and the one that leaves, and the run is reported if the
highest entropy reaches the bar of its character class, unless an allow-list names it.

Matches have no positions in Spark's functions, but ``split`` gives what lies between them, so
positions are sums of lengths.  The costly steps are guarded by one search per kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.functions.text import let
from sentivote.llm.common import column

# Patterns of the base kinds.
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: Kinds in the order of ties.
KINDS = ("assign", "access", "hex", "entropy")
#: Characters of the window, and so of a run at least.
WINDOW = 20
RUN = "[A-Za-z0-9+/=_-]{%d,}" % WINDOW
#: Bits per character that a window must reach, for runs of hexadecimal digits and for others.
HEX_BAR, KEY_BAR = 3.05, 3.85
# Runs that are no secrets.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "EXAMPLE|example|SAMPLE|sample|PLACEHOLDER|placeholder|CHANGEME|changeme|DUMMY|dummy",
    "0123456789|1234567890|abcdefghij|ABCDEFGHIJ",
    # no repeated group: it would recurse on runs of many parts
    "^[A-Za-z]+[-_/][A-Za-z][A-Za-z_/-]*[0-9]{0,4}$",
    "^[=_-]+$",
)


#: Numbers that are summed up one by one; there is one level of blocks of blocks for each of the levels.
_BLOCK, _LEVELS = 256, 1


def totals_before(sizes: Column, levels: int = _LEVELS) -> Column:
    """For each of an array of numbers the sum of those before it.

    A fold that gathers them would copy all it has at every number.  Here a number's own
    block is summed up to it, and the blocks before by the same rule one level up.
    """
    def before(numbers: Column, i: Column) -> Column:
        block = F.slice(numbers, i - i % _BLOCK + 1, i % _BLOCK) if levels else F.slice(numbers, F.lit(1), i)
        return F.aggregate(block, F.lit(0), lambda s, x: s + x)

    def of(numbers: Column) -> Column:
        if not levels:
            return F.transform(numbers, lambda x, i: before(numbers, i))
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(numbers) / _BLOCK).cast("int") - 1))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda s, x: s + x))
        return let(totals_before(sums, levels - 1), lambda t: F.transform(numbers, lambda x, i: F.get(t, (i / _BLOCK).cast("int")) + before(numbers, i)))

    return let(sizes, of)


def located(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (start, order, stop, kind, found) of the leftmost non-overlapping matches for which ``keep`` holds."""
    shape = "array<struct<start:int,ord:int,stop:int,kind:string,found:string>>"

    def spans(gaps: Column, matches: Column) -> Column:
        sizes = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (start + F.length(m)).alias("stop"), F.lit(kind).alias("kind"), m.alias("found")
            )

        every = let(totals_before(sizes), lambda before: F.transform(matches, lambda m, i: span(m, i, before)))
        return every if keep is None else F.filter(every, lambda s: keep(s["found"]))

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: let(F.split(text, pattern, -1), lambda gaps: spans(gaps, matches))
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(shape))


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits per character, of any ``window`` successive characters of an ASCII run."""
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def over(chars: Column) -> Column:
        return let(F.array_distinct(chars), lambda used: let(F.transform(chars, lambda c: F.array_position(used, c) - 1), lambda code: slide(code, F.size(used))))

    def slide(code: Column, width: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), width).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(code, i), F.get(code, i - window)
            # the weighted sum changes by the entering and the leaving count only
            n_in = F.get(state["n"], enters.cast("int"))
            n_out = F.get(state["n"], leaves.cast("int")) + F.when(enters == leaves, 1).otherwise(0)
            gain = weight(n_in + 1) - weight(n_in)
            loss = F.coalesce(weight(n_out) - weight(n_out - 1), F.lit(0.0))
            counts = F.transform(state["n"], lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0))
            return let(
                state["s"] + gain - loss,
                lambda s: F.struct(
                    counts.alias("n"), s.alias("s"),
                    F.when(i >= window - 1, F.greatest(state["best"], F.lit(math.log2(window)) - s / window)).otherwise(state["best"]).alias("best"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda s: s["best"])

    return let(F.filter(F.split(run, ""), lambda c: c != ""), over)


def suspicious(run: Column) -> Column:
    """Whether a run holds letters and digits, isn't allow-listed, and reaches the bar of its class."""
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    for allowed in ALLOWED:
        mixed = mixed & ~run.rlike(allowed)
    bar = F.when(run.rlike("^[0-9a-fA-F]+$"), HEX_BAR).otherwise(KEY_BAR)
    return F.when(mixed, window_entropy(run) >= bar).otherwise(False)


def spans_of(text: Column) -> Column:
    """All spans of a non-null text, by start, then kind."""
    value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 1)) >= 8
    return F.array_sort(F.concat(
        located(text, ASSIGN, "assign", value),
        located(text, ACCESS, "access"),
        located(text, HEX, "hex"),
        located(text, RUN, "entropy", suspicious),
    ))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans array<struct(kind, start, stop, found)> in code points, stop exclusive.  A null text has none."""
    spans = spans_of(F.coalesce(column(docs, text_col).cast("string"), F.lit("")))
    shown = F.transform("_s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))
    return docs.select(column(docs, id_col).alias(id_col), spans.alias("_s")).select(id_col, shown.alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, numbers of the base kinds, hash of the base spans, all spans as text.

    A null text counts as empty.  Repeated rows give repeated results; other columns play no part.
    The base kinds are the leftmost non-overlapping matches of each kind that pass its rule.
    """
    found = scanned(docs, id_col, text_col)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(id_col, *[of(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
