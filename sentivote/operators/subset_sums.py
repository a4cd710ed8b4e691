"""Leave-k-out without a row per subset: every subset's vote is counted inside its segment's row.

``sensitivity.leave_k_out`` lists a segment's subsets as rows, which is right where the subsets themselves are asked
for.  Change rates and stability only need how many subsets of each size change the label.  Here a subset's
sums are those of the subset without its last model, plus that model's weight: arrays double model by model.  The
first models are grown to starting points, and each starting point is grown over the last ``INNER`` models by
itself, so a row holds 2 ** INNER sums at a time however many models there are.  Weights are added in model order,
as the listed form adds them, so sums and ties are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.numbers import percent, ticks
from sentivote.functions.text import let, quoted
from sentivote.operators import sensitivity

#: Models that are grown within one starting point; memory per row, not a limit on models.
INNER = 10

Categories = Sequence[str]


def _weights(n: int, categories: Categories) -> Column:
    """Per model its bit and its squared confidence for each category it voted for, else zero."""
    models = []
    for i in range(n):
        conf = F.coalesce(F.col(f"conf_{i}"), F.lit(0.0))
        voted = [F.getbit(F.col(f"mask_{c}"), F.lit(n - 1 - i)).cast("double") * (conf * conf) for c in range(len(categories))]
        models.append(_entry(F.lit(1 << (n - 1 - i)).cast("long"), voted))
    return F.array(*models)


def _entry(members: Column, sums: Sequence[Column]) -> Column:
    return F.struct(members.alias("members"), *[s.alias(f"s{c}") for c, s in enumerate(sums)])


def _grown(start: Column, models: Column, n_categories: int) -> Column:
    """``start`` with every subset of ``models`` added: array by number of added models, each an array of entries."""
    none = F.filter(F.array(start), lambda e: F.lit(False))

    def add(by_size: Column, model: Column) -> Column:
        def taken(e: Column) -> Column:
            return _entry(e["members"] + model["members"], [e[f"s{c}"] + model[f"s{c}"] for c in range(n_categories)])

        def of_size(j: Column) -> Column:
            without = F.coalesce(F.get(by_size, j), none)
            return F.concat(without, F.transform(F.coalesce(F.get(by_size, j - 1), none), taken))

        return F.transform(F.sequence(F.lit(0), F.size(by_size)), of_size)

    return F.aggregate(models, F.array(F.array(start)), add)


def _label(e: Column, categories: Categories) -> Column:
    """As the listed form: the largest sum wins, on equal sums the category of the earlier model."""
    candidates = []
    for n, c in enumerate(categories):
        voters = e["members"].bitwiseAND(F.col(f"mask_{n}"))
        candidates.append(F.when(voters != 0, F.struct(e[f"s{n}"].alias("s"), voters.alias("f"), F.lit(c).alias("c"))))
    return F.coalesce(F.greatest(*candidates)["c"], F.lit("Description"))


def changes(folded: DataFrame, models: Sequence[str], categories: Categories = tuple(vocab.CATEGORIES), inner: int = INNER) -> DataFrame:
    """The folded rows of ``sensitivity.fold`` with ``changes``: for k = 1 .. n-1 the subsets without k models that change the label.

    No exchange, no row per subset.  A single model has no proper subset: the array is empty.  The work per
    row is 2 ** n votes; a row's memory is 2 ** ``inner`` sums and one short array per starting point.
    """
    n = len(models)
    if n > sensitivity.MOST_SUBSET_MODELS:
        raise ValueError(f"subsets of at most {sensitivity.MOST_SUBSET_MODELS} models can be numbered, got {n}")
    if n < 2:
        return folded.withColumn("changes", F.array().cast("array<bigint>"))
    split = max(n - inner, 0)
    width = len(categories)
    zero = _entry(F.lit(0).cast("long"), [F.lit(0.0)] * width)

    def changed(by_size: Column, label: Column) -> Column:
        return F.transform(by_size, lambda es: F.size(F.filter(es, lambda e: _label(e, categories) != label)).cast("long"))

    def without(k: Column, starts: Column) -> Column:
        return F.aggregate(
            starts, F.lit(0).cast("long"),
            lambda total, s: total + F.coalesce(F.get(s["more"], F.lit(n) - k - s["kept"]), F.lit(0).cast("long")),
        )

    def per_k(weights: Column, label: Column) -> Column:
        first, last = F.slice(weights, 1, split), F.slice(weights, split + 1, n - split)

        def counted(start: Column) -> Column:
            return F.struct(
                F.bit_count(start["members"]).alias("kept"), changed(_grown(start, last, width), label).alias("more")
            )

        starts = F.transform(F.flatten(_grown(zero, first, width)), counted)
        return let(starts, lambda s: F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: without(k, s)))

    def whole(weights: Column) -> Column:
        added = lambda a, m: _entry(a["members"] + m["members"], [a[f"s{c}"] + m[f"s{c}"] for c in range(width)])
        return _label(F.aggregate(weights, zero, added), categories)

    # bound by let: a column of an inner select would be put back into the loops and made anew at each subset
    per_row = let(_weights(n, categories), lambda w: let(let(w, whole), lambda label: per_k(w, label)))
    return folded.withColumn("changes", per_row)


def change_rates(folded: DataFrame, models: Sequence[str], key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """The rows of ``sensitivity.change_rates``, from the folded rows themselves."""
    n = len(models)
    listed = changes(folded, models).select(*key, F.posexplode("changes").alias("_at", "nb_changes"))
    sizes = F.array(*[F.lit(comb(n, k)).cast("long") for k in range(1, max(n, 2))])
    sized = listed.select(*key, (F.col("_at") + 1).alias("k"), F.get(sizes, F.col("_at")).alias("nb_combinations"), "nb_changes")
    return sized.withColumn("pct_change", percent(F.col("nb_changes"), F.col("nb_combinations"), 1))


def with_stability(folded: DataFrame, models: Sequence[str]) -> DataFrame:
    """The folded rows with ``sensitivity.with_stability``'s score, without grouping anything back."""
    n = len(models)
    if n < 2:
        return folded.withColumn("stability_score", F.lit(100.0))
    tenths = F.lit(0)
    for k in range(1, n):
        tenths = tenths + ticks(percent(F.get("changes", F.lit(k - 1)), F.lit(comb(n, k)), 1), 1)
    counted = changes(folded, models)
    return counted.select(*quoted(folded.columns), sensitivity._score(tenths, F.lit(n - 1)).alias("stability_score"))
