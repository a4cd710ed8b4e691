"""Row numbers over groups of any size, without one task per group.

A window over a whole group (or the whole table) puts it into one task.  Here
the ordered keys are cut into ranges first: the keys with the smallest hashes
serve as cut points, about one per shuffle partition, the same on every
evaluation.  Rows are counted per group and range, the counts give each range
its offset, and the window runs over one range of one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivote.functions.text import let, quoted

def search_step(df: DataFrame) -> int:
    """Side of the two-step search: about one range per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, math.isqrt(partitions) + 1)


def range_bounds(df: DataFrame, key: Sequence[str], step: int) -> DataFrame:
    """At most step * step - 1 keys of ``df`` in order, cut for a two-step search.

    ``coarse`` holds every step-th key, ``fine`` the keys between two of them.
    """
    keys = df.select(*key, F.xxhash64(*key).alias("_hash"))
    sampled = keys.orderBy("_hash", *key).limit(step * step - 1)
    ordered = sampled.agg(F.sort_array(F.collect_list(F.struct(*key))).alias("b"))
    coarse = F.filter("b", lambda _, i: (i + 1) % step == 0)
    fine = F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda g: F.slice("b", g * step + 1, step - 1))
    return ordered.select(F.struct(coarse.alias("coarse"), fine.alias("fine")).alias("bounds"))


def _range_of(key: Column, bounds: Column, step: int) -> Column:
    """How many of the bounds are not above the key."""
    passed = lambda of, k: F.size(F.filter(of, lambda b: b <= k))
    return let(
        key,
        lambda k: let(
            passed(bounds["coarse"], k), lambda c: c * step + passed(F.get(bounds["fine"], c), k)
        ),
    )


def numbered(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    group: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: position from 0 of each row in its group by ``order``.

    ``group`` plus ``order`` must identify a row; nulls are a group of their own, and come first in order.  ``df``
    is read three times; pass a written table when it is costly to compute.
    """
    key = [*group, *order]
    step = search_step(df)
    bounded = df.withColumn("_bounds", range_bounds(df, key, step).scalar())
    tagged = bounded.withColumn("_range", _range_of(F.struct(*key), F.col("_bounds"), step)).drop("_bounds")
    cell = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1
    return (
        tagged.join(offsets, [tagged[c].eqNullSafe(offsets[c]) for c in cell])
        .drop(*[offsets[c] for c in cell])
        .withColumn(name, F.col("_offset") + within)
        .drop("_range", "_offset")
        .select(*quoted(df.columns), name)
    )
