"""Packing of token sequences into bins of several permitted lengths.

Sequences are dealt to shards of bounded size by a hash, and each shard is packed
by best-fit in order of decreasing length: a sequence goes to the open bin that it
fills best.  If none has room, a bin is opened, of the permitted length that costs
least for each token that it can be expected to hold.  In the end each bin shrinks to the
smallest permitted length that holds its contents.

What a sequence has beyond the longest permitted length is cut off in whole bins first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import column, written

#: Permitted lengths.
LENGTHS = (1024, 2048, 4096, 8192, 16384)
#: A bin of length L costs OVERHEAD + L + L * L / ATTENTION: a fixed part, one part per token, one for every pair.
OVERHEAD, ATTENTION = 64, 1 << 20
#: Sequences of a shard, on average.
SHARD = 20_000


def bin_cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + length + length * length / attention


def pack(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float] = bin_cost) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each sequence, and the final length of each bin.

    ``sizes`` are in decreasing order, from 1 to the largest of ``lengths``.
    """
    lengths = sorted(lengths)
    tail = np.concatenate((np.cumsum(np.asarray(sizes, np.int64)[::-1])[::-1], [0])).tolist()  # tokens from a place on
    rising = [-s for s in sizes]  # for the search of what fits in a gap
    bins, used, first = np.zeros(len(sizes), np.int64), [], []
    room: list[tuple[int, int]] = []  # (tokens left, bin), the least first
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            best = None
            for length in lengths:
                if length >= size:
                    gap = length - size
                    fits = tail[max(i + 1, bisect_left(rising, -gap))]  # tokens still to come that fit the gap
                    held = size + min(gap, fits)
                    price = cost(length) / held
                    if best is None or price < best[0]:
                        best = (price, length)
            left, b = best[1], len(used)
            used.append(0)
            first.append(best[1])
        bins[i] = b
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return bins, np.array(final, np.int64)


def packed(
    docs: DataFrame, id_col: str, size: Column, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = bin_cost, shard: int = SHARD,
) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin_id, bin_length, bin_start.

    ``size`` is the number of tokens of a row.  A row longer than the longest
    permitted length is cut into full pieces and a rest; ``piece`` counts them and ``start`` is where a piece
    begins in its sequence.  ``bin_start`` is where it lies in its bin.

    Rows of null size or size below 1 have nothing to pack and give no row.
    Repeated rows, and rows with a null id, are sequences of their own.  Other columns play no part.
    """
    most = max(lengths)
    key = column(docs, id_col)
    # rows without an id are dealt by their place
    salt = F.when(key.isNull(), F.monotonically_increasing_id()).alias("salt")
    rows = written(docs.select(key.alias("id"), size.cast("long").alias("size"), salt).where("size > 0"), "sizes")
    n = rows.count()
    shards = max(1, -(-n // shard))
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") - 1).cast("long"), F.lit(most).cast("long")))
    pieces = rows.select("id", "size", "salt", cuts.alias("start")).select(
        "id", (F.col("start") / most).cast("int").alias("piece"), "start",
        F.least(F.col("size") - F.col("start"), F.lit(most)).alias("n_tokens"),
        F.pmod(F.xxhash64("id", "start", "salt"), F.lit(shards)).cast("int").alias("shard"),
    )

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = group["n_tokens"].to_numpy(np.int64)
        bins, final = pack(sizes.tolist(), lengths, cost)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        starts = np.empty(len(sizes), np.int64)
        heads = np.searchsorted(bins[order], np.arange(len(final)))
        starts[order] = before - before[heads][bins[order]]
        return pd.DataFrame({
            "id": group["id"], "piece": group["piece"], "start": group["start"], "n_tokens": sizes,
            "bin_id": group["shard"].to_numpy(np.int64) * (1 << 32) + bins, "bin_length": final[bins], "bin_start": starts,
        })

    kind = pieces.schema["id"].dataType.simpleString()
    out = pieces.groupBy("shard").applyInPandas(
        work, f"id {kind}, piece int, start long, n_tokens long, bin_id long, bin_length long, bin_start long"
    )
    return out.withColumnRenamed("id", id_col)
