"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree orders the vectors by a long string of hash bits, the sides of random
hyperplanes.  A query descends each tree to its longest matching prefix.  Then all trees
ascend together: the matched prefix is shortened by one bit at a time, and the
vectors under it join the candidates, until there are enough of them.  The candidates'
nearness is then computed exactly.

Equal vectors are one class, with its smallest ids.  Nearly equal ones, that fall on the same side of
the first hyperplanes, count as one towards "enough", so a large group doesn't end the ascent
before others are met.

Hash bits see angles only.  Where lengths differ, a candidate's length times the cosine that its longest
prefix allows bounds its inner product, and the candidates with the largest bounds are taken.

The classes are dealt to shards of bounded size by a hash, the queries to blocks,
and each pair of a shard and a block is one task's work; a query's nearest of all shards
are merged by a window that drops what is beyond the wanted number before it is moved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivote.llm.common import column, written

#: Trees, bits of a hash string.
TREES, BITS = 48, 48
#: Ascent ends when this share of a shard's vectors, or WANTED times the neighbours asked for, are candidates.
SHARE, WANTED = 0.45, 64
#: Vectors whose directions share so many bits of the first tree count as one towards the end of the ascent.
ALIKE = 24
#: Chance that a vector at the cosine taken for a prefix isn't met with a longer one; ratio between classes of length, as a logarithm.
SLIP, STEP = 0.01, 0.1
#: Distinct vectors of a shard, and of queries in a block, on average.
SHARD, BLOCK = 8192, 8192


class Forest:
    """Sorted arrays of hash strings over one shard of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees * bits, vectors.shape[1]))
        codes = self.codes(vectors)
        cells = codes[0] >> np.uint64(max(bits - ALIKE, 0))
        _, at, sizes = np.unique(cells, return_inverse=True, return_counts=True)
        #: What a row adds to the number of unlike vectors.
        self.share = 1 / sizes[at]
        self.unlike = len(sizes)
        # cosine of a row whose longest prefix in all trees has so many bits, at most but for SLIP; ever above 0, so that length counts
        p = (1 - SLIP ** (1 / trees)) ** (1 / np.arange(1, bits + 2))
        self.cosine = np.maximum(np.cos(np.pi * (1 - p)), np.arange(1, bits + 2) * 4e-4)
        largest = np.abs(vectors).max(axis=1)
        length = np.log(largest) + np.log(np.linalg.norm(vectors / largest[:, None], axis=1))
        step = np.floor((length.max() - length) / STEP + 1e-6)
        self.even = not step.any()
        #: Lengths, the largest as 1, in classes.
        self.length = np.exp(-STEP * step)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Hash strings (tree, row) as whole numbers, first bit highest."""
        out = np.empty((self.trees, len(x)), np.uint64)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for t in range(self.trees):
            side = x @ self.planes[t * self.bits : (t + 1) * self.bits].T > 0
            out[t] = side @ weights
        return out

    def candidates(self, queries: np.ndarray, enough: int, unlike: int):
        """For each query the mask of its candidates, after the synchronous ascent to ``enough`` rows, ``unlike`` of them unlike."""
        codes = self.codes(queries)
        low = np.empty((self.trees, self.bits + 1, len(queries)), np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            for length in range(self.bits + 1):
                shift = np.uint64(self.bits - length)
                first = (codes[t] >> shift) << shift
                low[t, length] = np.searchsorted(self.sorted[t], first, side="left")
                high[t, length] = np.searchsorted(self.sorted[t], first + ((np.uint64(1) << shift) - np.uint64(1)), side="right")
        for q in range(len(queries)):
            mask, longest = np.zeros(len(self.vectors), bool), np.full(len(self.vectors), -1, np.int16)
            before = np.zeros(self.trees, np.int32)
            for length in range(self.bits, -1, -1):
                a, b = low[:, length, q], high[:, length, q]
                if self.even and (b - a).sum() < enough and length:
                    continue  # too few, even if all of them differ
                for t in np.flatnonzero(b - a > before):
                    mask[self.order[t, a[t] : b[t]]] = True
                before = b - a
                sure = mask
                if not self.even:
                    longest[mask & (longest < 0)] = length
                    if length:  # what is met later is bounded by this
                        sure = mask & (self.length * self.cosine[longest] >= self.cosine[length - 1])
                if int(np.count_nonzero(sure)) >= enough and self.share[sure].sum() >= unlike - 1e-6:
                    break
            if not self.even:
                bound = np.where(mask, self.length * self.cosine[longest], -1)
                order = np.argsort(-bound, kind="stable")
                last = max(enough - 1, int(np.searchsorted(np.cumsum(self.share[order]), unlike - 1e-6)))
                mask &= bound >= bound[order[min(last, len(order) - 1)]]
            yield q, mask


def nearest(
    forest: Forest, ids: np.ndarray, heads: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, share: float, wanted: int
) -> pd.DataFrame:
    """Each query's ``k`` nearest candidates by inner product, ties to the smaller id.

    ``ids`` are the smallest of each class of equal vectors, ``heads`` its ``k`` smallest.
    """
    enough, unlike = (min(n, max(int(share * n), wanted * k)) for n in (len(ids), forest.unlike))
    several = np.array([len(h) > 1 for h in heads], bool)
    out_q, out_v, out_s = [], [], []
    for q, mask in forest.candidates(queries, enough, unlike):
        found = np.flatnonzero(mask)
        score = forest.vectors[found] @ queries[q]
        if len(found) > k:
            # the last bits of this product differ between like rows, so the edge leaves room for them
            edge = np.partition(score, len(score) - k)[len(score) - k]
            found = found[score >= edge - 1e-9 * max(np.abs(score).max(), np.finfo(float).tiny)]
        # sums row by row, so that ties go by id
        score = np.einsum("ij,j->i", forest.vectors[found], queries[q])
        best = np.lexsort((ids[found], -score))[:k]
        found, score = found[best], score[best]
        got = ids[found]
        if several[found].any():
            got, score = np.concatenate([heads[f] for f in found]), np.repeat(score, [len(heads[f]) for f in found])
            best = np.lexsort((got, -score))[:k]
            got, score = got[best], score[best]
        out_q.append(np.full(len(got), query_ids[q]))
        out_v.append(got)
        out_s.append(score)
    empty = np.empty(0, np.int64)
    return pd.DataFrame({
        "asked": np.concatenate([empty, *out_q]), "vec_id": np.concatenate([empty, *out_v]), "score": np.concatenate([empty.astype(float), *out_s]),
    })


def usable(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """id long, vector array<double>, ``more``: rows with an id and a finite vector that isn't null, empty or zero."""
    out = df.select(column(df, id_col).cast("long").alias("id"), column(df, vector_col).cast("array<double>").alias("vector"), *more)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return out.where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", bad), F.lit(True))
        & F.exists("vector", lambda x: x != 0)
    )


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    bits: int = BITS,
    share: float = SHARE,
    wanted: int = WANTED,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query row among all other rows.

    Nearness is the largest inner product in double precision on the vectors as
    they are; a query with fewer candidates than ``k`` gets them all.  Rows without an id, and vectors
    that are null, empty, zero or hold null or non-finite components, take no part.  Rows that repeat an
    id count once, with the smallest vector; all vectors must have one length.  Equal vectors are searched
    as one, then handed out by id.
    ``is_query`` is a condition on the columns of ``df``.
    """
    flagged = df.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = usable(flagged, id_col, vector_col, "_query").groupBy("id").agg(F.min("vector").alias("vector"), F.max("_query").alias("_query"))
    members = written(rows.withColumn("h", F.xxhash64("vector")), "searched")
    # a query's own id may be among the nearest of its class, so one more is looked for
    most = k + 1
    first = Window.partitionBy("h", "vector").orderBy("id")
    heads = members.select("h", "vector", "id", F.row_number().over(first).alias("r")).where(F.col("r") <= most)
    classes = heads.groupBy("h", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("rep"))
    classes = written(classes, "searched-classes")
    # written, so that the join reads both sides from a shuffle and can split a class of many queries
    queries = written(members.where("_query").join(classes.select("h", "vector", "rep"), ["h", "vector"]).select("id", "rep"), "queries")
    asked = written(classes.join(queries.select("rep").distinct(), "rep").select(F.col("rep").alias("asked"), F.col("vector").alias("asking")), "asked")
    n, m = classes.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    part = lambda key, count, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = classes.select("rep", "ids", "vector", part("rep", shards, 1).alias("shard"), every(blocks).alias("block"))
    right = asked.select("asked", "asking", every(shards).alias("at"), part("asked", blocks, 2).alias("of"))

    def work(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"asked": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        rows = rows.sort_values("rep")
        forest = Forest(np.stack(rows["vector"].to_numpy()), trees, bits)
        ids, heads, result = rows["rep"].to_numpy(np.int64), [np.asarray(i, np.int64) for i in rows["ids"]], []
        for at in range(0, len(asking), 512):  # bounds the table of prefix ranges
            some = asking.iloc[at : at + 512]
            result.append(nearest(forest, ids, heads, np.stack(some["asking"].to_numpy()), some["asked"].to_numpy(np.int64), most, share, wanted))
        return pd.concat(result)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("at", "of")).applyInPandas(work, "asked long, vec_id long, score double")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    merged = found.select("*", F.row_number().over(order).alias("r")).where(F.col("r") <= most)
    lists = written(merged.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "nearest")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = queries.join(lists, F.col("rep") == F.col("asked")).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", "one.score")
