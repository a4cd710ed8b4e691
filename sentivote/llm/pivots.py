"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots).  Vectors that share
enough pivots are candidates, and the cosine of every candidate pair is computed
exactly.  Shared pivots are counted inside inverted lists: pivots are put in one order, the rarest
first, and each vector enters the lists of all but its last few pivots; two vectors
with enough common pivots then meet in the list of their first common one, and are counted there only.

Long lists are cut into blocks of bounded size and the blocks are paired.  What leaves
a task is a number of links for each vector and a star of links per local group, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import column, components, local_roots, written
from sentivote.llm.prefix_forest import usable

#: Pairs at this cosine or above are links.
COSINE = 0.9
#: Pivots at least, nearest pivots that describe a vector then, and common ones that make a candidate.
PIVOTS, NEAREST, SHARED = 256, 12, 3
#: Vectors of an inverted list that more pivots are to keep, pivots at most, vectors of a block on average.
LIST, MOST_PIVOTS, BLOCK = 4096, 4096, 2048
#: Pivots taken from the data are less alike than this.
APART = 0.7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, wanted: int, width: int, seed: int = 3) -> np.ndarray:
    """Reference points: sampled vectors that are apart from each other, and random directions for the rest.

    A dense group of copies gives one pivot, so that its members are told apart from others, not from each other.
    """
    kept = np.empty((0, width))
    for v in unit(sample) if len(sample) else sample:
        if len(kept) >= wanted:
            break
        if not len(kept) or (kept @ v).max() < APART:
            kept = np.vstack([kept, v])
    more = np.random.default_rng(seed).standard_normal((wanted - len(kept), width))
    return np.vstack([kept, unit(more)]) if len(more) else kept


def verify_list(cosine: float, shared: int, pivots: int):
    """For one pair of blocks of one inverted list: links of each vector, and a star over each linked group."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        ids, copies, side = (rows[c].to_numpy(np.int64) for c in ("rep", "copies", "blk"))
        place, i, j = int(rows["place"].iloc[0]), int(rows["bi"].iloc[0]), int(rows["bj"].iloc[0])
        vectors = unit(np.stack(rows["vector"].to_numpy()))
        has = np.zeros((len(rows), pivots), np.float32)
        has[np.arange(len(rows))[:, None], np.stack(rows["pivots"].to_numpy())] = 1
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, us, vs = np.zeros(len(ids), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(a), 512):
            x = a[at : at + 512]
            before = has[x, :place] @ has[b, :place].T
            common = has[x, place:] @ has[b, place:].T
            met = (before == 0) & (common >= shared)
            if i == j:
                met &= b[None, :] > x[:, None]
            p, q = np.nonzero(met)
            for cut in range(0, len(p), 100_000):
                u, v = x[p[cut : cut + 100_000]], b[q[cut : cut + 100_000]]
                close = np.einsum("ij,ij->i", vectors[u], vectors[v]) >= cosine
                us.append(u[close])
                vs.append(v[close])
        u, v = np.concatenate(us), np.concatenate(vs)
        np.add.at(links, u, copies[v])
        np.add.at(links, v, copies[u])
        return pd.DataFrame({"rep": ids, "links": links, "root": ids[local_roots(len(ids), (u, v))]})

    return work


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    pivots: int | None = None,
    nearest: int | None = None,
    shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """One row per id: id, n_links, component_id, kept.

    ``n_links`` counts the other vectors at ``cosine`` or above, ``component_id`` is the smallest
    id in reach over links, ``kept`` whether that is the vector's own.  Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.  Rows without an
    id are left out; rows that repeat an id count once, with the smallest usable vector.  Equal vectors are
    compared once.  All vectors must have one length.
    """
    vectors = usable(df, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    same = vectors.select("id", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("vector"))
    members = written(same.withColumn("h", F.xxhash64("vector")), "vectors")
    classes = members.groupBy("h", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "vector-classes")
    n = classes.count()
    if pivots is None:
        pivots = PIVOTS
        while pivots < MOST_PIVOTS and n * (NEAREST - shared + 1) > pivots * LIST:
            pivots *= 2
    nearest = nearest or NEAREST + 2 * max(0, (pivots // PIVOTS).bit_length() - 1)
    drawn = [r["vector"] for r in classes.orderBy("h", "rep").limit(4 * pivots).collect()]
    width = len(drawn[0]) if drawn else 1
    points = choose_pivots(np.array(drawn, np.float64).reshape(-1, width), pivots, width)

    @F.pandas_udf("array<int>")
    def describe(part: pd.Series) -> pd.Series:
        if not len(part):
            return pd.Series([], dtype=object)
        near = unit(np.stack(part.to_numpy())) @ points.T
        return pd.Series(list(np.sort(np.argpartition(-near, nearest - 1, axis=1)[:, :nearest], axis=1).astype(np.int32)))

    described = written(classes.select("rep", "copies", "vector", describe("vector").alias("near")), "described")
    sizes = {r["p"]: r["n"] for r in described.select(F.explode("near").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(pivots), key=lambda p: (sizes.get(p, 0), p))
    rank = F.array(*[F.lit(r) for r in np.argsort(order).tolist()])
    ranked = described.select("rep", "copies", "vector", F.array_sort(F.transform("near", lambda p: F.get(rank, p))).alias("pivots"))
    ranked = written(ranked, "ranked")
    posted = F.explode(F.slice("pivots", 1, nearest - shared + 1)).alias("place")
    blocks = ranked.select(posted).groupBy("place").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    lists = ranked.select("rep", "copies", "vector", "pivots", posted).join(F.broadcast(blocks), "place")  # at most `pivots` rows
    lists = lists.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = lists.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "rep", "copies", "vector", "pivots", "place", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj")
    )
    found = paired.groupBy("place", "bi", "bj").applyInPandas(verify_list(cosine, shared, pivots), "rep long, links long, root long")
    found = written(found.where("links > 0"), "vector-links")
    links = written(found.groupBy("rep").agg(F.sum("links").alias("links")), "vector-link-counts")
    # copies of a vector reach their class, classes reach each other
    hubs = members.join(classes, ["h", "vector"]).select("id", "rep", "copies")
    roots = written(components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "vector-groups"), "vector-roots")
    out = hubs.join(links, "rep", "left").join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = df.select(column(df, id_col).cast("long").alias("id")).where("id is not null").distinct()
    return every.join(out, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("component_id", "id") == F.col("id")).alias("kept"),
    )
