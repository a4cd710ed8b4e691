"""N-gram Jaccard join: MinHash bands, then exact verification.

Documents are sets of word shingles.  Equal sets are one class; classes are
compared.  Every tree gives a class a short string of MinHash values, and
classes that share the whole string in any tree are candidates.  The
strings are as long as a pair at the threshold can have them and be met with the
target recall; this length is fixed by the parameters, so the trees are bands and
no forest that adapts its prefixes to the data.  Candidates
are gathered to groups, and inside a group every pair is verified on its whole
shingle sets.

A group is cut into blocks of bounded size and the blocks are paired, so no task
holds a whole hot group.  Pairs are counted where they are verified: what leaves
a task is a number of links per class and a star of links per local group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import column, components, fresh, if_few, local_roots, mixed, shingle_set, slices, written

#: Pairs at this similarity or above are links.
SIMILARITY = 0.8
#: Words of a shingle.
WIDTH = 5
#: Trees (bands), the longest string that is tried, and the recall wanted for a pair at the threshold.
TREES, LONGEST, RECALL = 32, 10, 0.999
#: A block holds this many classes, or shingles, on average at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 400_000


def prefix_length(similarity: float, trees: int, longest: int, recall: float) -> int:
    """Shorten the matched prefix from ``longest`` until a pair at ``similarity`` is met with ``recall``.

    At the length d one tree meets the pair with probability similarity ** d.
    """
    d = longest
    while d > 1 and 1 - (1 - similarity**d) ** trees < recall:
        d -= 1
    return d


def forest_labels(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each tree the hash of its matched prefix; ``factors`` (trees, length) are odd multipliers."""
    trees, length = factors.shape
    flat = factors.reshape(-1)
    least = np.full(flat.shape, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * flat).min(axis=0), out=least)
    values = mixed(least.reshape(trees, length))
    label = np.arange(1, trees + 1, dtype=np.uint64)
    for k in range(length):
        label = mixed(label * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return label.view(np.int64)


def multipliers(trees: int, length: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, (trees, length), np.uint64) * np.uint64(2) + np.uint64(1)


def set_hash(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.bitwise_xor.reduce(mixed(s * np.uint64(3))), mixed(s + np.uint64(len(s))).sum(dtype=np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, length: int) -> DataFrame:
    """id, set hash (f1, f2), n_shingles, t0.. : one prefix label per tree.  Rows without id or words are left out."""
    names = [f"t{i}" for i in range(trees)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(trees, length)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, prints, sizes, labels = [], [], [], []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    s = shingle_set(text, width)
                    if len(s):
                        ids.append(i)
                        prints.append(set_hash(s))
                        sizes.append(len(s))
                        labels.append(forest_labels(s, factors))
                p = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
                l = np.array(labels, np.int64).reshape(-1, trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1])), pa.array(sizes, pa.int64())]
                    + [pa.array(np.ascontiguousarray(l[:, k])) for k in range(trees)],
                    names=["id", "f1", "f2", "n", *names],
                )

    chosen = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    schema = "id long, f1 long, f2 long, n long, " + ", ".join(f"{c} long" for c in names)
    return chosen.where("id is not null and text is not null").mapInArrow(work, schema)


def candidate_groups(classes: DataFrame, trees: int) -> DataFrame:
    """rep -> grp: classes that share a tree's prefix, directly or over others.  Lone classes are left out."""
    tries = classes.select("rep", F.posexplode(F.array(*[f"t{i}" for i in range(trees)])).alias("tree", "label"))
    nodes = tries.groupBy("tree", "label").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    edges = tries.join(nodes, ["tree", "label"]).select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    return components(edges, "candidates").select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles for all pairs of two lists of sets, by products of small 0/1 matrices."""
    sizes = [len(s) for s in left], [len(s) for s in right]
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(sizes[0])
    rows = np.repeat(np.arange(len(left)), sizes[0]), np.repeat(np.arange(len(right)), sizes[1])
    cols = place[:cut], place[cut:]
    both = np.zeros(len(values), bool)
    both[cols[0]] = True
    seen = np.zeros(len(values), bool)
    seen[cols[1]] = True
    both &= seen
    rank = np.cumsum(both) - 1
    kept = both[cols[0]], both[cols[1]]
    rows, cols = (rows[0][kept[0]], rows[1][kept[1]]), (rank[cols[0][kept[0]]], rank[cols[1][kept[1]]])
    order = np.argsort(cols[0], kind="stable"), np.argsort(cols[1], kind="stable")
    rows, cols = (rows[0][order[0]], rows[1][order[1]]), (cols[0][order[0]], cols[1][order[1]])
    total = np.zeros((len(left), len(right)), np.float32)
    step = max(256, 4_000_000 // max(len(left) + len(right), 1))
    for start in range(0, int(both.sum()), step):
        parts = []
        for k, n in ((0, len(left)), (1, len(right))):
            a, b = np.searchsorted(cols[k], [start, start + step])
            m = np.zeros((n, step), np.float32)
            m[rows[k][a:b], cols[k][a:b] - start] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def linked(common: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether common / union >= similarity, in whole numbers: the threshold is taken in ten-thousandths."""
    t = round(similarity * 10_000)
    return common * (10_000 + t) >= t * (left[:, None] + right[None, :])


def verify_block(similarity: float):
    """For one pair of blocks: links of each class, and a star over each group of linked classes."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        sets = [np.asarray(s).view(np.uint64) for s in rows["shingles"]]
        ids, side = rows["rep"].to_numpy(np.int64), rows["blk"].to_numpy(np.int64)
        copies, sizes = rows["copies"].to_numpy(np.int64), np.array([len(s) for s in sets], np.int64)
        i, j = int(rows["bi"].iloc[0]), int(rows["bj"].iloc[0])
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, us, vs = np.zeros(len(ids), np.int64), [], []
        if len(a) and len(b):
            hit = linked(shared_counts([sets[k] for k in a], [sets[k] for k in b]), sizes[a], sizes[b], similarity)
            if i == j:
                np.fill_diagonal(hit, False)
                links[a] += hit @ copies[b]
            else:
                links[a] += hit @ copies[b]
                links[b] += hit.T @ copies[a]
            x, y = np.nonzero(hit)
            us, vs = a[x], b[y]
        root = local_roots(len(ids), (np.asarray(us, np.int64), np.asarray(vs, np.int64)))
        return pd.DataFrame({"rep": ids, "links": links, "root": ids[root]})

    return work


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    width: int = WIDTH,
    trees: int = TREES,
    longest: int = LONGEST,
    recall: float = RECALL,
    block_classes: int = BLOCK_CLASSES,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: id, class_id, n_copies, n_links, component_id, kept.

    ``class_id`` is the smallest id with the same shingle set and ``n_copies``
    the number of those documents, ``n_links`` the number of other documents at
    ``similarity`` or above, ``component_id`` the smallest id in reach over links.

    A text shorter than ``width`` words is one shingle.  A null or wordless
    text links with nothing.  Rows without an id are left out.  Rows that repeat
    an id count as one document: the row with the smallest set hash.  Other
    columns of ``docs`` play no part.
    """
    length = prefix_length(similarity, trees, longest, recall)
    names = [f"t{i}" for i in range(trees)]
    sig = signatures(docs, id_col, text_col, width, trees, length)
    sig = written(sig, "signatures")
    members = written(sig.groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("f")).select("id", "f.f1", "f.f2"), "ids")
    # written, so that the join below reads both sides from a shuffle and can split a class that many documents share
    per_class = written(members.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    members = written(members.join(per_class, ["f1", "f2"]).select("id", "rep", "copies"), "members")
    # of an id's rows only the one that was chosen; equal sets have equal sizes and labels
    firsts = per_class.select(F.col("rep").alias("id"), "f1", "f2", "copies")
    classes = sig.join(firsts, ["id", "f1", "f2"]).groupBy(F.col("id").alias("rep"), "f1", "f2").agg(
        F.first("n").alias("n"), F.first("copies").alias("copies"), *[F.first(c).alias(c) for c in names]
    )
    classes = written(classes, "classes")
    groups = written(candidate_groups(classes, trees), "groups")
    sized = groups.join(classes.select("rep", "f1", "f2", "n", "copies"), "rep")
    volume = sized.groupBy("grp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_classes), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
    )
    placed = sized.join(volume, "grp").select(
        "rep", "f1", "f2", "grp", "copies", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("blk")
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                shingles, chosen = [], []
                for t, *f in zip(*(batch.column(c).to_pylist() for c in ("text", "f1", "f2"))):
                    s = shingle_set(t, width)
                    chosen.append(len(s) > 0 and np.array(set_hash(s), np.uint64).view(np.int64).tolist() == f)
                    if chosen[-1]:
                        shingles.append(s.view(np.int64))
                batch = batch.filter(pa.array(chosen, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("rep", "grp", "copies", "blocks", "blk")] + [pa.array(shingles, pa.list_(pa.int64()))],
                    names=["rep", "grp", "copies", "blocks", "blk", "shingles"],
                )

    # the candidates' rows are short: while they are few they go to the texts, else the texts are moved once
    placed = if_few(written(placed, "placed"))
    texts = docs.select(column(docs, id_col).cast("long").alias("rep"), column(docs, text_col).cast("string").alias("text"))
    texts = texts.join(placed, "rep").select("rep", "f1", "f2", "grp", "copies", "blocks", "blk", "text")
    rows = texts.mapInArrow(sets, "rep long, grp long, copies long, blocks int, blk int, shingles array<long>")
    if sig.count() > members.count():  # ids are repeated, so a class can be found on several rows
        rows = rows.dropDuplicates(["rep"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = rows.select("*", other).select(
        "rep", "grp", "copies", "blk", "shingles", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj")
    )
    found = paired.groupBy("grp", "bi", "bj").applyInPandas(verify_block(similarity), "rep long, links long, root long")
    found = written(found, "links")
    # written, so that a class of many copies can be split in the joins
    links = written(found.groupBy("rep").agg(F.sum("links").alias("links")), "link-counts")
    roots = written(components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "linked"), "linked-roots")
    out = (
        members.join(links, "rep", "left")
        .join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    every = docs.select(column(docs, id_col).cast("long").alias("id")).where("id is not null").distinct()
    return every.join(out, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("component_id", "id") == F.col("id")).alias("kept"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one document of each group of near copies, columns as they were.

    The document with the smallest id stays.  Rows without an id stay all; of rows that repeat an
    id, equal ones stay once and different texts count as documents of their own, one of them under the id
    and the others after all ids.
    """
    key, text = column(docs, id_col).cast("long"), column(docs, text_col).cast("string")
    # everything is settled on ids and hashes; the texts are read for the last join alone
    ids = written(docs.select(key.alias("id"), F.xxhash64(text).alias("h")).where("id is not null"), "text-hashes")
    repeated = ids.groupBy("id").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "first")
    repeated = written(repeated, "repeated-ids")
    name = fresh(docs, "key")
    if repeated.isEmpty():
        keyed, again = docs.withColumn(name, key), None
    else:
        few = if_few(repeated)
        own = few["first"].isNull() | (F.xxhash64(text) == few["first"])
        other = F.shiftrightunsigned(F.xxhash64(key, text), 2) + F.lit(1 << 62)
        again = few["id"].isNotNull()
        keyed = docs.join(few, key == few["id"], "left").select(
            *[column(docs, c) for c in docs.columns], F.when(own, key).otherwise(other).alias(name), again.alias(fresh(docs, "again"))
        )
    found = near_duplicates(keyed, name, text_col, **options)
    gone = if_few(written(found.where(~F.col("kept")).select(column(found, name).alias("gone")), "gone"))
    left = keyed.join(gone, column(keyed, name) == gone["gone"], "left_anti")
    names = [column(left, c) for c in docs.columns]
    if again is None:
        return left.select(*names)
    again = column(left, fresh(docs, "again"))
    return left.where(~again).select(*names).union(left.where(again).select(*names).dropDuplicates())
