"""Helpers shared by the operators: written tables, word hashes, shingles, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate tables.

    Only a session on one machine that names none, as in tests, gets its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="sentivote-llm-"))
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and go on from the written copy."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a written table of a few numbers that are sent to every task, at most: some 20 MB.
FEW_ROWS = 250_000


def if_few(table: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case: ``stem``, or ``stem`` behind underscores."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def slices(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``most`` bytes of text, never inside a row."""
    sizes = batch.column(text).nbytes
    step = max(1, batch.num_rows * most // max(sizes, 1))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow array in turn; never all of them as Python strings."""
    for text in texts:
        yield text.as_py()


def code_points(text: str) -> np.ndarray:
    """Code points of ``text`` in lower case."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_kinds: dict[str, np.ndarray] = {}


def kinds_of(rule: str) -> np.ndarray:
    """Kind of every code point, 0 for what separates tokens.

    ``words``: 0 white space, 1 the rest.  ``tokens``: also tells word characters (1) from others (2).
    """
    if rule not in _kinds:
        every = np.arange(0x110000, dtype=np.uint32).view("U1")
        space, inside = np.strings.isspace(every), np.strings.isalnum(every)
        inside[ord("_")] = True
        _kinds["words"] = np.where(space, 0, 1).astype(np.uint8)
        _kinds["tokens"] = np.where(space, 0, np.where(inside, 1, 2)).astype(np.uint8)
    return _kinds[rule]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_factors(n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers without pattern."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Factors of the places in a token, and of the places in a shingle.
_PLACE, _ORDER = odd_factors(4096), odd_factors(64)[::-1].copy()


def token_hashes(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """64-bit hashes of the maximal runs of one kind, separators left out, in text order."""
    if not len(points):
        return np.empty(0, np.uint64)
    kind = kinds[points]
    starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    lengths = np.diff(starts, append=len(points))
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    factors = _PLACE if longest <= len(_PLACE) else odd_factors(longest)
    total = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * factors[place], starts)
    return mixed(total[kind[starts] > 0])


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of ``text``: lower case, cut at white space."""
    return token_hashes(code_points(text or ""), kinds_of("words"))


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` successive words, in text order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _ORDER[0]
    for i in range(1, width):
        total += words[i : i + n] * _ORDER[i]
    return mixed(total)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, a text without words none."""
    words = word_hashes(text)
    if 0 < len(words) < width:
        return runs_of(words, len(words))
    return np.unique(runs_of(words, width))


def local_roots(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest index in reach of each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, pairs[0], root[pairs[1]])
        np.minimum.at(new, pairs[1], root[pairs[0]])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): node, component = smallest node in reach.

    Alternating large-star and small-star steps.  A node's smallest neighbour
    is an aggregate that shrinks on the map side.  It is written before it is handed
    out, so that the join reads both sides from a shuffle and can be split where a
    node is hot: no neighbourhood is gathered in one place.  Each round is a written
    table; the number of rounds grows with the logarithm of the largest component.
    """
    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    # an edge points from the larger to the smaller node
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name
    )
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        # large star: neighbours above u point to the smallest around u
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(smallest, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), name)
        # small star: neighbours below u, and u, point to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # now every node but the root points to the root of its component
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
