"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target text and one of all
raw text, give each document the logarithm of its importance weight.  Gumbel
noise on the logarithm and a cut at the k largest values draw k documents
without replacement: in proportion to their weights with the whole noise, in
proportion to weight ** (1 / TEMPERATURE) with that share of it.  By default it's
scaled down, so the draw is near to a cut at the k-th weight; README has held-out
figures for both.  What isn't drawn is rejected.  k is the number of documents above the weight that best parts the
labelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import code_points, column, fresh, kinds_of, mixed, one_by_one, slices, token_hashes, written

#: n-grams are hashed to this many buckets; the models are two counts for each.
BUCKETS = 1 << 14
#: Raw-distributed counts per bucket that the target model starts from.
PRIOR = 4
#: Labelled documents on which the target model and the cut are fitted, at most: those whose ids have the least hashes.
SAMPLE = 20_000
#: Seed of the Gumbel noise.
SEED = 17

#: Share of the Gumbel noise that is put on the log weights; 1 draws in proportion to the weights, 0 cuts at the k-th weight.
TEMPERATURE = 0.25

#: Stands for the second of two equal tokens.
_AGAIN = np.uint64(0x51ED270B)


def features(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of the tokens (runs of word or other characters, lower case, digits alike) and of pairs of neighbours.

    A token that follows its like is paired as "the same again", whatever it is.
    """
    points = code_points(text or "")
    points = np.where((points >= 48) & (points <= 57), np.uint32(48), points)
    h = token_hashes(points, kinds_of("tokens"))
    if not len(h):
        return np.empty(0, np.int64)
    pairs = mixed(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    pairs[h[1:] == h[:-1]] = _AGAIN
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def model_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-gram counts over ``rows`` (text string, target boolean)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for text, good in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
                    n = features(text, buckets)
                    np.add.at(raw, n, 1)
                    if good:
                        np.add.at(target, n, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    counted = rows.mapInArrow(work, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket; at most ``buckets`` rows reach the driver.

    Raw counts are add-one smoothed.  Target counts get ``PRIOR`` raw-distributed counts per
    bucket, so what the target text happens to lack weighs little where it is small.
    """
    raw, target = np.ones(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not target.any():  # no target text at all: nothing tells the two apart
        return np.zeros(buckets)
    target += PRIOR * buckets * raw / raw.sum()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weight(ratios: np.ndarray):
    """A column function: text -> log importance weight, null for a text without tokens."""
    table = ratios.astype(np.float64)

    @F.arrow_udf("double")
    def weigh(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = (features(t, len(table)) for t in one_by_one(texts))
            yield pa.array([float(table[f].sum()) if len(f) else None for f in found], pa.float64())

    return weigh


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key alone."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, name: str, k: int, bins: int = 2048, last: int = 5000) -> float | None:
    """The k-th largest of a double column, by counts over ever narrower ranges; no global sort."""
    if k <= 0:
        return None
    v = F.col(name)
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if n <= k:
        return low
    while True:
        inside = values.where(v.between(low, high))
        if n <= last or low == high:
            return inside.orderBy(v.desc()).limit(k).agg(F.min(v)).first()[0] if low < high else low
        width = (high - low) / bins
        if not low + width > low:
            return inside.groupBy(v.alias("v")).count().orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0]
        slot = F.least(F.floor((v - low) / width), F.lit(bins - 1))
        found = {r["s"]: r for r in inside.groupBy(slot.alias("s")).agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).collect()}
        for s in sorted(found, reverse=True):
            if found[s]["n"] >= k:
                n, low, high = found[s]["n"], found[s]["a"], found[s]["b"]
                break
            k -= found[s]["n"]


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, label: one row per labelled id, the largest where several differ."""
    label = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).cast("double").alias("label"))
    return label.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))


def fitted(docs: DataFrame, label: DataFrame, id_col: str, text_col: str, buckets: int) -> np.ndarray:
    """Log ratios of the buckets: the target is the text of ``label`` above 0, the raw text is all text.

    ``label`` is bounded, so its ids go to every task and no text is moved.
    """
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text")).where("text is not null")
    target = label.where("label > 0").select("id", F.lit(True).alias("target"))
    rows = texts.join(F.broadcast(target), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    return log_ratios(model_counts(rows, buckets), buckets)


def parting_weight(keys: DataFrame, label: DataFrame) -> float:
    """The log weight that parts labelled target documents from others with the fewest errors.

    Of equal cuts, the middle of the widest gap.
    """
    rows = keys.where("w is not null").join(F.broadcast(label), "id").select("w", "label").collect()
    if not rows:
        return -np.inf
    w, good = np.array([r["w"] for r in rows]), np.array([r["label"] > 0 for r in rows])
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    # errors of a cut before place i: target documents below it, others from it on
    errors = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum(~good[::-1])[::-1], [0]))
    edges = np.concatenate(([w[0] - 1], w, [w[-1] + 1]))
    gaps = edges[1:] - edges[:-1]
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(gaps[best])]
    return float((edges[at] + edges[at + 1]) / 2)


def weighted(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, temperature: float, seed: int) -> tuple[DataFrame, Column, Column]:
    """``docs`` and a last column with the log weight, that column, and the Gumbel key made of it."""
    name = fresh(docs, "w")
    scored = docs.withColumn(name, log_weight(ratios)(column(docs, text_col).cast("string")))
    weight = column(scored, name)
    return scored, weight, weight + temperature * gumbel(column(scored, id_col), seed)


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    k: int | None = None,
    buckets: int = BUCKETS,
    sample: int = SAMPLE,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> tuple[DataFrame, Column, DataFrame, float | None]:
    """``docs`` with their weights, the Gumbel key of its rows, a written table (id, w, key), the cut: key >= cut is drawn.

    Of ``sample`` labels at most, three quarters give the target text (those above 0) and one
    quarter the cut; the raw text is that of all rows.  ``k`` defaults to the number of documents above
    ``parting_weight``; the noise then settles who is drawn around the cut.

    A null text, or one without tokens, has no weight and is never drawn.  Without
    labels every other document is drawn.  Keys equal to the cut are all drawn;
    repeated rows share their noise and so their fate.
    """
    label = written(labelled(labels, id_col, label_col).orderBy(F.xxhash64("id"), "id").limit(sample), "labels")
    apart = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0
    ratios = fitted(docs, label.where(~apart), id_col, text_col, buckets)
    scored, weight, key = weighted(docs, ratios, id_col, text_col, temperature, seed)
    keys = written(scored.select(column(scored, id_col).alias("id"), weight.alias("w"), key.alias("key")), "keys")
    if k is None:
        k = keys.where(F.col("w") >= parting_weight(keys, label.where(apart))).count()
    return scored, key, keys, kth_largest(keys, "key", k)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: id, log_weight, gumbel_key, kept.  See ``resampled`` for the rules."""
    _, _, keys, cut = resampled(docs, labels, id_col, **options)
    kept = F.coalesce(F.col("key") >= cut, F.lit(False)) if cut is not None else F.lit(False)
    return keys.select(F.col("id").alias(id_col), F.col("w").alias("log_weight"), F.col("key").alias("gumbel_key"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs``, columns as they were."""
    scored, key, _, cut = resampled(docs, labels, id_col, **options)
    drawn = scored.where(key >= cut if cut is not None else F.lit(False))
    return drawn.select(*[column(scored, c) for c in docs.columns])
