"""Target-distribution importance resampling on checksums of substrings.

A document is normalised to its words, joined by one separator, and scanned once for the
running CRC-32 at every word border.  The checksum of any run of words follows from the two
running values at its ends: the CRC of a whole is the CRC of its head, shifted over the
length of its tail, plus (in GF(2)) the CRC of the tail, so shifting the value at the
start by the run's length and adding the value at the end leaves the run's own.  A run is
never hashed, cut out or built as a string, whatever its length in words.

Checksums modulo a number of buckets are the features.  Two bucket counts, over all raw
and all target texts, give each bucket a gain in whole thousandths, a document's weight is the
mean gain of its features, and Gumbel noise from a hash of its id makes the highest scores a
draw in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivote.functions import ranking
from sentivote.llm.common import column, slices, written

#: Features are runs of 1 to this many words.
LONGEST = 1
#: Number of buckets.
BUCKETS = 10_000
#: Seed of the noise.
SEED = 2024
#: A document takes part in the draw from this many words on, and this share in per cent of them is drawn.
LEAST_WORDS, DRAWN = 20, 10

#: Fixed value: the polynomial of CRC-32, its bits reversed.
POLYNOMIAL = 0xEDB88320

_LETTERS_AND_DIGITS = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Every byte in lower case; a separator where it's neither letter nor digit nor part of a character beyond ASCII.
NORMAL = bytes(b if b >= 128 else c if (c := bytes([b]).lower()[0]) in _LETTERS_AND_DIGITS else 32 for b in range(256))


def _image(columns: list[int], value: int) -> int:
    """A linear map over GF(2), given by the images of its 32 unit vectors, applied to ``value``."""
    out = 0
    while value:
        low = value & -value
        out ^= columns[low.bit_length() - 1]
        value ^= low
    return out


def _through(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of the values of each of four bytes, applied to ``values``."""
    return table[0][values & 255] ^ table[1][values >> 8 & 255] ^ table[2][values >> 16 & 255] ^ table[3][values >> 24]


def shift_tables(levels: int) -> np.ndarray:
    """(levels, 64, 4, 256): the maps of a CRC over d zero bytes, over 64 d, and so on, for d below 64."""
    one_bit = [POLYNOMIAL, *[1 << i for i in range(31)]]
    one_byte = [1 << i for i in range(32)]
    for _ in range(8):
        one_byte = [_image(one_bit, v) for v in one_byte]
    same = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    unit = np.array([[_image(one_byte, int(v)) for v in row] for row in same], np.uint32)
    tables = []
    for _ in range(levels):
        level = [same]
        for _ in range(63):
            level.append(_through(level[-1], unit))
        unit = _through(level[-1], unit)
        tables.append(level)
    return np.array(tables, np.uint32)


def shifted(values: np.ndarray, lengths: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC as it is after as many zero bytes as its length says."""
    out = values
    for level, table in enumerate(tables):
        digit = lengths >> 6 * level & 63
        if digit.any():
            out = table[digit, 0, out & 255] ^ table[digit, 1, out >> 8 & 255] ^ table[digit, 2, out >> 16 & 255] ^ table[digit, 3, out >> 24]
    return out


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text: runs of letters and digits, A to Z in lower case, and of all beyond ASCII."""
    return text.translate(NORMAL).split()


def scan(documents: list[list[bytes]]) -> np.ndarray:
    """For each word in turn the running CRC at its end, over its document written with one separator before every word."""
    at_end = []
    for words in documents:
        running = 0
        at_end += [running := crc32(word, crc32(b" ", running)) for word in words]
    return np.array(at_end, np.uint32)


def behind_separator(values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The running CRCs one separator further."""
    return _through(values, tables[0, 1]) ^ np.uint32(crc32(b" "))


class Shifts:
    """Shift tables that grow with the longest run asked for."""

    def __init__(self) -> None:
        self.tables = shift_tables(2)

    def reaching(self, most: int) -> np.ndarray:
        if most >> 6 * len(self.tables):
            self.tables = shift_tables(-(-most.bit_length() // 6))
        return self.tables


def checksums(documents: list[list[bytes]], longest: int, shifts: Shifts) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of all runs of 1 to ``longest`` words of each document, joined by one blank, and the document each is from.

    First come the single words of all documents, then the pairs, and so on.
    """
    sizes = np.array([len(words) for words in documents], np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    if not len(owner):
        return np.empty(0, np.uint32), owner
    flat = [word for words in documents for word in words]
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
    starts = np.concatenate(([0], ends[:-1])) + 1
    at_end = scan(documents)
    before = np.concatenate((np.zeros(1, np.uint32), at_end[:-1]))
    before[owner != np.concatenate(([-1], owner[:-1]))] = 0  # every document is scanned anew
    at_start = behind_separator(before, shifts.tables)
    found, whose = [], []
    for n in range(1, min(longest, int(sizes.max())) + 1):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])  # runs don't reach into the next document
        lengths = ends[first + n - 1] - starts[first]
        found.append(shifted(at_start[first], lengths, shifts.reaching(int(lengths.max()))) ^ at_end[first + n - 1])
        whose.append(owner[first])
    return np.concatenate(found), np.concatenate(whose)


def documents_of(batch: pa.RecordBatch) -> list[list[bytes]]:
    """The words of each row's ``text``; null has none."""
    return [words_of(text.as_py() or b"") for text in batch.column("text").cast(pa.binary())]


def counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: how often the features of the column ``text`` fall into each bucket that has any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                found, _ = checksums(documents_of(batch), longest, shifts)
                total += np.bincount(found % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return texts.where("text is not null").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket in thousandths; at most ``buckets`` rows of each table reach the driver."""
    s, t = [0] * buckets, [0] * buckets
    for table, rows in ((s, raw), (t, target)):
        for r in rows.collect():
            table[r["bucket"]] = r["n"]
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(((t[b] + 1) * all_s) / ((s[b] + 1) * all_t))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """id, n_words, n_features, weight (the floored mean gain; 0 without features)."""
    buckets = len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for whole in batches:
            for batch in slices(whole, "text"):
                documents = documents_of(batch)
                found, whose = checksums(documents, longest, shifts)
                n_features = np.bincount(whose, minlength=len(documents))
                # whole numbers far below 2 ** 53, so the sums are exact
                total = np.bincount(whose, gain[found % buckets], minlength=len(documents)).astype(np.int64)
                numbers = np.array([len(words) for words in documents], np.int64), n_features, total // np.maximum(n_features, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *[pa.array(x) for x in numbers]], names=["id", "n_words", "n_features", "weight"]
                )

    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_words long, n_features long, weight long")


def noise(key, seed: int):
    """Gumbel noise in thousandths from the digest of seed and key, rounded down; null without a key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def drawn_from(scored: DataFrame, k: int, partitions_of: str = "drawn") -> DataFrame:
    """The ``k`` rows of highest ``score``, ties to the smaller id, with ``rank`` from 1.

    Scores are whole thousandths of bounded logarithms, some 10^5 different ones, so their counts fit the
    driver; they give the lowest score that can be drawn.  The rows from there on are numbered
    by ranges, so neither all of them nor one score's rows meet in one task.
    """
    below, cut = 0, None
    for r in scored.groupBy("score").count().orderBy(F.desc("score")).collect():
        cut, below = r["score"], below + r["count"]
        if below >= k:
            break
    # rows that are equal in score and id are told apart by their place
    high = scored.where(F.col("score") >= F.lit(cut)).withColumn("place", F.monotonically_increasing_id())
    high = written(high.withColumn("down", -F.col("score")), partitions_of)
    numbered = ranking.numbered(high, ["down", "id", "place"], "at")
    rank = F.when(F.col("at") < k, F.col("at") + 1)
    return numbered.select(*scored.columns, rank.alias("rank"))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    share: int = DRAWN,
) -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score, rank (1 is the highest score; null if not drawn).

    The raw distribution is that of all ``docs``, the target's that of all texts of
    ``target``.  Of the rows with an id and ``least_words`` words or more, ``share`` per cent are drawn.

    A null, empty or wordless text has no features and weight 0.  A row without an
    id has no noise, so score and rank are null.  Repeated rows count as often as they occur; they score alike and
    have ranks of their own.  Empty tables give an empty result, an empty target weights all by its prior alone.
    Other columns play no part.
    """
    all_raw = counts(docs.select(column(docs, text_col).cast("string").alias("text")), longest, buckets)
    all_target = counts(target.select(column(target, target_text_col).cast("string").alias("text")), longest, buckets)
    gain = gains(all_raw, all_target, buckets)
    rows = written(weighed(docs, gain, id_col, text_col, longest), "weights")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    k = rows.where(able).count() * share // 100
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    nobody = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.withColumn("rank", nobody).select(*shown)
    drawn = drawn_from(rows.where(able), k)
    cut = drawn.agg(F.min("score")).first()[0]
    rest = rows.where(~able | (F.col("score") < F.lit(cut))).withColumn("rank", nobody)
    return drawn.unionByName(rest).select(*shown)
