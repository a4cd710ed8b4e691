"""Fill-in-middle transformation by block rotation in place.

A text is cut into three blocks: prefix, middle and suffix.  The text lies in one
bytearray.  A scan finds the cuts, the sentinels are inserted before their blocks,
and adjacent blocks change places by a rotation of three reversals, so no second copy
of the text is made.  Rotating back and taking the sentinels out gives the text again.

Which texts are turned, where they are cut and in which form they are written follows
from a digest of the row's id alone, so reruns and retried tasks agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import column, slices

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Seed of the digest, share of texts that are turned and share of those written suffix first, in per cent.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50

#: Bytes that a reversal swaps at a time.
_SWAP = 1 << 16
_LINE_END = re.compile(b"\n")


def reverse(buffer: bytearray, start: int, stop: int) -> None:
    """Reverse ``buffer[start:stop]`` in place, swapping stretches of bounded size from both ends."""
    view = np.frombuffer(buffer, np.uint8)
    while stop - start > 1:
        step = min(_SWAP, (stop - start) // 2)
        low = view[start : start + step].copy()
        view[start : start + step] = view[stop - step : stop][::-1]
        view[stop - step : stop] = low[::-1]
        start, stop = start + step, stop - step


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchange the blocks ``[start:middle]`` and ``[middle:stop]`` by three reversals."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, stop)
    reverse(buffer, start, stop)


def line_ends(text: bytes) -> np.ndarray:
    """Where each line ends: behind its line feed, and at the end of what follows the last one."""
    ends = np.fromiter((m.end() for m in _LINE_END.finditer(text)), np.int64)
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return ends


def draws(seed: int, key: int) -> tuple[int, int, int, int]:
    """The first four groups of eight digits of the digest of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def turn(text: bytes, cuts: tuple[int, int], suffix_first: bool, sentinels: Sequence[bytes]) -> bytearray:
    """The text with its blocks marked and the middle moved to the end."""
    p, s, m = sentinels
    buffer = bytearray(text)
    # from the last to the first, so that the cuts before an insertion stay where they are
    buffer[cuts[1] : cuts[1]] = s
    buffer[cuts[0] : cuts[0]] = m
    buffer[0:0] = p
    middle = cuts[0] + len(p)
    suffix = cuts[1] + len(p) + len(m)
    rotate(buffer, 0 if suffix_first else middle, suffix, len(buffer))
    return buffer


def unturn(output: bytes, suffix_first: bool, sentinels: Sequence[bytes]) -> bytearray:
    """Invert ``turn``: rotate back, then take the sentinels out."""
    p, s, m = sentinels
    buffer = bytearray(output)
    at = {mark: buffer.index(mark) for mark in (p, s, m)}
    # the marks occur once each: a text that holds one stays plain, and no text can complete part of one
    start, block = (0, at[p]) if suffix_first else (at[s], at[m])
    suffix = block - start  # bytes of the suffix and its mark
    rotate(buffer, start, block, len(buffer))
    del buffer[len(buffer) - suffix : len(buffer) - suffix + len(s)]
    middle = at[m] - suffix if suffix_first else at[s]
    del buffer[middle : middle + len(m)]
    del buffer[: len(p)]
    return buffer


def code_points(text: memoryview) -> int:
    """Characters of UTF-8 bytes: all bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


Turned = tuple[int, str, int | None, int | None, bytes | bytearray]


def turner(sentinels: Sequence[str], seed: int, rate: int, suffix_first: int) -> Callable[[int | None, bytes], Turned]:
    """A function from a row's number and text to n, form, prefix_chars, middle_chars and output."""
    if len(set(sentinels)) != 3 or not all(re.fullmatch(r"<[^<>\n]+>", s) for s in sentinels):
        raise ValueError("sentinels are three different marks in angle brackets")
    marks = [s.encode() for s in sentinels]
    held = re.compile(b"|".join(map(re.escape, marks)))

    def one(key: int | None, text: bytes) -> Turned:
        ends = line_ends(text)
        if key is not None and text and not held.search(text):
            first, second, turned, form = draws(seed, key)
            if turned % 100 < rate:
                units = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
                cuts = tuple(int(ends[u - 1]) if u else 0 for u in units)
                spm = form % 100 < suffix_first
                view = memoryview(text)
                return (
                    len(ends), "spm" if spm else "psm", code_points(view[: cuts[0]]), code_points(view[cuts[0] : cuts[1]]),
                    turn(text, cuts, spm, marks),
                )
        return len(ends), "plain", None, None, text

    return one


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """id, its number and text, and the type of the id."""
    key = column(docs, id_col)
    rows = docs.select(key.alias("id"), key.cast("long").alias("number"), column(docs, text_col).cast("string").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def numbered_texts(batch: pa.RecordBatch) -> tuple[list[int | None], Iterator[bytes]]:
    """Numbers and texts of a batch, a text at a time; a null text is an empty one."""
    return batch.column("number").to_pylist(), (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))


def transformed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentinels: Sequence[str] = SENTINELS,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Per row of ``docs``: id, n (lines), form, prefix_chars, middle_chars, output.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain; ``rate`` per cent of the
    texts are turned, ``suffix_first`` per cent of them to spm.  A plain row's output is its text, its two numbers
    are null.

    A null text is an empty one, and an empty text is plain, as is one that holds a
    sentinel and one without an id, which has no draws.  Repeated rows are turned alike.
    Texts of any length are taken whole.  Other columns of ``docs`` play no part.
    """
    one = turner(sentinels, seed, rate, suffix_first)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [(*found, output.decode()) for *found, output in map(one, *numbered_texts(batch))]
                found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *found], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows, kind = keyed_texts(docs, id_col, text_col)
    out = rows.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(rows: DataFrame, form_col: str = "form", output_col: str = "output", sentinels: Sequence[str] = SENTINELS):
    """A column of ``rows``: the text that each output was made from, found from output and form alone.

    A null output gives null.
    """
    marks = [s.encode() for s in sentinels]

    @F.arrow_udf("string")
    def back(forms: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for form, output in forms:
            texts = []
            for f, o in zip(form.to_pylist(), output.cast(pa.binary())):
                raw = o.as_py()
                texts.append(raw if raw is None or f == "plain" else bytes(unturn(raw, f == "spm", marks)))
            yield pa.array(texts, pa.binary()).cast(pa.string())

    return back(column(rows, form_col), column(rows, output_col))


def digest(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentinels: Sequence[str] = SENTINELS,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the digests of output and of the text rebuilt from it.

    The rows of ``transformed``, each rebuilt as by ``restored`` where it was turned: texts go to Python once and none comes back.
    """
    one = turner(sentinels, seed, rate, suffix_first)
    marks = [s.encode() for s in sentinels]
    names, kinds = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def summed(number: int | None, text: bytes) -> tuple:
        *found, output = one(number, text)
        back = output if found[1] == "plain" else unturn(output, found[1] == "spm", marks)
        return (*found, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = list(map(summed, *numbered_texts(batch)))
                found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *found], names=["id", *names])

    rows, kind = keyed_texts(docs, id_col, text_col)
    out = rows.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    return out.withColumnRenamed("id", id_col)
