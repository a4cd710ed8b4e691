"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text is the one whose pieces have the highest sum of scores.  The
search runs over the whole text once and keeps the open part only.  The surviving paths end
within one piece length of the front; whenever all of them go through one boundary, the ids
up to it are final and leave the window.  A front that no path reaches beyond is such a boundary
with nothing left open: what follows depends on the text behind it alone.

That makes it safe to remember what was committed between two such fronts.  No piece crosses the
start of a run of word marks or a line break, so the text up to the next of these is looked up before it is searched.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentivote.llm.common import column, slices

#: The word mark.
MARK = "▁"
#: Stretches between two fronts that a task remembers, and the most marks and the most other characters of one.
REMEMBERED, REMEMBERED_LENGTH = 1_000_000, 24


class Vocabulary:
    """Pieces with ids and scores, the byte pieces, and what decoding needs."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: normal, byte or control for each piece; control pieces are never produced and decode to nothing."""
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.longest = max(map(len, self.ids), default=1)
        #: Trie of the pieces: a node is (children by character, score, id); what only begins a piece scores nothing.
        self.trie = self._trie()
        #: What a character without a piece costs.
        self.unknown = min(self.score.values(), default=0.0) - 10
        self.plain = [
            p.replace(MARK, " ").encode("utf-8", "surrogatepass") if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b""
            for p, k in zip(pieces, kinds)
        ]
        # up to the next place that no piece crosses, if that is near; None if a piece may cross such places
        crossed = any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.ids)
        most = f"{{0,{REMEMBERED_LENGTH}}}+"
        self.near = None if crossed else re.compile(rf"\n|{MARK}{most}[^{MARK}\n]{most}(?=\n|\Z|(?<!{MARK}){MARK})").match
        self.memo: dict[str, bytes] = {}

    def _trie(self) -> tuple[dict, float, int]:
        root: tuple[dict, float, int] = ({}, -math.inf, -1)
        for n in range(1, self.longest + 1):  # nodes can't change, so the short pieces make theirs first
            for p in self.ids:
                if len(p) >= n:
                    node = root
                    for c in p[: n - 1]:
                        node = node[0][c]
                    node[0].setdefault(p[n - 1], ({}, self.score.get(p[:n], -math.inf), self.ids.get(p[:n], -1)))
        return root

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From the model file of a public tokenizer."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in n]
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kinds)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def units(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character that has none."""
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in lists, each as soon as it is final."""
        for ids in self.commits(text):
            yield np.frombuffer(ids, np.int32).tolist()

    def commits(self, text: str) -> Iterator[bytes]:
        """What the stream commits, as 32-bit numbers."""
        at, size, memo, near = 0, len(text), self.memo, self.near
        while at < size:
            ahead = near(text, at) if near else None
            if ahead is None:
                at = yield from self.search(text, at)
                continue
            key = ahead.group()
            found = memo.get(key)
            if found is None:
                parts, stop = [], at
                while stop < ahead.end():  # a front may close before the place that no piece crosses
                    stop = self._gather(self.search(text, stop), parts)
                if len(memo) >= REMEMBERED:
                    memo.clear()
                found = memo[key] = b"".join(parts)
            at = ahead.end()
            yield found

    @staticmethod
    def _gather(search: Iterator[bytes], parts: list[bytes]) -> int:
        """Add what a search commits to ``parts``; the front at which it closes."""
        while True:
            try:
                parts.append(next(search))
            except StopIteration as closed:
                return closed.value

    def search(self, text: str, done: int) -> Generator[bytes, None, int]:
        """Search from ``done``, a boundary that all paths go through, to the next front with nothing left open.

        Yields ids whenever they are final, and returns that front.  The window holds the boundaries from
        the last common one on: score of the best path, length of its last piece, and that piece's id.
        """
        trie, unknown, longest, size = self.trie[0], self.unknown, self.longest, len(text)
        none, room = -math.inf, 2 * longest + 1
        best, back, via = [none] * room, [0] * room, [-1] * room
        best[0] = 0.0
        front, reach, look = 0, 0, longest
        while True:
            base = best[front]
            node = trie.get(text[done + front])
            stop = front + 1
            if node is None or node[2] < 0:
                if base + unknown > best[stop]:
                    best[stop], back[stop], via[stop] = base + unknown, 1, -1
                if stop > reach:
                    reach = stop
            while node is not None:
                children, score, piece = node
                if piece >= 0:
                    # of equal paths the one with the longer last piece stays
                    if base + score > best[stop]:
                        best[stop], back[stop], via[stop] = base + score, stop - front, piece
                    if stop > reach:
                        reach = stop
                if done + stop == size:
                    break
                node = children.get(text[done + stop])
                stop += 1
            front += 1
            if front == reach:
                yield self._path(text, done, back, via, front)
                return done + front
            if front >= look:
                meet = self._meet(back, front, reach)
                if meet:
                    yield self._path(text, done, back, via, meet)
                    del best[:meet], back[:meet], via[:meet]
                    done, front, reach = done + meet, front - meet, reach - meet
                look = front + longest
                more = look + longest + 1 - len(best)
                best += [none] * more
                back += [0] * more
                via += [-1] * more

    @staticmethod
    def _meet(back: list[int], front: int, reach: int) -> int:
        """The last boundary that the paths to ``front`` and beyond have in common."""
        ends = [-b for b in range(front, reach + 1) if back[b]]  # where paths end; a heap whose first is the last of them
        heapq.heapify(ends)
        while True:
            last = -heapq.heappop(ends)
            while ends and ends[0] == -last:
                heapq.heappop(ends)
            if not ends:
                return last
            heapq.heappush(ends, back[last] - last)

    def _path(self, text: str, done: int, back: list[int], via: list[int], stop: int) -> bytes:
        """Ids of the best path to a boundary of the window."""
        out: list[int] = []
        while stop:
            out += (via[stop],) if via[stop] >= 0 else self.units(text[done + stop - 1])[::-1]
            stop -= back[stop]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``; a blank is put before it, as the decoder takes one away."""
        out: list[bytes] = []
        if text:
            literal = np.array(self.units_of_mark(), np.int32).tobytes() if MARK in text else b""
            for k, part in enumerate(text.split(MARK)):
                if k:
                    out.append(literal)
                marked = (MARK if not k else "") + part.replace(" ", MARK)
                out += self.commits(marked)
        return np.frombuffer(b"".join(out), np.int32)

    def units_of_mark(self) -> list[int]:
        """A word mark in the text itself is written in bytes, so that it isn't read as a blank."""
        return [self.bytes[b] for b in MARK.encode()]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, n_ids, exact (whether the ids decode to the very text).

    A null or empty text has no ids.  Texts of any length are taken whole.  Repeated rows give
    repeated results; other columns play no part.
    """
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [vocabulary.encode(t) for t in texts]
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                values = np.concatenate([np.empty(0, np.int32), *ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([vocabulary.decode(i) == t for i, t in zip(ids, texts)], pa.bool_()),
                    ],
                    names=["id", "ids", "n_ids", "exact"],
                )

    return rows.mapInArrow(work, f"id {kind}, ids array<int>, n_ids long, exact boolean").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text of the ids.  Null ids give a null text."""
    taken = rows.select(column(rows, id_col).alias("id"), column(rows, ids_col).cast("array<int>").alias("ids"))
    kind = taken.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else vocabulary.decode(np.array(i, np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return taken.mapInArrow(work, f"id {kind}, text string").withColumnRenamed("id", id_col)
