"""Encoding comes through the streaming search, whatever the text."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

from sentivote.llm import piece_codec, queries


class Watched(piece_codec.Vocabulary):
    """Counts what the stream commits and how far back its window reaches."""

    committed, widest = 0, 0

    def _path(self, text, done, back, via, stop):
        self.committed += 1
        self.widest = max(self.widest, len(back))
        return super()._path(text, done, back, via, stop)


@pytest.fixture
def watched():
    return Watched.load(queries.PIECES)


def plain_search(v, text):
    """The whole search at once: all boundaries kept to the end."""
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(len(text)):
        ends = [(j, v.score[text[i:j]]) for j in range(i + 1, min(len(text), i + v.longest) + 1) if text[i:j] in v.score]
        for j, s in ends if ends and ends[0][0] == i + 1 else [(i + 1, v.unknown), *ends]:
            if best[j] is None or best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i)
    out, j = [], len(text)
    while j:
        out.append(text[best[j][1] : j])
        j = best[j][1]
    return [i for p in reversed(out) for i in v.units(p)]


def test_supplied_texts_come_through_the_stream(watched):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    words, mark = set(), piece_codec.MARK
    for text in filter(None, texts):
        marked = mark + text.replace(" ", mark)
        assert mark in text or watched.encode(text).tolist() == plain_search(watched, marked)
        words.update(text.split())
    # what isn't remembered was committed by the search, and nothing else makes ids
    assert watched.committed >= len(watched.memo) > len(words) / 2
    assert sum(map(len, watched.memo.values())) > 0


def test_remembered_or_not_is_the_same(watched):
    rng, parts = random.Random(5), ["a", "ing", " ", "  ", "\n", "\n\n", " " * 40, "x" * 30, "the", "é", "漢字", "-" * 20, "\t"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 80))).replace(" ", piece_codec.MARK)
        first = [i for ids in watched.stream(text) for i in ids]
        again = [i for ids in watched.stream(text) for i in ids]
        near, watched.near = watched.near, None
        searched = [i for ids in watched.stream(text) for i in ids]
        watched.near = near
        assert first == again == searched == plain_search(watched, text)


def test_the_window_stays_bounded_on_long_texts_without_blanks(watched):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(100_000))
    ids = [i for ids in watched.stream(text) for i in ids]
    assert watched.committed > 1_000 and watched.widest <= 8 * watched.longest
    assert ids == plain_search(watched, text)


def test_pieces_across_marks_are_searched_without_borders():
    mark = piece_codec.MARK
    pieces = ["a", "b", mark, f"a{mark}b", f"b{mark}", "\n", "a\n"]
    v = piece_codec.Vocabulary(pieces, [-2.0, -2.0, -2.0, -3.0, -3.0, -2.0, -1.0], ["normal"] * len(pieces))
    assert v.near is None
    for text in (f"a{mark}b", f"aa{mark}bb{mark}", f"a\nb{mark}a\n", mark * 3):
        assert [i for ids in v.stream(text) for i in ids] == plain_search(v, text)
