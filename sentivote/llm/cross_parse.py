"""Language identification by cross-parsing entropy.

A suffix automaton holds a sample of labelled text of each language.  A text is
parsed into phrases, each the longest match in the automaton from where the last
one ended.  The fewer phrases, normalised by the log size of the sample, the closer the
language; the language with the fewest wins.

All texts of a batch walk all automata in step: one transition table, one
lookup per symbol.  Texts are cut into windows of ``WINDOW`` symbols that parse on their own,
which bounds the number of steps; every symbol of every text is parsed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import code_points, column, fresh, one_by_one

#: Bounds of the fitted sample: documents per language, symbols per language.
SAMPLE_DOCS, SAMPLE_SYMBOLS = 64, 24_000
#: A text of fewer symbols, or one whose language was learnt from fewer, isn't judged by its entropy.
SHORT, LEARNT = 100, 5000
#: Least gain over evenly drawn symbols of a text that has a language.  Of 34,000 labelled documents the lowest had -0.02,
#: words of evenly drawn letters and base64 have -0.6 and less.
LEAST = -0.3
#: Symbols that are parsed in one go.
WINDOW = 512


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions (symbol -> state) of each state of the suffix automaton of a sequence; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Transitions:
    """(state, symbol) -> state, in a hash table with a quarter of its slots used: its size grows with the
    transitions and not with the number of symbols, so every letter of any script can have its own."""

    def __init__(self, states: np.ndarray, symbols: np.ndarray, targets: np.ndarray):
        bits = max(4, (4 * len(states)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, 64 - bits
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = self._key(states, symbols)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of those that want one slot the last one has it
            won = self.keys[slots[left]] == keys[left]
            self.targets[slots[left[won]]] = targets[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def _key(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return states.astype(np.int64) << 21 | symbols

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is no transition."""
        keys = self._key(states, symbols)
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.targets[slots], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.targets[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Model:
    """Languages, the symbols of letters, the transitions of all automata in one table."""

    def __init__(self, samples: dict[str, str], most: int = SAMPLE_SYMBOLS):
        self.langs = sorted(samples)
        letters = {c for text in samples.values() for c in text.lower() if c.isalpha()}
        #: Symbol 0 is any run of other characters, 1 a letter that the samples lack, then come all their letters.
        self.points = np.array(sorted(map(ord, letters)), np.uint32)
        self.width = len(self.points) + 2
        states, symbols, targets = [], [], []
        self.starts, sizes, base = [], [], 0
        for lang in self.langs:
            s = self.symbols(samples[lang])[:most]
            automaton = suffix_automaton(s.tolist())
            for state, out in enumerate(automaton, base):
                states += [state] * len(out)
                symbols += out.keys()
                targets += [t + base for t in out.values()]
            self.starts.append(base)
            base += len(automaton)
            sizes.append(max(len(s), 2))
        self.table = Transitions(np.array(states, np.int64), np.array(symbols, np.int64), np.array(targets, np.int32))
        self.cost = np.log(np.array(sizes, np.float64))

    def symbols(self, text: str) -> np.ndarray:
        """Letters as symbols, each run of anything else as one 0; no 0 at either end."""
        p = code_points(text)
        if not len(p) or not len(self.points):
            return np.empty(0, np.int32)
        at = np.minimum(np.searchsorted(self.points, p), len(self.points) - 1)
        s = np.where(self.points[at] == p, at + 2, 0).astype(np.int32)
        other = np.flatnonzero((s == 0) & ((p > 127) | ((p >= 97) & (p <= 122))))
        s[other] = np.strings.isalpha(p[other].view("U1"))  # letters that the sample lacks
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        a, b = int(len(s) > 0 and s[0] == 0), len(s) - int(len(s) > 1 and s[-1] == 0)
        return s[a:b]

    def phrases(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of phrases (window, language); ``windows`` (n, WINDOW) is padded, longest first."""
        n, langs = len(windows), len(self.langs)
        start = np.tile(np.array(self.starts, np.int32), n)
        state, count = start.copy(), np.zeros(n * langs, np.int32)
        by_step = np.ascontiguousarray(windows.T)
        live = np.searchsorted(-lengths, -np.arange(windows.shape[1]), side="left")
        for k in range(windows.shape[1]):
            m = int(live[k]) * langs
            if not m:
                break
            c = np.repeat(by_step[k, : live[k]], langs)
            to = self.table.follow(state[:m], c)
            ended = np.flatnonzero(to < 0)
            if len(ended):
                # the phrase ends before this symbol, if it has begun at all; the next begins with it
                s = start[ended]
                count[ended] += state[ended] != s
                again = self.table.follow(s, c[ended])
                lost = again < 0
                count[ended[lost]] += 1
                to[ended] = np.where(lost, s, again)
            state[:m] = to
        return (count + (state != start)).reshape(n, langs)

    def parsed(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Symbols of each text, and its numbers of phrases (text, language) and of windows."""
        parts = [self.symbols(t) if t else np.empty(0, np.int32) for t in texts]
        owners, sizes, windows = [], [], []
        for d, s in enumerate(parts):
            for at in range(0, len(s), WINDOW):
                owners.append(d)
                windows.append(s[at : at + WINDOW])
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if windows and self.langs:
            sizes = np.array([len(w) for w in windows], np.int64)
            order = np.argsort(-sizes, kind="stable")
            sizes, owners = sizes[order], np.array(owners)[order]
            grid = np.zeros((len(windows), WINDOW), np.int32)
            for row, k in enumerate(order):
                grid[row, : sizes[row]] = windows[k]
            np.add.at(total, owners, self.phrases(grid, sizes))
        return parts, total, np.bincount(np.asarray(owners, np.int64), minlength=len(texts))

    def gains(self, texts: list[str | None]) -> list[float]:
        """For each text 1 less the ratio of the winner's entropy to that of evenly drawn symbols.

        The last phrase of a window is cut by its end and isn't counted.  A text without letters has minus infinity.  What can't be
        judged has 0: few symbols, or a winner with a small sample.
        """
        parts, total, windows = self.parsed(texts)
        out = []
        for s, n, cut in zip(parts, total, windows):
            if not len(s) or not (s > 0).any():
                out.append(-np.inf)
                continue
            best = int(np.argmin(n * self.cost))
            if len(s) < SHORT or self.cost[best] < np.log(LEARNT):
                out.append(0.0)
                continue
            out.append(float(1 - (n[best] - cut) * self.cost[best] / (len(s) * np.log(self.width - 1))))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        parts, total, _ = self.parsed(texts)
        out = []
        for s, n in zip(parts, total * self.cost):
            if not len(s) or not (s > 0).any() or not self.langs:
                out.append(("und", 0.0))
                continue
            order = np.argsort(n, kind="stable")
            best, second = n[order[0]], n[order[1]] if len(n) > 1 else np.inf
            out.append((self.langs[order[0]], float(1 - best / second) if second > 0 else 0.0))
        return out


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fitted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS,
) -> Model:
    """A model of a bounded sample: per language, of ``sample_docs`` hash classes of text the text with the least hash.

    The choice depends on texts alone and shrinks on the map side.  Rows with a null
    language or id, or held out, aren't learnt from.
    """
    key = column(docs, id_col)
    rows = docs.where(key.isNotNull() & ~held_out(key)).select(
        column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).cast("string").alias("text")
    ).where("lang is not null and text is not null and text rlike '[^\\\\P{L}]'")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # the longest texts would be most of the sample; what is beyond a language's bound isn't moved
    most = F.substring("text", 1, sample_symbols)
    picked = hashed.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("slot")).agg(F.min_by(most, F.col("h")).alias("text"), F.min("h").alias("h"))
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    share = max(200, 2 * sample_symbols // sample_docs)
    joined = {}
    for lang, texts in samples.items():
        # every sampled text gives a share first, then the rest fill up
        first, rest = [t[:share] for t in texts], [t[share:] for t in texts]
        joined[lang] = " ".join(first + rest)[: 2 * sample_symbols]
    return Model(joined, sample_symbols)


def in_groups(of, texts: Iterable[str | None]) -> list:
    """``of`` over lists of about 1,500,000 characters."""
    out, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > 1_500_000:
            out += of(group)
            group, size = [], 0
    return out + of(group)


def predicted(model: Model):
    """A column function: text -> struct(lang_pred, score)."""

    @F.arrow_udf("lang_pred string, score double")
    def guess(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = in_groups(model.predict, one_by_one(texts))
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"]
            )

    return guess


def gained(model: Model):
    """A column function: text -> gain, see ``Model.gains``."""

    @F.arrow_udf("double")
    def gain(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(in_groups(model.gains, one_by_one(texts)), pa.float64())

    return gain


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: id, held_out, lang_pred, score.

    ``lang_pred`` is a learnt language, or ``und`` for a null text or one without
    letters, or when nothing was learnt; ties go to the first language in order.  ``score`` is 1 less the
    ratio of the winner's phrases to the runner-up's: 0 for a tie, 1 if there is no other language.
    """
    model = model or fitted(docs, id_col, text_col, lang_col)
    key = column(docs, id_col)
    guess = predicted(model)(column(docs, text_col).cast("string"))
    found = docs.select(key.alias("id"), held_out(key).alias("held_out"), guess.alias("g"))
    return found.select(F.col("id").alias(id_col), "held_out", "g.lang_pred", "g.score")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """Rows of ``docs`` whose text has letters and a learnt language, columns as they were.

    A text has a language if its phrases cost less than evenly drawn symbols would, with ``least`` as the gain wanted.  The
    score of ``identified`` doesn't tell: a text in two languages has a score near 0 too.  What can't be judged stays, as do
    all texts with letters when no language was learnt.
    """
    model = fitted(docs, id_col, text_col, lang_col)
    text = column(docs, text_col).cast("string")
    if not model.langs:
        return docs.where(text.rlike("[^\\P{L}]"))
    name = fresh(docs, "gain")
    judged = docs.withColumn(name, gained(model)(text))
    return judged.where(column(judged, name) >= least).select(*[column(judged, c) for c in docs.columns])
