"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the places worth a look: at-signs, plus signs,
digits, schemes and cues such as "IBAN".  From each anchor a small parser expands to the
boundaries of the datum and validates it.  Texts without anchors cost one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import column, one_by_one

#: Kinds in the order of ties; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

# Schemes, cues of bank accounts, cues of account or identity numbers.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "tax id", "customer id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[\x20:.#-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|num|id))?[\x20:.#=-]{1,4}([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,19})(?![0-9A-Za-z])", re.IGNORECASE)
#: Bytes of text that are masked at a time.
MASKED_BYTES = 4_000_000

_NOT_DIGIT = re.compile(r"[^0-9]+")


def anchors() -> ahocorasick.Automaton:
    """Patterns in lower case, each with its role."""
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for role, words in (("scheme", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES)):
        for w in words:
            a.add_word(w, (role, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def valid_iban(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def folded(text: str) -> str:
    """Lower case, place by place: letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_spans(text: str | None, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data of ``text``, by start, then kind."""
    spans: list[tuple[int, int, str]] = []
    if not text:
        return spans
    done = dict.fromkeys(KINDS, 0)
    digit_before = -2
    for last, (role, size) in machine.iter(folded(text)):
        at = last - size + 1
        if role == "digit":
            run_starts = at != digit_before + 1
            digit_before = at
            if run_starts:
                if at >= done["ip"] and (m := _IP.match(text, at)):
                    done["ip"] = m.end()
                    if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.groups()):
                        spans.append((at, m.end(), "ip"))
                if at >= done["card"] and (m := _CARD.match(text, at)):
                    done["card"] = m.end()
                    digits = _NOT_DIGIT.sub("", m.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, m.end(), "card"))
        elif role == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append((at, m.end(), "phone"))
        elif role == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append((start, m.end(), "email"))
        elif role == "scheme":
            if at >= done["url"] and (m := _URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > last + 1:
                    done["url"] = end
                    spans.append((at, end, "url"))
        elif role == "iban":
            if at >= done["iban"] and (m := _IBAN.match(text, last + 1)):
                start, found = m.start(1), m.group(1)
                while len(found) >= 15 and not valid_iban(found):
                    found = found[:-1].rstrip(" ")
                if len(found) >= 15:
                    done["iban"] = start + len(found)
                    spans.append((start, start + len(found), "iban"))
        elif at >= done["account"] and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            done["account"] = m.end(1)
            spans.append((m.start(1), m.end(1), "account"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text, spans array<struct(kind, start, stop)> in code points, stop exclusive.

    A null text has no spans.  Repeated rows give repeated results; other columns
    play no part.  The base kinds are the leftmost non-overlapping matches of each kind
    that pass its rule; a failing match is passed over whole.
    """

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    @F.arrow_udf("array<struct<kind string, start int, stop int>>")
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = anchors()
        for texts in parts:
            spans = ([{"kind": k, "start": a, "stop": b} for a, b, k in find_spans(t, machine)] for t in one_by_one(texts))
            yield pa.array(list(spans), kind)

    text = column(docs, text_col).cast("string")
    return docs.select(column(docs, id_col).alias(id_col), text.alias(text_col), find(text).alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, numbers of the base kinds, hash of the base spans, all spans as text."""

    names, kinds_of_columns = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"], [pa.int64()] * len(BASE) + [pa.string()] * 2

    @F.arrow_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def summed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = anchors()
        for texts in parts:
            rows = []
            for t in one_by_one(texts):
                spans = find_spans(t, machine)
                base = [s for s in spans if s[2] in BASE]
                kinds = [s[2] for s in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_of_columns)], names=names)

    key = column(docs, id_col)
    return docs.select(key.alias("id"), summed(column(docs, text_col).cast("string")).alias("s")).select(F.col("id").alias(id_col), "s.*")


def masked_text(text: str | None, machine: ahocorasick.Automaton) -> str | None:
    """``text`` with every datum replaced by its kind in angle brackets; of overlapping ones, the first and longest."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in sorted(find_spans(text, machine), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def masked_parts(texts: pa.Array, machine: ahocorasick.Automaton) -> Iterator[pa.Array]:
    """``texts`` masked, in parts of about ``MASKED_BYTES``: neither a worker nor its executor holds a whole batch of masked texts."""
    step = max(1, len(texts) * MASKED_BYTES // max(texts.nbytes, 1))
    for at in range(0, len(texts), step):
        yield pa.array([masked_text(t, machine) for t in one_by_one(texts.slice(at, step))], pa.string())


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data of ``text_col`` masked and its length in ``length_col`` set anew, if there is such a column."""

    @F.arrow_udf("string")
    def mask(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = anchors()
        for texts in parts:
            yield from masked_parts(texts, machine)

    out = docs.withColumn(text_col, mask(column(docs, text_col).cast("string")))
    if length_col in docs.columns:
        length = F.length(column(out, text_col)).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.coalesce(length, column(out, length_col)))
    return out
