"""Column expressions for text: strip, fingerprint, noise, inline cleaning.

Whitespace and digits follow Unicode (the classes are spelled out, because
Java's ``\\s`` is ASCII only) and ``.`` stops at ``\\n`` only (``(?d)``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_RANGES}]"
NOT_WS = f"[^{WS_RANGES}]"
#: What is no blank and lies in no range free of white space; these ranges hold nearly all letters and marks.
NOT_PLAIN = r"[^ -~\xa1-\u167f\u200b-\u2027\u3001-\uffff]"
WS_IN_LINE = rf"[{WS_RANGES}&&[^\n]]"
_WS_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

URL_ONLY = rf"^(?:https?://{NOT_WS}+|www\.{NOT_WS}+)$"
NOISE = (
    rf"^(?:https?://{NOT_WS}+|www\.{NOT_WS}+|[-*_]{{3,}}{WS}*"
    rf"|[\p{{Nd}}{WS_RANGES}.\-:|/\\+()]+)$"
)
RULE_LINE = rf"^[-=_*]{{3,}}{WS}*$"
IMAGE = r"(?d)!\[.*?\]\(.*?\)"

# Fixed values, applied in this order by ``clean_markup``.  Last come the marks of which any match holds one.
MARKUP_REWRITES = [
    (r'(?diu)<span' + WS + r'+id="[^"]*"[^>]*>.*?</span>', "", ["<"]),
    (r"<[^>]+>", "", ["<"]),
    (r"&[a-z]+;|&#\p{Nd}+;", " ", ["&"]),
    (IMAGE, "", ["!["]),
    (r"\[([^\]]+)\]\([^)]+\)", "$1", ["]("]),
    (r"(?d)\*{1,3}(.+?)\*{1,3}", "$1", ["*"]),
    (r"(?d)`(.+?)`", "$1", ["`"]),
    (r"(?d)\\(.)", "$1", ["\\"]),
    (r"[ \t]{2,}", " ", ["  ", "\t"]),
]
# Fixed values, applied in this order by ``clean_inline``.
INLINE_REWRITES = [
    (rf"https?://{NOT_WS}+", "", ["http"]),
    (r"\[([^\]]+)\]\([^)]*\)", "$1", ["]("]),
    (r"[*_]{1,2}([^*_]+)[*_]{1,2}", "$1", ["*", "_"]),
    (r"`[^`]+`", "", ["`"]),
]


def quoted(names: list[str]) -> list[Column]:
    """Columns whose names may hold dots, as model names do."""
    return [F.col(f"`{n}`") for n in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trimming by a set of characters lists every position of a text, so it is left to texts with white space at an end.

    Even the place of a last character is found by walking the text, so first of all the outer bytes are looked at: a printed ASCII
    character at both ends settles most texts.
    """
    ends = F.lit(_WS_CHARS)
    last = lambda s: F.substring(s.cast("binary"), -1, 1)
    plain = lambda s: begins_between(s, "!", "~") & last(s).between(F.lit(b"!"), F.lit(b"~"))
    at_end = lambda s: F.contains(ends, F.substring(s, 1, 1)) | F.contains(ends, F.substring(s, -1, 1))
    return let(c, lambda s: F.when(plain(s), s).when(at_end(s), F.btrim(s, ends)).otherwise(s))


def _holds(c: Column, marks: list[str]) -> Column:
    return reduce(or_, [c.contains(m) for m in marks])


def rewrite(c: Column, rules: list[tuple[str, str, list[str]]]) -> Column:
    """The rules in order.  Looking for a mark is much cheaper than a pattern that finds nothing; most lines hold no mark at all."""

    def by(pattern: str, replacement: str, marks: list[str]) -> Callable[[Column], Column]:
        return lambda s: F.when(_holds(s, marks), F.regexp_replace(s, pattern, replacement)).otherwise(s)

    def all_rules(s: Column) -> Column:
        for rule in rules:
            s = let(s, by(*rule))
        return s

    marks = dict.fromkeys(m for rule in rules for m in rule[2])
    return let(c, lambda s: F.when(_holds(s, list(marks)), all_rules(s)).otherwise(s))


def clean_markup(line: Column, protect_bullets: bool = False) -> Column:
    """Rewrite one Markdown/HTML line to plain text (corpus cleaning)."""
    if not protect_bullets:
        return strip(rewrite(line, MARKUP_REWRITES))
    # Cut a leading "* " bullet off, clean the rest, put the bullet back.
    bullet = F.regexp_extract(line, r"^([ \t]*\* +)", 1)
    rest = F.regexp_replace(line, r"^[ \t]*\* +", "")
    return strip(F.concat(bullet, rewrite(rest, MARKUP_REWRITES)))


def clean_inline(line: Column) -> Column:
    """Rewrite one already classified line (segmentation)."""
    return strip(rewrite(line, INLINE_REWRITES))


def begins_between(c: Column, low: str, high: str) -> Column:
    """Whether the first character is one of ASCII from ``low`` to ``high``; comparing texts stops at their first difference."""
    return (c >= low) & (c < chr(ord(high) + 1))


def is_rule_line(stripped: Column) -> Column:
    return reduce(or_, [stripped.startswith(m) for m in "-=_*"]) & stripped.rlike(RULE_LINE)


def is_url_only(stripped: Column) -> Column:
    return (stripped.startswith("http") | stripped.startswith("www.")) & stripped.rlike(URL_ONLY)


def is_image_only(stripped: Column) -> Column:
    """A text that begins with anything but an image is not only images."""
    return (stripped != "") & stripped.startswith("![") & (strip(F.regexp_replace(stripped, IMAGE, "")) == "")


def is_noise(text: Column) -> Column:
    """Only an address begins with a letter and is noise."""
    letter = lambda s: begins_between(s, "a", "z") | begins_between(s, "A", "Z")
    prose = lambda s: letter(s) & ~s.startswith("http") & ~s.startswith("www.")
    return let(strip(text), lambda s: (s == "") | (~prose(s) & s.rlike(NOISE)))


def fingerprint(text: Column) -> Column:
    """md5 of the lower-cased text with whitespace runs squeezed."""
    squeezed = lambda s: F.when(s.contains("  ") | s.rlike(NOT_PLAIN), F.regexp_replace(s, f"{WS}+", " ")).otherwise(s)
    return F.md5(let(strip(F.lower(text)), squeezed))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def model_short(model: Column) -> Column:
    """Display name: last path part.  Never used as a join key."""
    return F.element_at(F.split(model, "/"), -1)
