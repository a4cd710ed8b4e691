"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags.  The first pass decides each
block by itself: by its place in the page, its length, the density of links and of
stop words.  Blocks too short or too unclear for that stay open, and in the second
pass take the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivote.llm.common import column, one_by_one

# Tags whose content is never shown or never main text, tags that
# end a block, tags that hold the article, words of class and id names.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
OUTSIDE = frozenset("nav header footer aside form menu select button dialog svg head object canvas audio video fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figure figcaption footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead topbar toolbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login"
    " comment comments respond replies disqus share sharing social related recommended recommendations widget pagination pager copyright"
    " disclaimer tags search".split()
)
#: Words that say nothing about what an element is for, beside one of ``NAMES``.
FRAMES = frozenset(
    "box block wrap wrapper wrapping container inner outer area bar list links link item items post posts article articles section slot unit group"
    " row col column top bottom left right site page main global primary secondary form button buttons text title body content js is has the my"
    " widgets stories story news more also read you may like icon icons".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
STOP_WORDS = frozenset(
    # English
    "the of and to in a is that it for on was with as be by at this are or from an have not but they which you his her she he we were their"
    " has had been will would there what when who its can more if so no one all do"
    # German
    " der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er wird aus bei sie nach einer um am sind noch"
    " wie einem über so zum war haben nur oder aber vor zur bis"
    # French
    " le la les de des du un une et à en est que qui dans pour pas par sur au avec ce il ne se plus son sont ou mais comme nous vous aux cette"
    # Spanish
    " el los las y que en del se por con una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre".split()
)
#: Words of a block that is long enough to be decided by its own; links and stop words per word.
LONG, LINKS, STOPS_HIGH, STOPS_LOW = 12, 0.4, 0.25, 0.12

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z))", re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.IGNORECASE)


@dataclass
class Block:
    text: str
    inside: bool  # of the article
    words: int
    link_words: int
    stop_words: int
    doubtful: bool = False  # a heading in the article that is named like boilerplate


def named(attributes: str, whole: bool) -> bool:
    """Whether a name is one of boilerplate: one of its words is, or, as a ``whole``, all that say anything."""
    for m in _NAMED.finditer(attributes):
        value = m.group(1) or m.group(2) or m.group(3) or ""
        for name in value.split():
            words = [w.lower() for w in _PART.findall(_CAMEL.sub(" ", name))]
            if any(w in NAMES for w in words) and (not whole or all(w in NAMES or w in FRAMES for w in words)):
                return True
    return False


def boilerplate(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element's tag, role or names say that it is not main text.

    ``inside`` an article a name must say so as a whole, as "related-posts" does and "related-work" does not, and headings
    aren't judged by it.
    """
    if tag in OUTSIDE:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    role = _ROLE.search(attributes)
    if role and role.group(1).lower() in ROLES:
        return True
    if tag in ARTICLE or tag in ("body", "html"):
        return False
    if inside and tag in HEADINGS:
        return False
    return named(attributes, inside)


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order, with what the rules need; boilerplate elements are left out."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool]] = []  # (tag, boilerplate)
    shut = articles = links = 0
    doubtful = False
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        # white space is joined before references are decoded, so a decoded space counts as any other
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = [w.strip(".,;:!?()[]{}\"'«»„“”*#%&$|…") for w in text.lower().split()]
            n_links = len(html.unescape("".join(linked)).split())
            out.append(Block(text, articles > 0, len(words), n_links, sum(w in STOP_WORDS for w in words), doubtful))
        parts.clear()
        linked.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at and not shut:
            parts.append(page[at:end])
            if links:
                linked.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        attributes = m.group(3) or ""
        if m.group(1) or m.group(4):
            if tag in BLOCKS:
                close()
                doubtful = False
            # an end tag closes the innermost element of its name, and what was left open inside
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    if tag in BLOCKS or not any(t in BLOCKS for t, _ in open_tags[k + 1 :]):
                        for t, bad in open_tags[k:]:
                            shut -= bad
                            articles -= t in ARTICLE
                            links -= t == "a"
                        del open_tags[k:]
                    break
            continue
        if tag in BLOCKS:
            close()
            doubtful = tag in HEADINGS and articles > 0 and "=" in attributes and named(attributes, True)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else size
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_tags and open_tags[-1][0] == tag:
            shut -= open_tags.pop()[1]
        bad = boilerplate(tag, attributes, articles > 0)
        if tag == "header" and articles and not shut and not _NAMED.search(attributes):
            bad = False  # an article's own header holds its headline
        open_tags.append((tag, bad))
        shut += bad
        articles += tag in ARTICLE
        links += tag == "a"
    close()
    return out


def first_pass(block: Block, has_article: bool, known: bool = True) -> bool | None:
    """True for main text, False for boilerplate, None for open.

    ``known`` is whether the page's language has known stop words; without them length and links decide, and
    a text without blanks counts one word for six characters.
    """
    linked = block.link_words > LINKS * block.words
    if has_article and block.inside:
        # the article is marked: its blocks are main text, unless they are links or named otherwise, which is left open
        return None if linked or block.doubtful else True
    if linked:
        return False
    if has_article:
        # what is beside the article needs every sign of main text
        return None if block.words >= LONG and block.stop_words >= STOPS_HIGH * block.words else False
    if not known:
        return True if max(block.words, len(block.text) // 6) >= LONG else None
    if block.words < LONG:
        return None
    if block.stop_words >= STOPS_HIGH * block.words:
        return True
    return None if block.stop_words >= STOPS_LOW * block.words else False


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided neighbours; if these differ, main text wins only between its like."""
    before: list[bool | None] = []
    last = None
    for x in labels:
        last = x if x is not None else last
        before.append(last)
    after: list[bool | None] = []
    last = None
    for x in reversed(labels):
        last = x if x is not None else last
        after.append(last)
    after.reverse()
    out = []
    for x, a, b in zip(labels, before, after):
        sides = [s for s in (a, b) if s is not None]
        out.append(x if x is not None else all(sides) and bool(sides))
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks in order, joined by blanks."""
    if not page:
        return ""
    blocks = blocks_of(page)
    has_article = any(b.inside and b.words for b in blocks)
    labels = [first_pass(b, has_article) for b in blocks]
    if not has_article and True not in labels:  # no block speaks a known language
        labels = [first_pass(b, has_article, known=False) for b in blocks]
    if has_article:
        # an article's open blocks have their neighbours inside it
        within = iter(second_pass([x for x, b in zip(labels, blocks) if b.inside]))
        labels = [next(within) if b.inside else x for x, b in zip(labels, blocks)]
    return " ".join(b.text for b, keep in zip(blocks, second_pass(labels)) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text, n_chars (code points).

    A null or empty page, or one without main text, gives an empty text.  Pages are read
    whole.  Repeated rows give repeated results; other columns play no part.
    """

    @F.arrow_udf("string")
    def extract(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in parts:
            yield pa.array([main_text(p) for p in one_by_one(pages)], pa.string())

    text = extract(column(pages, html_col).cast("string"))
    out = pages.select(column(pages, id_col).alias("id"), column(pages, url_col).alias("url"), text.alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
