from __future__ import annotations

import hashlib

import pytest

from sentivote.functions import language, text as T


@pytest.mark.parametrize("raw", ["  a b ", "  x\x1c", "\t\r\n", "", "é😀 "])
def test_strip_follows_unicode(one, raw):
    assert one(T.strip, c=raw) == raw.strip()


@pytest.mark.parametrize("raw", ["  Éa   B\n c ", "x"])
def test_fingerprint_squeezes_and_lowers(one, raw):
    want = hashlib.md5(" ".join(raw.lower().split()).encode()).hexdigest()
    assert one(T.fingerprint, c=raw) == want


@pytest.mark.parametrize(
    "raw, noise",
    [("", True), ("  ", True), ("https://a.b/c", True), ("www.a.fr", True), ("***", True), ("--__", True),
     ("12 / 3.4 (5)", True), ("12 a", False), ("https://a b", False), ("**a**", False), ("==", False)],
)
def test_noise(one, raw, noise):
    assert one(T.is_noise, c=raw) is noise


@pytest.mark.parametrize(
    "raw, want",
    [
        ('<span id="p-1" class="x">gone</span> kept', "kept"),
        ("<b>a</b>&nbsp;b &#39; c", "a b c"),
        ("&Eacute;t&#x27;", "&Eacute;t&#x27;"),
        ("see ![i](u.png) here", "see here"),
        ("[text](http://u) end", "text end"),
        ("**a** *b* ***c***", "a b c"),
        ("`code` and \\* star", "code and * star"),
        ("* item with *emph*", "item with emph*"),
        ("a\t  b", "a b"),
        ("a\rb [x\ry](u)", "a\rb x\ry"),
    ],
)
def test_markup_chain(one, raw, want):
    assert one(T.clean_markup, c=raw) == want


def test_protected_bullet_survives(one):
    assert one(lambda c: T.clean_markup(c, True), c="* item with *emph*") == "* item with emph"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("[a](https://x.y/z) b", "[a]( b"),  # the address goes first and takes the bracket
        ("a_b_c", "abc"),
        ("say `code` now", "say  now"),
        ("**bold** text", "bold text"),
    ],
)
def test_inline_chain(one, raw, want):
    assert one(T.clean_inline, c=raw) == want


@pytest.mark.parametrize(
    "raw, lang, routed",
    [
        ("Le chat est dans la maison avec les enfants", "fr", "fr"),
        ("The cat is in the house with that dog", "en", "en"),
        ("Der Hund ist nicht auf dem Tisch", "de", "fr"),
        ("12345", None, "fr"),
        ("thefor", None, "fr"),
    ],
)
def test_language(one, raw, lang, routed):
    assert one(language.detect, c=raw) == lang
    assert one(lambda c: language.route(language.detect(c)), c=raw) == routed
