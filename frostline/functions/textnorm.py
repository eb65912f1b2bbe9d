"""Text normalisation: slugs and tokens, as a Column and in Python, which agree with each other.

A slug is the text with Latin letters reduced to their base letters, Cyrillic and Greek ones spelt in
Latin, decimal digits and full-width forms as ASCII, all lower-cased, and cut down to a-z, 0-9, blanks, and
the letters and marks of other scripts, which stay as they are. Other white space and combining
accents are deleted, so words around a line feed join. A word with letters never becomes empty."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that have no canonical decomposition, and the usual spelling of Cyrillic and Greek letters.
SPELT = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ı": "i", "ħ": "h", "Ħ": "h", "ĸ": "k", "ŋ": "ng", "Ŋ": "ng", "ŧ": "t", "Ŧ": "t"}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia i i ie g".replace("-", "").split(" "), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
LATIN = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
GREEK_LETTERS = [*range(0x370, 0x400), *range(0x1F00, 0x2000)]
CYRILLIC_LETTERS = [*range(0x400, 0x530)]
FULL_WIDTH = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
#: Ranges of letters and marks that a slug drops unless they are spelt: Latin and phonetic ones, combining accents.
DROPPED = [(0x80, 0x36F), (0x1D00, 0x1EFF), (0x2071, 0x209C), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF10, 0xFF5A)]
KEPT = r"[^a-z0-9 \p{L}\p{M}]|[A-Z" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in DROPPED) + "]"


@cache
def folding() -> dict[str, str]:
    """What a letter or digit is spelt by, lower-cased, where that isn't itself."""
    out = dict(SPELT)
    spelt = CYRILLIC | GREEK
    out |= spelt | {c.upper(): s for c, s in spelt.items() if c != "ς"}
    for code in [*LATIN, *GREEK_LETTERS, *CYRILLIC_LETTERS, *FULL_WIDTH]:
        c = chr(code)
        base = unicodedata.normalize("NFKD" if code in FULL_WIDTH else "NFD", c)[0].lower()
        if c not in out and (base in spelt or base.isascii() and base.isalnum()):
            out[c] = spelt.get(base, base)
    for code in range(0x80, 0x20000):
        if unicodedata.category(chr(code)) == "Nd":
            out.setdefault(chr(code), str(unicodedata.decimal(chr(code))))
        elif unicodedata.category(chr(code)) == "Lu" and len(chr(code).lower()) == 1:
            out.setdefault(chr(code), folding_of(chr(code).lower(), out))
    return out


def folding_of(letter: str, known: dict[str, str]) -> str:
    return known.get(letter, letter)


def _stays(c: str) -> bool:
    if c.isascii():
        return c == " " or c.isdigit() or "a" <= c <= "z"
    return unicodedata.category(c)[0] in "LM" and not any(low <= ord(c) <= high for low, high in DROPPED)


def slugify(text: str) -> str:
    folded = "".join(folding().get(c, c) for c in text)
    return "".join(c for c in (c.lower() if c.isascii() else c for c in folded) if _stays(c))


@cache
def _single() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters and what they become, one by one (those that become nothing at the end), and those spelt by more letters."""
    single = {c: b for c, b in folding().items() if len(b) == 1} | {chr(65 + k): chr(97 + k) for k in range(26)}
    nothing = [c for c, b in folding().items() if not b]
    return "".join(single) + "".join(nothing), "".join(single.values()), [(c, b) for c, b in folding().items() if len(b) > 1]


def slug(text: Column | str) -> Column:
    """slugify() as a Column. Texts of ASCII letters alone, or with accents, take a shorter way to the same."""
    text = F.col(text) if isinstance(text, str) else text
    every, by, longer = _single()
    few = [(c, b) for c, b in SPELT.items() if len(b) > 1]
    latin = "".join(c for c in every[: len(by)] if ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00)
    to = dict(zip(every, by, strict=False))

    def spelt(value: Column, pairs: list[tuple[str, str]]) -> Column:
        for letter, letters in pairs:
            value = F.replace(value, F.lit(letter), F.lit(letters))
        return value

    ascii_way = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")
    latin_way = F.regexp_replace(F.translate(spelt(text, few), latin, "".join(to[c] for c in latin)), "[^a-z0-9 ]", "")
    any_way = F.regexp_replace(F.translate(spelt(text, longer), every, by), KEPT, "")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), ascii_way).when(~text.rlike(r"[^\x00-\x{24F}\x{2000}-\x{206F}]"), latin_way).otherwise(any_way)


def tokens(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """Different tokens of the slug: words of two letters or more, or that begin with a digit or a letter of a script
    that isn't spelt in Latin, less stopwords."""
    words = F.filter(F.split(slug(text), " +"), lambda w: (F.length(w) >= 2) | w.rlike("^[^a-z]"))
    stops = sorted({slugify(w) for w in stopwords or []})
    if stops:
        words = F.filter(words, lambda w: ~w.isin(stops))
    return F.array_distinct(words)


def is_token(word: str) -> bool:
    """If a slug is one that tokens() keeps."""
    return len(word) >= 2 or bool(re.match("[^a-z]", word))
