"""Texts to comparable tokens, whatever the case, spacing, hyphenation, digits or composition they are written with."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Scripts written without spaces between words: each character is a token.
SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]")
#: Accents of Latin, Greek and Cyrillic letters; marks of other scripts are part of the letter and stay.
_ACCENTS = re.compile("[\u0300-\u036f]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\N{COMBINING GRAPHEME JOINER}\p{Variation_Selector}]+")
_HAS_INVISIBLE = re.compile("[\u00ad\u034f\u0600-\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000110bd-\U000e01ef]")
_MAYBE_BROKEN = re.compile("[-\u2010\u2011][ \t]*\r?\n")
_BROKEN = regex.compile(r"(?<=[\p{L}\p{M}])[-‐‑][ \t]*\r?\n[ \t]*(?=[\p{Ll}\p{Lo}\p{M}])")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]|\p{N}+|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}ー々〆])[\p{L}\p{M}])+")
#: Beyond this range letters may have marks or stand without spaces; within it the standard library sees the same tokens.
_WIDE = re.compile("[\u0483-\u0489\u0590-\u1fff\u2c00-\u2dff\u2e80-\U0010ffff]")
_PLAIN_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_OTHER_DIGIT = regex.compile(r"[^\P{Nd}0-9]")


@lru_cache(maxsize=4096)
def _digit(c: str) -> str:
    return str(unicodedata.digit(c))


def normalize(text: str) -> str:
    """Compatibility form in lower case: no invisible characters, no accents on Latin, Greek or Cyrillic letters,
    ASCII digits, words that a line break cut in two put together again."""
    if _MAYBE_BROKEN.search(text):
        text = _BROKEN.sub("", _INVISIBLE.sub("", text))
    if not text.isascii():
        if _HAS_INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFKC", text)
        if _WIDE.search(text):
            text = _OTHER_DIGIT.sub(lambda m: _digit(m.group()), text)
    return text.casefold()


def tokens(text: str) -> list[str]:
    """Words, numbers, and single characters of scripts without spaces, in order. Punctuation is none."""
    text = normalize(text)
    return (_TOKEN if _WIDE.search(text) else _PLAIN_TOKEN).findall(text)
