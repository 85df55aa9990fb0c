"""Latin spellings of letters, worked out from their Unicode names and decompositions.

No table of another project is used: a consonant is written as its letter's name begins, so
ARABIC LETTER SHEEN is 'sh' and GREEK SMALL LETTER MU is 'm'; kana and Hangul are named after
their sound.  Ideographs have no sound in their names and give nothing.
"""

from __future__ import annotations

import functools
import re
import unicodedata

_NAME = re.compile(r"(LATIN|ARABIC|GREEK|CYRILLIC|HIRAGANA|KATAKANA)(?: SMALL| CAPITAL)? LETTER (?:(SMALL) )?(?:FARSI |BARRED |DOTLESS |SHARP |FINAL )?([A-Z]+)( MARBUTA| MAKSURA)?")
_OPEN = re.compile(r"[^aeiou]*")
_SMALL_TU = "っッ"
_SOUND = {"si": "shi", "ti": "chi", "tu": "tsu", "zi": "ji", "di": "ji", "du": "zu", "hu": "fu"}


@functools.lru_cache(maxsize=1 << 16)
def roman(ch: str) -> str:
    """The spelling of one lower-case letter; empty for what has none."""
    if ch == "'" or ch.isascii() and ch.isalpha():
        return ch
    name = unicodedata.name(ch, "")
    if name.startswith("HANGUL SYLLABLE "):
        return name[16:].lower()
    if m := _NAME.match(name):
        script, small, word, kind = m.groups()
        word = word.lower()
        if script in ("HIRAGANA", "KATAKANA"):
            return word if small else _SOUND.get(word, word)
        if script == "ARABIC":
            return "'" if word in ("ain", "hamza") else "a" if kind or word[0] == "a" else _OPEN.match(word).group() or word[0]
        if script == "LATIN":
            bare = unicodedata.normalize("NFKD", ch)[0]
            return bare if bare.isascii() else "ss" if word == "s" else "d" if word == "eth" else _OPEN.match(word).group() if len(word) > 2 else word
        # Greek and Cyrillic: 'mu' is m, 'el' is l, 'alpha' is a
        return word[1] if len(word) == 2 and word[0] == "e" else _OPEN.match(word).group() or word[0]
    bare = "".join(x for x in unicodedata.normalize("NFKD", ch) if unicodedata.category(x) != "Mn")
    return "".join(roman(x) for x in bare) if bare != ch else ""


def spell(word: str) -> str:
    """The letters of a word, with the rules for small kana."""
    out = ""
    double = False
    for ch in word:
        if ch in _SMALL_TU:
            double = True
            continue
        x, name = roman(ch), unicodedata.name(ch, "")
        if " LETTER SMALL Y" in name and out.endswith("i") and name.startswith(("HIRAGANA", "KATAKANA")):
            # ki and small ya are kya; shi and small ya are sha
            out = out[:-1] + (x[1:] if out.endswith(("shi", "chi", "ji")) else x)
            continue
        if double and x:
            x = ("t" if x.startswith("ch") else x[0] if x[0] not in "aeiou'" else "") + x
        double = False
        out += x
    return out


@functools.lru_cache(maxsize=1 << 16)
def is_blanked(ch: str) -> bool:
    """Punctuation, symbols and private characters, but for the apostrophe and the hyphen inside words."""
    return ch not in "'-" and unicodedata.category(ch)[0] in "PS" or unicodedata.category(ch) == "Co"


@functools.lru_cache(maxsize=1 << 16)
def is_dropped(ch: str) -> bool:
    """Vowel signs of Arabic and characters that only format."""
    kind = unicodedata.category(ch)
    return kind == "Cf" or kind == "Mn" and unicodedata.name(ch, "").startswith("ARABIC")
