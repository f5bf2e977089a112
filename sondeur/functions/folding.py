"""Folding of accented Latin letters and compatibility forms to ASCII, derived from Unicode's decompositions."""

from __future__ import annotations

import unicodedata
from functools import cache

#: Letters that have no decomposition but an accepted spelling in ASCII.
_SPELT = {
    "ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ø": "o", "Ø": "o", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "đ": "d", "Đ": "d", "ħ": "h", "Ħ": "h", "ı": "i", "ĸ": "q",
    "ł": "l", "Ł": "l", "ŋ": "n", "Ŋ": "n", "ŧ": "t", "Ŧ": "t", "ƀ": "b", "ɓ": "b", "ƈ": "c", "ɗ": "d", "ƒ": "f", "ɠ": "g", "ƙ": "k", "ɲ": "n", "ƥ": "p", "ƭ": "t", "ʋ": "v", "ƴ": "y", "ƶ": "z", "ǝ": "e", "ə": "a", "ⱥ": "a", "ɨ": "i", "ɵ": "o", "ʉ": "u", "ǥ": "g",
    "‐": "-", "‑": "-", "–": "-", "—": "-", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‹": "'", "›": "'", "′": "'", "″": '"', "⁄": "/",
}
#: Blocks whose decompositions are looked at: Latin, its extensions, letterlike and numeric forms, fullwidth forms.
_BLOCKS = ((0xAA, 0x24F), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0x2460, 0x24EA), (0x249C, 0x24E9), (0x2C60, 0x2C7F), (0xA722, 0xA787), (0xFB00, 0xFB06), (0xFF01, 0xFF5E))


@cache
def table() -> dict[str, str]:
    """Character to its lower-case ASCII; only what changes."""
    out = dict(_SPELT)
    for low, high in _BLOCKS:
        for code in range(low, high + 1):
            c = chr(code)
            if c in out:
                continue
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("⁄", "/")
            if plain and plain.isascii() and not plain.isspace():
                out[c] = plain.lower()
    return out


@cache
def single() -> tuple[str, str]:
    """(from, to) of the letters that fold to one."""
    pairs = [(a, b) for a, b in table().items() if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def multiple() -> tuple[tuple[str, str], ...]:
    """Letters that fold to several."""
    return tuple((a, b) for a, b in table().items() if len(b) > 1)


def fold(text: str) -> str:
    known = table()
    return "".join(known.get(c, c) for c in text)
