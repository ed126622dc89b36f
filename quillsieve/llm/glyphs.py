"""Which characters stand in for which: shared tables of the look-alike and the damage operators."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Letters of other scripts that look like an ASCII letter (look-alike, ASCII).
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԚԜ", "aeopcyxijshdqwABEKMHOPCTYXIJSQW"))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧνϲϳ", "oABEZHIKMNOPTYXvcj"))
OTHER = dict(zip("ɡɑıⅼⅰⅴⅹⅽⅾⅿｌ", "gailivxcdml")) | {"ӏ": "l", "Ӏ": "I", "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h"}
FOREIGN = CYRILLIC | GREEK | OTHER
#: The other way round: the Cyrillic letter that an ASCII letter stands in for.
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k.lower() in "аеорсухіАЕОРСУХІВКМНТ".lower()}
# Characters that cannot be seen.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, 0xFFA0, 0x3164, *range(0xE0000, 0xE0080)]
# Spaces other than the plain one, tab, line feed and return.
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Signs that look like a plain one.
SIGNS = {"\u037e": ";", "\u02d0": ":", "\ua789": ":", "\ua4f8": ".", "\u2024": ".", "\u2044": "/", "\u2215": "/", "\u29f8": "/", "\u01c3": "!"}


@lru_cache(maxsize=1)
def compat() -> dict[str, str]:
    """Compatibility forms of ordinary letters, digits, signs and letter pairs: full- and half-width, mathematical
    alphabets, circled-free font forms, ligatures, digraphs and Roman numeral characters, by Unicode's own decomposition."""
    out = {}
    for o in (*range(0x132, 0x134), 0x17F, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)):
        ch = chr(o)
        how, _, _ = unicodedata.decomposition(ch).partition(" ")
        ligature = 0xFB00 <= o <= 0xFB06 or o < 0x200 or 0x2160 <= o < 0x2180
        if how in ("<font>", "<wide>", "<narrow>") or how == "<compat>" and ligature:
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch:
                out[ch] = plain
    return out


@lru_cache(maxsize=1)
def plain_letter() -> np.ndarray:
    """Code point -> the ASCII or other single character that it stands in for, else itself."""
    out = np.arange(0x110000, dtype=np.int64)
    for ch, to in (FOREIGN | compat() | SIGNS).items():
        if len(to) == 1:
            out[ord(ch)] = ord(to)
    for o in SPACES:
        out[o] = 32
    return out


#: Below U+3000: marks, invisible characters and joiners, which say nothing about an encoding.
EMOJI_LIKE = np.zeros(0x3000, bool)
for _o in range(0x300, 0x370):
    EMOJI_LIKE[_o] = True
for _o in INVISIBLE + SPACES + [0x200D, 0xFE0F]:
    if 0x100 <= _o < 0x3000:
        EMOJI_LIKE[_o] = True
