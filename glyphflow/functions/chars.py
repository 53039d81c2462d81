"""Character classes and the folding of compatibility ideographs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as dictionary files know them: the same class everywhere, whatever Java's or Python's is.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same for a regular expression's class.
SPACE_CLASS = "".join(f"\\u{ord(c):04x}" for c in SPACE)

PUA_FIRST, PUA_LAST = 0xE000, 0xF8FF
_PUA = {c: None for c in range(PUA_FIRST, PUA_LAST + 1)}
_COMPAT_BLOCKS = ((0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _compat_pairs() -> dict[int, str]:
    out = {}
    for first, last in _COMPAT_BLOCKS:
        for c in range(first, last + 1):
            folded = unicodedata.normalize("NFC", chr(c))
            if folded != chr(c) and len(folded) == 1:
                out[c] = folded
    return out


#: Compatibility ideographs that canonical composition maps to another character.
COMPAT = _compat_pairs()


# the blocks' bounds: a class of single characters beyond the basic plane is searched one by one
_ANY_COMPAT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _COMPAT_BLOCKS) + "]")


def fold_compat(column: Column) -> Column:
    """Compatibility ideographs folded, everything else untouched; null stays null."""
    odd = column.rlike("[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _COMPAT_BLOCKS) + "]")
    return F.when(odd, F.translate(column, "".join(map(chr, COMPAT)), "".join(COMPAT.values()))).otherwise(column)


def fold_compat_text(text: str) -> str:
    return text.translate(COMPAT) if not text.isascii() and _ANY_COMPAT.search(text) else text


def strip_pua(column: Column) -> Column:
    return F.regexp_replace(column, "[\\uE000-\\uF8FF]", "")


def strip_pua_text(text: str) -> str:
    return text.translate(_PUA)


def bare_characters(lines: Column) -> Column:
    """Whether a line holds a character that source files should only have escaped: controls, private use, compatibility ideographs."""
    return lines.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uE000-\\uF8FF\\uF900-\\uFAFF]")
