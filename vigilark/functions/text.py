"""Folding of typed names, on the JVM side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin capitals or small letters.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ѕ": "S", "Ј": "J", "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}

# Letters without a decomposition.
_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "ð": "d", "ı": "i"}

_BLOCKS = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFF01, 0xFF5F), (0xFB00, 0xFB07))


@lru_cache
def _accents() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that stand for one other character, what they stand for, and those that stand for several; by their decompositions."""
    one, many = {}, []
    for lo, hi in _BLOCKS:
        for cp in range(lo, hi):
            c = chr(cp)
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain == c or not plain or not any(x.isalnum() for x in plain):
                continue
            if len(plain) == 1:
                one[c] = plain
            elif lo == 0xFB00 or c in "ĳĲǆǅǄǉǈǇǌǋǊǳǲǱ":
                many.append((c, plain))
    many += [(c, p) for c, p in _LETTERS.items() if len(p) > 1]
    one |= {c: p for c, p in _LETTERS.items() if len(p) == 1}
    return "".join(one), "".join(one.values()), tuple(many)


def fold_accents(c: Column) -> Column:
    """Text without accents: letters of the Latin, Greek and Cyrillic blocks and full-width forms by their decomposition, combining
    marks removed. Case is kept. Null gives null."""
    single, plain, many = _accents()
    out = F.translate(F.regexp_replace(c, r"\p{M}+", ""), single, plain)
    hard = "[" + "".join(m for m, _ in many) + "]"
    multi = out
    for m, p in many:
        multi = F.replace(multi, F.lit(m), F.lit(p))
    return F.when(out.rlike(hard), multi).otherwise(out)


def fold_lookalikes(c: Column) -> Column:
    """Cyrillic and Greek letters that look like Latin ones become these."""
    return F.translate(c, "".join(_LOOKALIKES), "".join(_LOOKALIKES.values()))


def name_key(c: Column) -> Column:
    """Letters and digits only, lower case, without accents: equal for names that differ in case, accents, spacing and
    punctuation. Null gives null; a name of punctuation only gives the empty text."""
    return F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N}]+", "")
