"""Letters without marks, as native expressions: the tables are built from Unicode by rule."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that have no decomposition but a usual Latin spelling.
_STROKES = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T"}
_LONG = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}


def _table() -> tuple[str, str]:
    pairs = dict(_STROKES)
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(point))
        if base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]) and len(base) > 1:
            pairs[chr(point)] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _table()


def unmarked(c: Column) -> Column:
    """Latin letters without diacritics, combining marks dropped; other scripts stay as they are."""
    for long, short in _LONG.items():
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}+", "")
