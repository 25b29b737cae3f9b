"""Words of a text as built-in column expressions: lower-case A-Z, then runs of digits, a-z and non-ASCII characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CAPITALS = "".join(map(chr, range(65, 91)))
_BREAKS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def spaced(text: Column) -> Column:
    """The text with A-Z lower-cased and every ASCII character that is in no word replaced by a blank; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _BREAKS, _CAPITALS.lower() + " " * len(_BREAKS))


def words(text: Column) -> Column:
    """The words in order."""
    return F.array_remove(F.split(spaced(text), " ", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the optimizer never copies what a lambda variable stands for."""
    return F.get(F.transform(F.array(value), body), 0)
