"""Column helpers shared by the operators that work on words inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space that parts words, as a pattern and as characters.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """Words between runs of white space; none for a null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def count_without(text: Column, characters: str) -> Column:
    """Code points of `text` that are none of `characters`."""
    return F.length(F.translate(text, characters, ""))


def upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
