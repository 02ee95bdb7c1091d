"""Column builders for text that the operators of this subpackage share.

White space is the six ASCII characters ``[\\x20\\x09-\\x0D]`` and lower-casing covers A-Z only,
unless an operator says otherwise. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: The white space of the text rules, as characters and as regular expressions.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas inside ``use`` name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is exact, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """The runs of characters that aren't white space, in order; an empty array for none."""
    return let(strip(whole(text)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE + "+")))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD_RE)).cast("long")


def lines(text: Column) -> Column:
    return F.split(whole(text), "\n")


def hash128(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: together wide enough to stand for the value."""
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)
