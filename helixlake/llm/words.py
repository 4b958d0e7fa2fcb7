"""The word rule shared by decontamination, the shingle operators and the counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word, once A-Z are lower-cased: a run of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words before lower-casing. Splitting by it is several times faster than finding words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column | str) -> Column:
    """A-Z lower-cased and nothing else, so that lengths and other scripts stay as they are."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def raw_words(text: Column | str) -> Column:
    """Array of the words of a text in the case they are written in; empty for null."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(value, BETWEEN, -1), "")


def words(text: Column | str) -> Column:
    """Array of the lower-cased words of a text; empty for null."""
    return raw_words(lowered(text))


def case_key(word: Column | str) -> Column:
    """Hash that words equal up to case share: a cheap join key, to be settled by an exact comparison."""
    return F.xxhash64(F.lower(F.col(word) if isinstance(word, str) else word))
