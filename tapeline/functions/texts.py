"""Text expressions used by the scoring jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a comment and white space in an answer.
NUMBER = r"-?\d+(?:\.\d+)?"
COMMENT, BLANK = r"--[^\n]*", r"\s+"

# A whole word of an answer, such as a member code.
WORD = r"[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*"


def normalise(text: Column) -> Column:
    """Drop ``--`` comments, collapse white space, lower the case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, COMMENT, " "), BLANK, " "))


def numbers_in(text: Column) -> Column:
    """Every number written in a text, as ``array<double>``."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: n.cast("double"))


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """True if one of the patterns occurs; false for none and for a null text."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The first pattern, in the given order, that occurs in the text."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(p)) for p in patterns]) if patterns \
        else F.lit(None).cast("string")
