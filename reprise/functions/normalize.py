"""Normalisation of units and their tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders, and the patterns of what they stand for, in order of application.
LITERALS = (
    (r'"[^"\n]*"', "STRING_LIT"),
    (r"\b[0-9]+\.[0-9]+\b", "DOUBLE_LIT"),
    (r"\b[0-9]+[lL]\b", "LONG_LIT"),
    (r"\b[0-9]+\b", "INT_LIT"),
    (r"\b(?:true|false)\b", "BOOL_LIT"),
    (r"\bnull\b", "NULL_LIT"),
)
COMMENTS = r"(?s)/\*.*?\*/"


def literals(text: Column) -> Column:
    """Literals become placeholders; placeholders stay, as no pattern meets them."""
    for pattern, to in LITERALS:
        text = F.regexp_replace(text, pattern, to)
    return text


def strict(text: Column) -> Column:
    """Block comments go, literals become placeholders."""
    return literals(F.regexp_replace(text, COMMENTS, ""))


def fuzzy(text: Column) -> Column:
    """Case and numbers don't count: for prose, where there are no names to replace."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, COMMENTS, "")), "[0-9]+", "NUM_LIT")


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\r\n]+", -1), lambda x: x != "")


def canonical(text: Column) -> Column:
    """A body without any white space."""
    return F.regexp_replace(text, r"[ \t\r\n]+", "")
