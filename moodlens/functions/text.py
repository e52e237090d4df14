"""Text matching helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token separator: anything that is not a letter, a digit or an apostrophe.
TOKEN_SPLIT = r"[^\p{L}\p{N}']+"


def lower_text(text: str | Column = "data.text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.lower(col)


def tokens(text: str | Column = "data.text") -> Column:
    """Lower-cased word tokens of the whole text.

    A leading or trailing separator yields an empty string element; it never
    equals a term, so it is left in (filtering it would cost a lambda pass).
    """
    return F.split(lower_text(text), TOKEN_SPLIT)


def token_text(text: str | Column = "data.text") -> Column:
    """Lower-cased text with every separator run replaced by one space and
    padded with spaces: a phrase of tokens occurs in it as `` a b ``."""
    return F.concat(F.lit(" "), F.regexp_replace(lower_text(text), TOKEN_SPLIT, " "), F.lit(" "))


def displayed(table: DataFrame) -> DataFrame:
    """``line``: each row as the command line prints it, whole and unpadded (NULL
    for a null; line breaks in a text stay in it)."""
    return table.select(F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in table.columns]).alias("line"))


def has_non_ascii(text: str | Column = "data.text") -> Column:
    """True when the text holds any non-ASCII character (bytes > chars)."""
    col = F.col(text) if isinstance(text, str) else text
    return F.octet_length(col) > F.length(col)
