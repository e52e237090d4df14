"""Polarity of a post, decided by the tag of its FIRST matching rule.

Two spellings exist in the original queries: substring (``LIKE '%positive%'``)
and prefix (``LIKE 'positive%'``).  They agree on the four known tags but not
in general (``"not positive"``), so both are kept behind ``match``.  By
substring one tag can satisfy both tests, so positive and negative are two
independent booleans rather than one label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTAINS = "contains"
PREFIX = "prefix"
# Column name used when the first tag is projected once and reused.
TAG = "_first_tag"


def first_tag(rules: str | Column = "matching_rules") -> Column:
    """Tag of the first matching rule; NULL when the array is NULL or empty.

    ``F.get`` returns NULL out of bounds, where ``arr[0]`` would throw under
    ANSI mode.
    """
    col = F.col(rules) if isinstance(rules, str) else rules
    return F.get(col.getField("tag"), F.lit(0))


def _tag_test(tag: Column, word: str, match: str) -> Column:
    if match == CONTAINS:
        return tag.contains(word)
    if match == PREFIX:
        return tag.startswith(word)
    raise ValueError(f"match must be {CONTAINS!r} or {PREFIX!r}, got {match!r}")


def is_positive(match: str = CONTAINS, tag: Column | None = None) -> Column:
    """NULL-safe boolean: the first tag says positive."""
    return F.coalesce(_tag_test(first_tag() if tag is None else tag, "positive", match), F.lit(False))


def is_negative(match: str = CONTAINS, tag: Column | None = None) -> Column:
    return F.coalesce(_tag_test(first_tag() if tag is None else tag, "negative", match), F.lit(False))


def hour_utc(created_at: str | Column = "data.created_at") -> Column:
    """Hour of day as the two characters 12-13 of the ISO-8601 UTC text."""
    col = F.col(created_at) if isinstance(created_at, str) else created_at
    return F.substring(col, 12, 2)


def flag(cond: Column) -> Column:
    """1 when ``cond`` holds, else 0 (for additive pre-aggregation)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def tag_col() -> Column:
    """The projected first tag (see ``TAG``)."""
    return F.col(TAG)


RULES_TYPE = "array<struct<id:string,tag:string>>"


def no_rules() -> Column:
    """An empty ``matching_rules`` array of the right type."""
    return F.array().cast(RULES_TYPE)


def rule_matches(rules: list[tuple[Column, str, str]]) -> Column:
    """``matching_rules`` from ``[(condition, rule_id, tag), ...]`` in rule order.

    Built as a ``concat`` of one-element-or-empty arrays, which stays inside
    whole-stage codegen (a lambda ``filter`` over the array would not).  A
    NULL condition counts as not holding.
    """
    if not rules:
        return no_rules()
    parts = [F.when(cond, F.array(F.struct(F.lit(rule_id).alias("id"), F.lit(tag).alias("tag"))))
              .otherwise(no_rules())
             for cond, rule_id, tag in rules]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
