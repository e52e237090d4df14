"""The first posts of each polarity as one mergeable aggregate.

``sample_state`` reads posts once: every task keeps the ``n`` first posts of each
polarity with their texts, and only those travel.  A state is a table of at most
``n`` rows per polarity, so states can be kept and merged (``merge_states``): the
state of two sets of posts merged is the state of both, in any order and grouping.
``plans.sample_posts`` is the plainer form in two scans of the posts.

Spark limits each rank group to ``n`` rows per task before the exchange, and the
order is total over distinct rows, so equal posts give equal states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlens.functions.polarity import CONTAINS, TAG, first_tag, is_negative, is_positive, tag_col

STATE = ("polarity", "created_at", "post_id", "text")


def _order(latest: bool) -> list[Column]:
    columns = [F.col(c) for c in STATE[1:]]
    return [c.desc_nulls_last() if latest else c.asc_nulls_first() for c in columns]


def _first(rows: DataFrame, n: int, latest: bool) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("polarity").orderBy(*_order(latest)))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).select(*STATE)


def sample_state(posts: DataFrame, n: int = 5, match: str = CONTAINS, latest: bool = False) -> DataFrame:
    """The first (or with ``latest`` the last) ``n`` posts per polarity by
    (created_at, id, text): ``polarity, created_at, post_id, text``."""
    flat = posts.select(F.col("data.created_at").alias("created_at"), F.col("data.id").alias("post_id"), F.col("data.text").alias("text"), first_tag().alias(TAG))
    polarity = F.explode(F.array_compact(F.array(F.when(is_positive(match, tag_col()), F.lit("positive")),
                                                 F.when(is_negative(match, tag_col()), F.lit("negative")))))
    return _first(flat.select(polarity.alias("polarity"), "created_at", "post_id", "text"), n, latest)


def merge_states(a: DataFrame, b: DataFrame | None, n: int = 5, latest: bool = False) -> DataFrame:
    """The state of the posts of both (``b`` may be missing)."""
    return a if b is None else _first(a.select(*STATE).unionByName(b.select(*STATE)), n, latest)


def samples(state: DataFrame) -> DataFrame:
    """``polarity, post_id, text``, as ``plans.sample_posts`` gives them."""
    return state.select("polarity", "post_id", "text")
