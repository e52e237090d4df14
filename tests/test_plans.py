"""Plan-shape guards for the scale properties the README claims."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from moodlens.operators.join import join_users
from moodlens.plans.registry import posts_e, users_e
from tests.conftest import SF_SMALL


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_scan_is_pruned(spark):
    plan = _final_plan(E.queries()["polarity_totals"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: (struct<[^ ]*>)", plan).group(1)
    assert "event_type" in schema and "props" not in schema and "ts" not in schema


def test_activity_split_scans_posts_once(spark):
    plan = _final_plan(E.queries()["activity_split"](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "Subquery" not in plan


def test_indicator_counts_has_no_nested_loop_join(spark):
    plan = _final_plan(E.queries()["indicator_counts"](spark, SF_SMALL))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_rule_tagging_tokenises_once(spark):
    plan = _final_plan(E.queries()["rule_tagging"](spark, SF_SMALL))
    assert plan.count("split(lower(") == 1


def _scans(plan) -> list[str]:
    return re.findall(r"FileScan parquet", plan)


def test_user_questions_read_no_orders(spark):
    for name in ("verified_counts", "followers_mean", "followers_mean_of_means"):
        plan = _final_plan(E.queries()[name](spark, SF_SMALL))
        assert len(_scans(plan)) == 2 and "SortAggregate" not in plan and "o_orderdate" not in plan


def _exchanges_of_text(plan) -> list[int]:
    """Places in a plan of exchanges whose rows hold a text."""
    lines = plan.splitlines()
    return [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and re.search(r"\btext#", lines[i + 1])]


def test_no_exchange_carries_texts(spark):
    assert not _exchanges_of_text(_final_plan(E.queries()["indicator_quality"](spark, SF_SMALL)))
    plan = _final_plan(E.queries()["sample_posts"](spark, SF_SMALL))
    sampled = next(i for i, x in enumerate(plan.splitlines()) if "BroadcastHashJoin" in x)
    assert all(i < sampled for i in _exchanges_of_text(plan))  # above the join that picks ten of them


def test_joined_indicators_read_author_and_text_alone(spark):
    plan = _final_plan(E.queries()["indicator_counts_joined"](spark, SF_SMALL))
    schema = next(s for s in re.findall(r"ReadSchema: (struct<[^ ]*>)", plan) if "event_type" in s)
    assert "event_id" not in schema and "ts:" not in schema


def test_user_join_is_plain(spark):
    df = join_users(posts_e(spark, SF_SMALL), users_e(spark, SF_SMALL), dedupe=False)
    plan = _final_plan(df)
    assert "Union" not in plan and "NestedLoop" not in plan
    assert df.count() == posts_e(spark, SF_SMALL).where(F.col("data.author_id").isNotNull()).count()
