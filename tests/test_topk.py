"""Samples as a mergeable state."""

import itertools

import pytest

from moodlens.operators.topk import merge_states, sample_state, samples
from moodlens.plans import analyses as A
from moodlens.schemas import POST
from tests.conftest import post


def made(spark):
    rows = [post(str(i), text=f"t{i}", tags=[["positive keywords"], ["negative emojis"], [], ["not positive", "x"]][i % 4],
                 created=None if i == 9 else f"2021-03-01T{i % 5:02d}:00:00.000Z") for i in range(60)]
    rows += rows[:6] + [post(None, text=None, tags=["positive keywords"], created=None)]
    return spark.createDataFrame(rows, POST).persist()


@pytest.mark.parametrize("n", [1, 5, 100])
def test_equals_the_two_scan_form(spark, n):
    df = made(spark)
    assert sorted(map(tuple, samples(sample_state(df, n)).collect()), key=repr) == sorted(map(tuple, A.sample_posts(df, n).collect()), key=repr)


@pytest.mark.parametrize("latest", [False, True])
def test_states_merge_in_any_order(spark, latest):
    df = made(spark)
    rows = lambda s: sorted(map(tuple, s.collect()), key=repr)
    whole = rows(sample_state(df, latest=latest))
    parts = [sample_state(p, latest=latest) for p in df.randomSplit([1.0, 1.0, 1.0], seed=3)]
    for a, b, c in itertools.permutations(parts):
        assert rows(merge_states(merge_states(a, b, latest=latest), c, latest=latest)) == whole
    assert rows(merge_states(parts[0], None)) == rows(parts[0])


def test_one_scan_and_no_posts(spark):
    df = spark.createDataFrame([], POST)
    assert sample_state(df).count() == 0
    plan = sample_state(made(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Join" not in plan
