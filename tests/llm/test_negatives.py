"""Hard negatives against a plain comparison of every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodlens.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"
BOUNDS = {"BLOCK": 16, "GROUP": 4, "STRIPE": 2, "STEP": 5, "CENTRES": 5}


def brute(rows, k=5):
    """(anchor, positive, rank, negative, positive score, negative score) of valid rows (id, vector, label)."""
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows]
    dot = lambda a, b: min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1)
    out = []
    for a, x, l in q:
        if a % 10:
            continue
        scored = sorted((-dot(x, y), i, m) for i, y, m in q if i != a)
        for s, p, _ in [r for r in scored if r[2] == l][:k]:
            hard = [r for r in scored if r[2] != l and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("mine") for c in ("v", "cell", "grp", "score", "rank", "id")})
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def made(n, d, spread, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, d))
    return [(i, [float(x) for x in middle[i % 4] + spread * rng.normal(size=d)], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_equals_comparison_of_all_pairs(spark, monkeypatch, spread):
    for name, value in BOUNDS.items():
        monkeypatch.setattr(negatives, name, value)
    rows = made(120, 6, spread)
    assert mined(spark, rows) == brute(rows)


def test_equal_vectors_and_repeated_rows(spark):
    same = [(i, [1.0, 0.5], i % 2) for i in range(60)]
    rest = [(i, [1.0, i / 100], i % 3) for i in range(60, 90)]
    zero = [(100, [0.0, 0.0], 0), (101, [0.0, 0.0], 1), (110, [-1.0, 0.0], 1)]
    rows = same + rest + zero
    assert mined(spark, rows + rows[:7]) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = made(40, 3, 1.0)
    odd = [(None, [1.0, 1.0, 1.0], 0), (200, None, 0), (210, [1.0, None, 0.0], 1), (220, [1.0, float("nan"), 0.0], 1), (230, [float("inf"), 0.0, 0.0], 1),
           (240, [1.0, 1.0, 1.0], None), (250, [1.0, 2.0], 1), (260, [], 0)]
    assert mined(spark, rows + odd) == brute(rows)


def test_one_row_per_id(spark):
    rows = made(40, 3, 1.0)
    assert mined(spark, [*rows, (7, [9.0, 9.0, 9.0], 9)]) == brute(rows)  # the smaller label stays


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


@pytest.mark.parametrize("size", [2**22, 2**33])
def test_large_components_are_exact_up_to_64_bits(spark, size):
    rows = [(i, [float(size + size // 2**22 * i), float(i)], i % 2) for i in range(0, 30)]
    q = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    assert max(x for v in q for x in v) ** 2 > 2**53
    assert mined(spark, rows) == brute(rows)


def test_bounds_end_lists_early():
    """With close clusters a member leaves the list long before its end."""
    rng = np.random.default_rng(3)
    near, far = np.array([1.0, 0, 0, 0]), np.array([0, 1.0, 0, 0])
    x = np.floor(256 * np.concatenate([near + 0.02 * rng.normal(size=(600, 4)), far + 0.02 * rng.normal(size=(4000, 4))]))
    anchors = x[:20]
    turn, length = negatives.unit(anchors)
    group = {"cluster": 0, "wide": float(negatives.angles(turn, near).max()), "ids": np.arange(20), "labels": np.zeros(20, np.int64), "vectors": anchors,
             "length": length, "needs": np.full((20, 1), -np.inf), "upper": None}
    scored = []
    real = negatives.scores
    negatives.scores = lambda a, b: (scored.append(len(b)), real(a, b))[1]
    try:
        held = negatives.walk(group, {"ids": np.arange(len(x)), "labels": np.zeros(len(x), np.int64), "vectors": x}, [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)], near[None], 5, 0)
    finally:
        negatives.scores = real
    assert len(held[0]) == 100 and sum(scored) <= 2 * negatives.STEP
