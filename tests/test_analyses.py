import math

import pytest

from moodlens.operators.join import dedupe_users, join_users
from moodlens.plans import analyses as A
from moodlens.schemas import POST, USER
from tests.conftest import post, user

POS, NEG = ["positive keywords"], ["negative keywords"]


def _posts(spark, rows):
    return spark.createDataFrame(rows, POST)


def _users(spark, rows):
    return spark.createDataFrame(rows, USER)


def test_polarity_totals(spark):
    df = _posts(spark, [post("1", tags=POS), post("2", tags=NEG), post("3", tags=[]), post("4", tags=POS)])
    assert {r.polarity: r.n_posts for r in A.polarity_totals(df).collect()} == {"positive": 2, "negative": 1}


def test_hourly_drops_hours_with_one_polarity(spark):
    rows = [post("1", tags=POS, created="2021-01-01T01:00:00.000Z"),
            post("2", tags=NEG, created="2021-01-02T01:30:00.000Z"),
            post("3", tags=POS, created="2021-01-01T01:10:00.000Z"),
            post("4", tags=POS, created="2021-01-01T02:00:00.000Z")]
    out = A.hourly_polarity(_posts(spark, rows)).collect()
    assert [(r.hour_utc, r.count_pos, r.count_neg) for r in out] == [("01", 2, 1)]
    assert out[0].pct_pos == pytest.approx(2 / 3) and out[0].pct_neg == pytest.approx(1 / 3)
    kept = A.hourly_polarity(_posts(spark, rows), keep_partial_hours=True).collect()
    assert [(r.hour_utc, r.count_pos, r.count_neg) for r in kept] == [("01", 2, 1), ("02", 1, 0)]


def test_join_drops_unknown_authors_and_does_not_multiply(spark):
    posts = _posts(spark, [post("1", author="a"), post("2", author="b"), post("3", author=None)])
    users = _users(spark, [user("a"), user("a"), user("c")])
    out = join_users(posts, users).collect()
    assert [r.data.id for r in out] == ["1"]


def test_join_with_an_author_of_a_third_of_all_posts(spark):
    rows = [post(str(i), author="hot" if i % 3 == 0 else f"u{i % 7}") for i in range(300)]
    posts = _posts(spark, rows)
    users = _users(spark, [user("hot", followers=5), user("hot", followers=4)] + [user(f"u{i}", followers=i) for i in range(7)])
    out = join_users(posts, users).collect()
    assert sorted(int(r.data.id) for r in out) == list(range(300))
    assert {r.public_metrics.followers_count for r in out if r.id == "hot"} == {5}


def test_dedupe_reads_only_the_named_columns(spark):
    users = _users(spark, [user("a", followers=1), user("a", followers=9), user("b")])
    assert dedupe_users(users, ["verified"]).columns == ["id", "verified"]
    assert sorted(r.id for r in dedupe_users(users, []).collect()) == ["a", "b"]


def test_dedupe_users_is_deterministic(spark):
    users = _users(spark, [user("a", followers=1), user("a", followers=9), user("b")])
    got = {r.id: r.public_metrics.followers_count for r in dedupe_users(users).collect()}
    assert got == {"a": 9, "b": 10}


def test_account_age_cutoff_tie_in_neither_group(spark):
    posts = _posts(spark, [post("1", "old", tags=POS), post("2", "new", tags=NEG),
                           post("3", "tie", tags=POS), post("4", "new", tags=POS)])
    users = _users(spark, [user("old", created="2018-01-01"), user("new", created="2020-01-01"),
                           user("tie", created="2019-01-01")])
    out = {r.description: (r.n_posts, r.percentage) for r in A.account_age_split(posts, users).collect()}
    assert out[A.OLDER_POSITIVE] == (1, 100.0)
    assert out[A.OLDER_NEGATIVE] == (0, 0.0)
    assert out[A.NEWER_POSITIVE] == (1, 50.0)
    assert out[A.NEWER_NEGATIVE] == (1, 50.0)


def test_account_age_empty_group_gives_null_share(spark):
    posts = _posts(spark, [post("1", "new", tags=POS)])
    users = _users(spark, [user("new", created="2020-01-01")])
    out = {r.description: (r.n_posts, r.percentage) for r in A.account_age_split(posts, users).collect()}
    assert out[A.OLDER_POSITIVE] == (0, None)


def test_verified_and_followers(spark):
    posts = _posts(spark, [post("1", "v", tags=POS), post("2", "v", tags=POS), post("3", "n", tags=POS),
                           post("4", "n", tags=NEG), post("5", "x", tags=NEG)])
    users = _users(spark, [user("v", verified=True, followers=100), user("n", verified=False, followers=10)])
    assert {r.polarity: r.n_posts for r in A.verified_counts(posts, users).collect()} == {"positive": 2, "negative": 0}
    fm = {r.polarity: r.avg_followers for r in A.followers_mean(posts, users).collect()}
    assert fm["positive"] == pytest.approx(70.0) and fm["negative"] == pytest.approx(10.0)


def test_mean_of_means_skips_batches_without_polarity(spark):
    posts = _posts(spark, [post("1", "a", tags=POS, created="2021-01-01T00:00:00.000Z"),
                           post("2", "b", tags=NEG, created="2021-01-01T00:00:00.000Z"),
                           post("3", "b", tags=POS, created="2021-01-02T00:00:00.000Z"),
                           post("4", "b", tags=POS, created="2021-01-02T00:00:00.000Z")])
    users = _users(spark, [user("a", followers=10), user("b", followers=30)])
    out = {r.polarity: r.avg_followers for r in A.followers_mean_of_means(posts, users).collect()}
    assert out["positive"] == pytest.approx((10 + 30) / 2)
    assert out["negative"] == pytest.approx(30.0)


def test_activity_split_author_at_mean_in_no_group(spark):
    # author a: 3 posts (2 pos, 1 neg), b: 1 pos, c: 2 pos -> mean 2
    rows = [post("1", "a", tags=POS), post("2", "a", tags=POS), post("3", "a", tags=NEG),
            post("4", "b", tags=POS), post("5", "c", tags=POS), post("6", "c", tags=POS)]
    posts = _posts(spark, rows)
    groups = {(r.polarity, r.activity_group): (r.n_authors, r.n_posts) for r in A.activity_groups(posts).collect()}
    assert groups == {("positive", "at_mean"): (2, 4), ("positive", "less_active"): (1, 1),
                      ("negative", "less_active"): (1, 1)}
    split = {r.description: (r.n_posts, r.percentage) for r in A.activity_split(posts).collect()}
    assert split[A.ACTIVE_POSITIVE][0] == 0 and split[A.ACTIVE_POSITIVE][1] is None
    assert split[A.LESS_ACTIVE_POSITIVE] == (1, 50.0)
    assert split[A.LESS_ACTIVE_NEGATIVE] == (1, 50.0)


def test_activity_null_author_counts_as_zero_in_mean(spark):
    # authors a (3 posts) and the NULL group (count 0) -> mean 1.5; a is active
    rows = [post("1", "a", tags=POS), post("2", "a", tags=POS), post("3", "a", tags=NEG), post("4", None, tags=POS)]
    split = {r.description: r.n_posts for r in A.activity_split(_posts(spark, rows)).collect()}
    assert split[A.ACTIVE_POSITIVE] == 2 and split[A.ACTIVE_NEGATIVE] == 0


def test_sample_posts_first_five_by_time_then_id(spark):
    rows = [post(f"{i:02d}", tags=POS, created=f"2021-01-01T00:00:{59 - i:02d}.000Z") for i in range(8)]
    rows += [post("n1", tags=NEG)]
    out = A.sample_posts(_posts(spark, rows)).collect()
    pos = [r.post_id for r in out if r.polarity == "positive"]
    assert pos == ["07", "06", "05", "04", "03"] or sorted(pos) == ["03", "04", "05", "06", "07"]
    assert [r.post_id for r in out if r.polarity == "negative"] == ["n1"]
    text = A.samples_as_text(A.sample_posts(_posts(spark, rows), n=2)).collect()
    assert {r.polarity for r in text} == {"positive", "negative"}


def test_percentages_add_up(spark):
    rows = [post(str(i), f"u{i % 3}", tags=POS if i % 4 else NEG) for i in range(40)]
    users = _users(spark, [user("u0", created="2010-01-01"), user("u1", created="2020-01-01"),
                           user("u2", created="2015-01-01")])
    out = A.account_age_split(_posts(spark, rows), users).collect()
    older = [r.percentage for r in out if "older" in r.description]
    assert math.isclose(sum(older), 100.0)


def test_account_age_timestamp_compare(spark):
    posts = _posts(spark, [post("1", "full", tags=POS), post("2", "bare", tags=POS)])
    users = _users(spark, [user("full", created="2019-01-01T00:00:00.000Z"), user("bare", created="2019-01-01")])
    as_text = {r.description: r.n_posts for r in A.account_age_split(posts, users).collect()}
    assert as_text[A.NEWER_POSITIVE] == 1  # full ISO text sorts after the bare date
    as_ts = {r.description: r.n_posts for r in A.account_age_split(posts, users, compare="timestamp").collect()}
    assert as_ts[A.NEWER_POSITIVE] == 0 and as_ts[A.OLDER_POSITIVE] == 0  # both equal the cut-off instant


def test_samples_as_text(spark):
    rows = [post("a", tags=POS, text="first"), post("b", tags=POS, text="second"), post("c", tags=NEG, text="bad")]
    out = {r.polarity: r.texts for r in A.samples_as_text(A.sample_posts(_posts(spark, rows))).collect()}
    assert out == {"positive": "first" + A.SAMPLE_SEPARATOR + "second", "negative": "bad"}
