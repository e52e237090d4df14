"""Posts parked in keyed state, users as versions, windows per author."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlens.operators.versions import as_of_join, user_versions
from moodlens.plans import analyses as A
from moodlens.schemas import POST, USER
from moodlens.session import configured
from moodlens.streaming.parked import ARRIVED, STATE_STORE, ParkedPosts, _order, join_arriving
from moodlens.streaming.sinks import per_batch_writer, run_available
from moodlens.streaming.sources import file_stream
from tests.conftest import post, user

AT = T.StructField(ARRIVED, T.TimestampType())
POSTS, USERS = T.StructType([*POST.fields, AT]), T.StructType([*USER.fields, AT])


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


@pytest.fixture
def arrivals(spark, tmp_path):
    """A function that lands posts and users and runs the stream once."""
    folders = {n: str(tmp_path / n) for n in ("posts", "users", "ckpt", "out")}

    def run(posts=(), users=(), expiry="4 days"):
        spark.createDataFrame([(*p, t) for p, t in posts], POSTS).coalesce(1).write.mode("append").parquet(folders["posts"])
        spark.createDataFrame([(*u, t) for u, t in users], USERS).coalesce(1).write.mode("append").parquet(folders["users"])
        streams = file_stream(spark, folders["posts"], POSTS), file_stream(spark, folders["users"], USERS)
        with configured(spark, {**STATE_STORE, "spark.sql.shuffle.partitions": "2"}):
            run_available(join_arriving(*streams, expiry=expiry, salts=2), folders["ckpt"], foreach_batch=per_batch_writer(lambda x: x, folders["out"]))
        rows = spark.read.parquet(folders["out"])
        return {(r.status, r.waited, r.data and r.data.id, r.verified, r.n_posts if r.status == "unknown" else 1) for r in rows.collect() if r.status != "unknown"}, rows

    return run


def test_posts_wait_for_their_author_and_are_let_go(arrivals):
    seen, rows = arrivals([(post("1", "a"), at(1)), (post("2", "b"), at(1)), (post("3", None), at(1)), (post("4", "c"), at(2))], [(user("a", verified=True), at(1))])
    assert seen == {("joined", False, "1", True, 1)}
    assert {(r.author_id, r.n_posts) for r in rows.where("status = 'unknown'").collect()} == {("b", 1), ("c", 1)}
    # b's user comes in time, c's doesn't; a restart on the checkpoint keeps both
    seen, _ = arrivals([(post("5", "b"), at(4))], [(user("b"), at(4)), (user(None), at(4))])
    assert ("joined", True, "2", False, 1) in seen and ("joined", False, "5", False, 1) in seen
    seen, _ = arrivals([(post("6", "a"), at(9))], [(user("x"), at(9))])
    assert ("expired", True, "4", None, 1) in seen and ("joined", False, "6", True, 1) in seen
    seen, _ = arrivals([(post("7", "c"), at(10))], [(user("c"), at(10))])
    assert ("joined", False, "7", False, 1) in seen
    assert len([x for x in seen if x[2] == "4"]) == 1 and len(seen) == 6


def test_the_largest_user_row_counts_from_the_next_micro_batch_on(arrivals):
    rows = [(user("a", created="2019-01-01"), at(1)), (user("a", created="2018-01-01", verified=True), at(1))]
    assert arrivals([(post("1", "a"), at(1))], rows)[0] == {("joined", False, "1", False, 1)}
    arrivals([(post("2", "a"), at(2))], [(user("a", created="2020-01-01", verified=True), at(2))])
    assert ("joined", False, "3", True, 1) in arrivals([(post("3", "a"), at(3))])[0]


def test_nulls_are_smallest_and_expiry_is_rounded_up():
    assert _order((None, True, 5)) < _order(("2018", None, None)) < _order(("2018", False, None))
    parked = ParkedPosts(1600)
    assert parked.until(0) == 1600 and parked.until(1) == 1700


class Handle:
    """The state of one key, with a count of the calls that ask the state store."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, key, value):
        return Value(self, name)

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.discard(t)


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def getValue(self, key):
        self.handle.calls += 1
        return self.handle.values.get((self.name, key))

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.handle.values[self.name, key] = value

    def removeKey(self, key):
        self.handle.calls += 1
        del self.handle.values[self.name, key]

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def clear(self):
        self.handle.calls += 1
        self.handle.values.pop((self.name, None), None)


class Fired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def key_of(expiry=1600):
    handle, job = Handle(), ParkedPosts(expiry)
    job.init(handle)
    posts = lambda rows: [(0, 0, None, a, ms, p, None, None, None) for a, ms, p in rows]
    users = lambda ids, at=0: [(0, 0, None, a, at, None, "2018", True, i) for i, a in enumerate(ids)]
    run = lambda rows: sorted((r.status, r.waited, r.author_id, r.post or "", r.n_posts) for r in job.handleInputRows((0, 0), iter(rows), None))
    fire = lambda ms: sorted((r.status, r.author_id, r.post) for r in job.handleExpiredTimer((0, 0), None, Fired(ms)))
    return handle, posts, users, run, fire


def test_calls_of_the_state_store_do_not_grow_with_the_users_of_a_key():
    handle, posts, users, run, _ = key_of()
    ids = [f"a{i}" for i in range(500)]
    run(users(ids))
    assert handle.calls <= 4
    handle.calls = 0
    assert run(posts([(a, 0, "p") for a in ids])) == sorted(("joined", False, a, "p", 1) for a in ids) and handle.calls <= 4
    handle.calls = 0
    run(posts([(f"b{i}", 0, "p") for i in range(500)]))
    run(users([f"b{i}" for i in range(500)]))
    assert handle.calls <= 12


def test_posts_of_authors_that_share_a_key_go_on_or_expire_by_themselves():
    handle, posts, users, run, fire = key_of()
    assert run(posts([("a", 0, "1"), ("b", 0, "2"), ("a", 150, "3")])) == [("unknown", False, "a", "", 2), ("unknown", False, "b", "", 1)]
    assert handle.timers == {1600, 1800}
    # one micro-batch with a's user, another post of a, one of b, and more of c than a chunk holds
    many = [("c", 200, str(i)) for i in range(2500)]
    got = run([*posts([("a", 200, "4"), ("b", 300, "5"), *many]), *users(["a"])])
    assert got == sorted([("joined", True, "a", "1", 1), ("joined", True, "a", "3", 1), ("joined", False, "a", "4", 1), ("unknown", False, "b", "", 1), ("unknown", False, "c", "", 2500)])
    assert fire(1600) == [("expired", "b", "2")] and fire(1600) == []
    assert fire(1800) == sorted(("expired", "c", str(i)) for i in range(2500))
    assert run(users(["b"])) == [("joined", True, "b", "5", 1)]
    assert handle.timers <= {1600, 1800} and [n for n, _ in handle.values if n != "users"] == []


def test_a_chunk_that_waits_stays_readable_when_small_ones_join_it():
    handle, posts, users, run, _ = key_of()
    for i in range(64):
        run(posts([(f"a{i % 4}", i, str(i))]))
    assert sum(n == "chunks" for n, _ in handle.values) <= 7
    assert {r[3] for r in run(users(["a1"]))} == {str(i) for i in range(64) if i % 4 == 1}
    assert {r[3] for r in run(users(["a0", "a2", "a3"]))} == {str(i) for i in range(64) if i % 4 != 1}


def test_keyed_live_equals_the_archive(spark, tmp_path):
    from moodlens.plans.registry import FIXTURE_LEXICON, posts_e, users_e
    from moodlens.streaming.live import KeyedLive
    from tests.conftest import SF_SMALL

    posts, users = posts_e(spark, SF_SMALL).persist(), users_e(spark, SF_SMALL).persist()
    flat = (posts.join(users, F.col("data.author_id") == F.col("id"))
            .select(F.lit("joined").alias("status"), F.lit(False).alias("waited"), F.lit(1).cast("bigint").alias("n_posts"), F.col("data.author_id").alias("author_id"),
                    "data", "matching_rules", "created_at", "verified", "public_metrics"))
    half = F.col("data.id").cast("long") % 2 == 0
    lost = flat.where(half).limit(3).withColumn("status", F.lit("expired")).withColumn("waited", F.lit(True))
    job = KeyedLive(spark, str(tmp_path / "keyed"), FIXTURE_LEXICON, "1995-07-01")
    job.batch(flat.where(half), 0)
    job.batch(flat.where(~half).unionByName(lost), 1)
    job.batch(flat.where(~half).unionByName(lost), 1)  # replayed
    assert {r.polarity: r.n_posts for r in job.total("verified").collect()} == {r.polarity: r.n_posts for r in A.verified_counts(posts, users).collect()}
    assert job.total("observed").first().n_posts == flat.count()
    assert sum(r.n_posts for r in job.total("expired").collect()) <= 3
    true = {r.polarity: r.avg_followers for r in A.followers_mean(posts, users).collect()}
    for r in job.followers().collect():
        assert r.true_mean == pytest.approx(true[r.polarity]) and r.n_batches == 2
    assert "expired posts" in job.tables()


SNAPSHOT = T.StructType([*USER.fields, T.StructField("seen_at", T.TimestampType())])


def snapshots(spark, rows):
    return spark.createDataFrame([(*u, t) for u, t in rows], SNAPSHOT)


def test_a_post_sees_the_version_of_its_time(spark):
    versions = user_versions(snapshots(spark, [
        (user("a", followers=1), at(2)), (user("a", followers=1), at(3)), (user("a", followers=2), at(5)), (user("a", followers=3), at(5)),
        (user("b", followers=9), at(9)), (user(None), at(1)), (user("c"), None)]))
    assert sorted((r.id, r.since.day, r.until and r.until.day, r.user.public_metrics.followers_count) for r in versions.collect()) == [
        ("a", 2, 5, 1), ("a", 5, None, 3), ("b", 9, None, 9)]
    iso = "2024-01-{:02d}T{:02d}:00:00.000Z"
    rows = [post("1", "a", created=iso.format(1, 0)), post("2", "a", created=iso.format(2, 0)), post("3", "a", created=iso.format(4, 23)),
            post("4", "a", created=iso.format(5, 0)), post("5", "a", created=iso.format(30, 1)), post("6", "b", created=iso.format(3, 0)), post("6", "b", created=iso.format(3, 0)),
            post("7", "c", created=iso.format(3, 0)), post("8", None), post("9", "a", created="no time"), post("10", "a", created=None)]
    posts = spark.createDataFrame(rows, POST)
    seen = lambda df: sorted((r.post_id, r.followers) for r in A.post_user_table(df).collect())
    assert seen(as_of_join(posts, versions)) == [("1", 1), ("2", 1), ("3", 1), ("4", 3), ("5", 3), ("6", 9), ("6", 9)]
    assert seen(as_of_join(posts, versions, before="drop")) == [("2", 1), ("3", 1), ("4", 3), ("5", 3)]
    assert seen(as_of_join(posts, versions, width="1 hour")) == seen(as_of_join(posts, versions, width="20 days"))
    with pytest.raises(ValueError):
        as_of_join(posts, versions, before="never")


def test_as_of_join_without_rows(spark):
    none = user_versions(snapshots(spark, []))
    assert as_of_join(spark.createDataFrame([post("1", "a")], POST), none).count() == 0
    some = user_versions(snapshots(spark, [(user("a"), at(1))]))
    assert as_of_join(spark.createDataFrame([], POST), some).count() == 0


def test_author_windows_shuffle_one_row_per_task_and_author(spark):
    """A hot author: what the exchange carries doesn't grow with its posts."""
    from moodlens.streaming.analyses import author_windows

    rows = [(*post(str(i), "hot" if i % 3 else f"a{i % 7}", tags=["positive keywords"]), at(1, i % 2)) for i in range(3000)]
    df = author_windows(spark.createDataFrame(rows, POSTS).repartition(4), ARRIVED)
    assert df.groupBy("author_id").agg(F.sum("pos").alias("n")).where("author_id = 'hot'").first().n == 2000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
