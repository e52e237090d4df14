import pytest
from pyspark.sql import functions as F

from moodlens.plans import analyses as A
from moodlens.plans.registry import FIXTURE_LEXICON, posts_d, posts_e, users_e
from moodlens.operators.indicators import indicator_counts
from moodlens.sources.files import land_posts
from moodlens.streaming import analyses as S
from moodlens.streaming.sinks import EPOCH, latest_epoch, per_batch_writer, run_available, write_epoch
from moodlens.streaming.sources import post_stream, snapshot_users
from tests.conftest import SF_SMALL


def _complete(stream_df, tmp_path, name):
    out, ckpt = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ckpt")
    run_available(stream_df, ckpt, output_mode="complete", foreach_batch=lambda df, e: write_epoch(df, out, e))
    return out


@pytest.fixture(scope="module")
def landed_e(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing-e"))
    land_posts(posts_e(spark, SF_SMALL), path, fmt="parquet", max_records_per_file=50)
    return path


@pytest.mark.parametrize("files_per_trigger", [1, 1000])
def test_stream_verified_equals_batch(spark, tmp_path, landed_e, files_per_trigger):
    users = snapshot_users(spark, users_e(spark, SF_SMALL), "t-verified")
    stream = post_stream(spark, landed_e, max_files_per_trigger=files_per_trigger)
    out = _complete(S.running_verified_counts(S.enrich(stream, users)), tmp_path, "v")
    got = latest_epoch(spark, out).first()
    batch = {r.polarity: r.n_posts for r in A.verified_counts(posts_e(spark, SF_SMALL), users_e(spark, SF_SMALL)).collect()}
    assert (got.pos, got.neg) == (batch["positive"], batch["negative"])
    if files_per_trigger == 1:
        assert spark.read.parquet(out).select(EPOCH).distinct().count() > 1


def test_stream_indicator_counts_equal_batch(spark, tmp_path):
    landing = str(tmp_path / "landing-d")
    land_posts(posts_d(spark, SF_SMALL), landing, fmt="parquet", max_records_per_file=40)
    stream = post_stream(spark, landing, max_files_per_trigger=2)
    out = _complete(S.running_indicator_counts(stream, FIXTURE_LEXICON), tmp_path, "ind")
    got = {(r.position, r.n_posts) for r in S.indicator_rows(latest_epoch(spark, out), FIXTURE_LEXICON).collect()}
    want = {(r.position, r.n_posts) for r in indicator_counts(posts_d(spark, SF_SMALL), FIXTURE_LEXICON).collect()}
    assert got == want


def test_stream_followers_true_mean_and_mean_of_means(spark, tmp_path, landed_e):
    users = snapshot_users(spark, users_e(spark, SF_SMALL), "t-followers")
    stream = post_stream(spark, landed_e, max_files_per_trigger=3)
    out, ckpt = str(tmp_path / "f-out"), str(tmp_path / "f-ckpt")
    run_available(stream, ckpt, foreach_batch=per_batch_writer(S.batch_follower_sums(users, "ingest_date"), out))
    got = {r.polarity: r for r in S.followers_from_sums(spark.read.parquet(out).drop(EPOCH)).collect()}
    posts, u = posts_e(spark, SF_SMALL), users_e(spark, SF_SMALL)
    true = {r.polarity: r.avg_followers for r in A.followers_mean(posts, u).collect()}
    mom = {r.polarity: r.avg_followers for r in A.followers_mean_of_means(posts, u).collect()}
    for k in ("positive", "negative"):
        assert got[k].true_mean == pytest.approx(true[k], rel=1e-12)
        assert got[k].mean_of_means == pytest.approx(mom[k], abs=1e-6)
        assert got[k].n_batches == 30


def test_stream_observed_resumes_from_checkpoint(spark, tmp_path):
    posts = posts_e(spark, SF_SMALL)
    landing, out, ckpt = str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    first = posts.where(F.col("data.created_at") < "2024-01-15")
    land_posts(first, landing, fmt="parquet")
    run_available(S.observed_posts(post_stream(spark, landing)), ckpt, output_mode="complete",
                  foreach_batch=lambda df, e: write_epoch(df, out, e))
    assert latest_epoch(spark, out).first().n_posts == first.count()
    land_posts(posts.where(F.col("data.created_at") >= "2024-01-15"), landing, fmt="parquet")
    # a new query on the same checkpoint continues from the stored state
    run_available(S.observed_posts(post_stream(spark, landing)), ckpt, output_mode="complete",
                  foreach_batch=lambda df, e: write_epoch(df, out, e))
    assert latest_epoch(spark, out).first().n_posts == posts.count()


def test_per_batch_replay_is_idempotent(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "x")
    out = str(tmp_path / "t")
    write_epoch(df, out, 0)
    write_epoch(df, out, 1)
    write_epoch(df, out, 1)  # replay of epoch 1
    assert spark.read.parquet(out).count() == 6


def test_memory_sink_and_landing_stream(spark, tmp_path, landed_e):
    from moodlens.streaming.sinks import land_stream, start
    from moodlens.sources.files import read_posts
    q = start(S.observed_posts(post_stream(spark, landed_e)), str(tmp_path / "m-ckpt"), output_mode="complete",
              fmt="memory", query_name="observed_mem", trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.sql("SELECT n_posts FROM observed_mem").first().n_posts == posts_e(spark, SF_SMALL).count()
    out = str(tmp_path / "landed")
    q2 = land_stream(post_stream(spark, landed_e, max_files_per_trigger=5), out, str(tmp_path / "l-ckpt"),
                     trigger={"availableNow": True})
    q2.awaitTermination()
    assert read_posts(spark, out, fmt="parquet").count() == posts_e(spark, SF_SMALL).count()


def test_running_account_age_equals_batch(spark, tmp_path, landed_e):
    from moodlens.sources.fixtures import FIXTURE_E_CUTOFF
    users = snapshot_users(spark, users_e(spark, SF_SMALL), "t-age")
    stream = post_stream(spark, landed_e, max_files_per_trigger=2)
    out = _complete(S.running_account_age(S.enrich(stream, users), FIXTURE_E_CUTOFF), tmp_path, "age")
    got = {(r.description, r.n_posts, r.percentage) for r in S.account_age_rows(latest_epoch(spark, out)).collect()}
    want = {(r.description, r.n_posts, r.percentage)
            for r in A.account_age_split(posts_e(spark, SF_SMALL), users_e(spark, SF_SMALL),
                                         cutoff=FIXTURE_E_CUTOFF).collect()}
    assert got == want


def test_processing_time_trigger(spark, tmp_path, landed_e):
    from moodlens.streaming.sinks import start
    out = str(tmp_path / "pt-out")
    q = start(S.observed_posts(post_stream(spark, landed_e, max_files_per_trigger=20)), str(tmp_path / "pt-ckpt"),
              output_mode="complete", foreach_batch=lambda df, e: write_epoch(df, out, e),
              trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert latest_epoch(spark, out).first().n_posts == posts_e(spark, SF_SMALL).count()


def test_write_latest_rotates_and_replays(spark, tmp_path):
    from moodlens.streaming.sinks import write_latest
    out = str(tmp_path / "latest")
    for epoch in range(5):
        write_latest(spark.range(epoch + 1), out, epoch)
    write_latest(spark.range(5), out, 4)  # replay of the newest epoch
    import os
    assert sorted(d for d in os.listdir(out) if d.startswith("slot=")) == ["slot=0", "slot=1"]
    assert latest_epoch(spark, out).count() == 5


def test_follower_means_by_micro_batch(spark, tmp_path, landed_e):
    users = users_e(spark, SF_SMALL)
    out, ckpt = str(tmp_path / "m-out"), str(tmp_path / "m-ckpt")
    run_available(post_stream(spark, landed_e, max_files_per_trigger=9), ckpt, foreach_batch=per_batch_writer(S.batch_follower_sums(users), out))
    sums = spark.read.parquet(out)
    n = sums.select(EPOCH).distinct().count()
    assert n > 1 and {r.n_batches for r in S.followers_from_sums(sums, EPOCH).collect()} == {n}


def test_live_parks_posts_of_unknown_authors_and_survives_a_replay(spark, tmp_path):
    from moodlens.streaming.live import Live
    posts, users = posts_e(spark, SF_SMALL).persist(), users_e(spark, SF_SMALL).persist()
    odd = F.col("id").cast("long") % 2 == 1
    seen = {"users": users.where(~odd)}
    job = Live(spark, str(tmp_path / "live"), lambda: seen["users"], FIXTURE_LEXICON, "1995-07-01")
    half = F.col("data.id").cast("long") % 2 == 0
    job.batch(posts.where(half), 0)
    first = {r.author_id for r in spark.read.parquet(job.path("to_fetch")).collect()}
    assert first and all(int(a) % 2 for a in first)
    seen["users"] = users
    job.batch(posts.where(~half), 1)
    job.batch(posts.where(~half), 1)  # replayed
    want = {r.polarity: r.n_posts for r in A.verified_counts(posts, users, dedupe=False).collect()}
    assert {r.polarity: r.n_posts for r in job.total("verified").collect()} == want
    assert job.total("observed").first().n_posts == posts.count()
    assert job.before("parked", 1).count() > 0 and job.before("parked", 2).count() == 0
    seen["users"] = users.where(odd)  # a replay that parks, then one that doesn't: nothing stale stays
    job.batch(posts.where(~half), 1)
    assert job.before("parked", 2).count() > 0
    seen["users"] = users
    job.batch(posts.where(~half), 1)
    assert job.before("parked", 2).count() == 0
    counts = lambda df: {(r.position, r.n_posts) for r in df.collect()}
    assert counts(job.total("indicators")) == counts(indicator_counts(posts, FIXTURE_LEXICON, users=users))
    true = {r.polarity: r.avg_followers for r in A.followers_mean(posts, users, dedupe=False).collect()}
    for r in job.followers().collect():
        assert r.true_mean == pytest.approx(true[r.polarity]) and r.n_batches == 2


def test_live_reads_the_users_once_a_micro_batch(spark, tmp_path):
    """Users listed twice, posts without author, id or rules; users are deduplicated in one pass for all tables."""
    from moodlens.schemas import POST, USER
    from moodlens.streaming.live import Live
    from tests.conftest import post, user
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (read.add(1), x)[1], "string").asNondeterministic()
    users = spark.createDataFrame([user("a", created="1990-01-01", verified=True, followers=5), user("a", created="1980-01-01"), user("b", created=None), user(None)], USER)
    posts = spark.createDataFrame([post("1", "a", tags=["positive keywords"]), post(None, "a", tags=["positive keywords"]), post("2", "b", tags=["negative emojis"]),
                                   post("3", None, tags=["positive keywords"]), post("4", "c", tags=["positive keywords"]), post("5", "a", tags=None)], POST)
    job = Live(spark, str(tmp_path / "once"), lambda: users.withColumn("created_at", seen("created_at")), FIXTURE_LEXICON, "1995-07-01")
    job.batch(posts, 0)
    assert read.value == 4
    assert {(r.polarity, r.n_posts) for r in job.total("verified").collect()} == {("positive", 2), ("negative", 0)}
    assert job.total("observed").first().n_posts == 6 and [r.data.id for r in job.before("parked", 1).collect()] == ["4"]
    assert {(r.polarity, r.true_mean) for r in job.followers().collect()} == {("positive", 5.0), ("negative", 10.0)}
    assert [r.n_posts for r in job.per_batch("account_age").where("description = 'older accounts, positive'").collect()] == [1]
    assert {(r.polarity, r.post_id) for r in job.per_batch("samples").collect()} == {("positive", "1"), ("positive", None), ("negative", "2")}


def test_one_author_with_a_third_of_the_stream(spark, tmp_path):
    from moodlens.streaming.live import Live
    posts = posts_e(spark, SF_SMALL)
    hot = F.col("data").withField("author_id", F.when(F.col("data.id").cast("long") % 3 == 0, F.lit("1")).otherwise(F.col("data.author_id")))
    posts = posts.withColumn("data", hot)
    job = Live(spark, str(tmp_path / "hot"), lambda: users_e(spark, SF_SMALL), FIXTURE_LEXICON, "1995-07-01")
    job.batch(posts, 0)
    want = {r.polarity: r.n_posts for r in A.verified_counts(posts, users_e(spark, SF_SMALL), dedupe=False).collect()}
    assert {r.polarity: r.n_posts for r in job.total("verified").collect()} == want


def test_files_per_day_are_bounded_by_the_writing_tasks(spark, tmp_path):
    import os
    out = str(tmp_path / "clustered")
    land_posts(posts_e(spark, SF_SMALL).repartition(7), out, fmt="parquet")
    days = [os.path.join(out, d) for d in os.listdir(out) if d.startswith("ingest_date=")]
    assert len(days) >= 28 and all(sum(f.endswith(".parquet") for f in os.listdir(d)) == 1 for d in days)


@pytest.mark.parametrize("name", ["stream_batch_means_all", "stream_account_age_all"])
def test_streams_per_batch_over_all_users(spark, name):
    import duckdb

    from moodlens.streaming.registry import STREAM_ORACLE, STREAM_QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("events", "customer", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got = STREAM_QUERIES[name](spark, sf)
    want = con.sql(STREAM_ORACLE[name])
    of = lambda cols, rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[cols.index(c)] for c in sorted(cols))]) for r in rows)
    rows = of(got.columns, got.collect())
    assert rows and rows == of(want.columns, want.fetchall())
    if name == "stream_account_age_all":
        known = STREAM_QUERIES["stream_account_age"](spark, sf)
        assert got.agg({"n_posts": "sum"}).first()[0] > known.agg({"n_posts": "sum"}).first()[0]
