"""Registered streaming queries.

Each one lands fixture posts as files (partitioned by ingest day), runs a
Structured Streaming query over the landing folder with an ``availableNow``
trigger, and returns the result table as a DataFrame.  Micro-batches are bounded
by bytes (``spark.moodlens.maxBytesPerTrigger``).  Queries whose rows tell
micro-batches apart land the posts in slices of the month and run once after
each on one checkpoint: one micro-batch per slice, however many files it has.
All paths live below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.plans import analyses as A
from moodlens.plans.oracle_sql import oracle_sql as _batch_oracle, PE, UE
from moodlens.functions.polarity import first_tag, no_rules
from moodlens.operators.indicators import indicator_counts
from moodlens.operators.join import join_users
from moodlens.operators.topk import merge_states, sample_state, samples
from moodlens.lexicons import RULE_EXCLUDE, Rule, RuleSet, default_rules
from moodlens.operators.rules import rules_frame
from moodlens.plans.registry import FIXTURE_LEXICON, branch_posts, _flat_posts, _tables, event_lexicon, posts_e, users_e
from moodlens.session import configured, scratch_path
from moodlens.sources.files import land_posts, read_posts
from moodlens.sources import fixtures as X
from moodlens.sources.fixtures import FIXTURE_E_CUTOFF
from moodlens.streaming import analyses as S
from moodlens.streaming.sinks import (
    EPOCH, land_stream, latest_epoch, per_batch_writer, run_available, write_latest,
)
from moodlens.streaming.event_time import EventTimeWindows
from moodlens.streaming.live import Live
from moodlens.streaming.parked import ARRIVED, EXPIRED, GRANULES, JOINED, STATE_STORE, join_arriving
from moodlens.streaming.rule_log import RuleLog
from moodlens.streaming.sources import BYTES_PER_TRIGGER, drop_snapshot, file_stream, post_stream, snapshot_users

#: Days of the month in a slice.
SLICE_DAYS = 8
HOT_AUTHOR = "1"
#: The third slice comes before the second.
OUT_OF_ORDER = (0, 2, 1, 3)
#: When the two halves of the users arrive: with the first slice and the third.
DELIVERIES = ("2024-01-01 00:00:00", "2024-01-17 00:00:00")


def _stream(spark: SparkSession, landing: str, fmt: str = "parquet") -> DataFrame:
    return post_stream(spark, landing, fmt=fmt, max_bytes_per_trigger=int(spark.conf.get("spark.moodlens.maxBytesPerTrigger", str(BYTES_PER_TRIGGER))))


def _landed(spark: SparkSession, posts: DataFrame, name: str) -> str:
    path = scratch_path(spark, f"{name}-landing")
    land_posts(posts, path, fmt="parquet")
    return path


def _known(spark, sf_dir) -> DataFrame:
    """Half of the users: posts of the others have an unknown author."""
    return users_e(spark, sf_dir).where(F.col("id").cast("long") % 2 == 0)


def _by_slice(spark, sf_dir, name, foreach_batch, before=None, posts=None, order=range(-(-31 // SLICE_DAYS))) -> None:
    """Lands fixture E (or other posts) slice by slice and runs the stream after
    each.  ``before(k)`` is called ahead of slice ``k``."""
    posts = posts_e(spark, sf_dir) if posts is None else posts
    day = F.substring("data.created_at", 9, 2).cast("int")
    landing, ckpt = scratch_path(spark, f"{name}-landing"), scratch_path(spark, f"{name}-ckpt")
    for k in order:
        if before:
            before(k)
        land_posts(posts.where(F.floor((day - 1) / SLICE_DAYS) == k), landing, fmt="parquet")
        run_available(post_stream(spark, landing), ckpt, foreach_batch=foreach_batch)


def _sliced(spark, sf_dir, fn, name) -> DataFrame:
    """Results of ``fn`` for every slice, with the micro-batch as ``batch_id``."""
    out = scratch_path(spark, f"{name}-out")
    _by_slice(spark, sf_dir, name, per_batch_writer(fn, out))
    return spark.read.parquet(out).withColumn("batch_id", F.col(EPOCH).cast("long")).drop(EPOCH)


def _complete_to_table(spark, stream_df, name) -> str:
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    run_available(stream_df, ckpt, output_mode="complete",
                  foreach_batch=lambda df, epoch: write_latest(df, out, epoch))
    return out


def _per_batch_to_table(spark, stream_df, fn, name) -> str:
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    run_available(stream_df, ckpt, output_mode="append", foreach_batch=per_batch_writer(fn, out))
    return out


def q_stream_indicator_counts(spark, sf_dir):
    """Running indicator counts over landed documents (state store)."""
    landing = _landed(spark, X.posts_from_documents(_tables(spark, sf_dir, "documents")["documents"]), "indicators")
    stream = _stream(spark, landing)
    out = _complete_to_table(spark, S.running_indicator_counts(stream, FIXTURE_LEXICON), "indicators")
    return S.indicator_rows(latest_epoch(spark, out), FIXTURE_LEXICON)


def q_stream_verified_counts(spark, sf_dir):
    """T3 + T7: stream-static join with users, running verified counts."""
    users = snapshot_users(spark, users_e(spark, sf_dir), "verified")
    landing = _landed(spark, posts_e(spark, sf_dir), "verified")
    stream = _stream(spark, landing)
    out = _complete_to_table(spark, S.running_verified_counts(S.enrich(stream, users)), "verified")
    drop_snapshot(spark, users)
    wide = latest_epoch(spark, out)
    return wide.select(F.inline(F.array(
        F.struct(F.lit("positive").alias("polarity"), F.col("pos").alias("n_posts")),
        F.struct(F.lit("negative").alias("polarity"), F.col("neg").alias("n_posts")))))


def hot_author(posts: DataFrame) -> DataFrame:
    """Every third post goes to one author."""
    third = F.col("data.id").cast("long") % 3 == 0
    return posts.withColumn("data", F.col("data").withField("author_id", F.when(third, F.lit(HOT_AUTHOR)).otherwise(F.col("data.author_id"))))


def q_stream_verified_windows(spark, sf_dir):
    """Posts of verified authors per hour, one author holding a third of the
    stream.  A last row, of an author that no user is, closes the windows."""
    users = snapshot_users(spark, users_e(spark, sf_dir), "windows")
    posts = hot_author(_tables(spark, sf_dir, "events")["events"].select(*X.event_post_columns(), F.col("ts").cast("timestamp").alias(ARRIVED)))
    landing, ckpt, out = (scratch_path(spark, f"windows-{n}") for n in ("landing", "ckpt", "out"))
    none = F.lit(None).cast("string")
    end = posts.agg(F.max(ARRIVED).alias("last")).select(
        *X.post_columns(none, F.lit(""), none, none, none, no_rules()), (F.col("last") + F.expr("INTERVAL 1 DAY")).alias(ARRIVED))
    first = F.dayofmonth(ARRIVED) <= 15
    for part in (posts.where(first), posts.where(~first), end):
        part.write.mode("append").parquet(landing)
        stream = file_stream(spark, landing, posts.schema)
        run_available(S.verified_windows(S.author_windows(stream, ARRIVED), users), ckpt, sink_path=out)
    drop_snapshot(spark, users)
    return (spark.read.schema("window_start timestamp, pos bigint, neg bigint").parquet(out)
            .select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "pos", "neg"))


def q_stream_account_age_running(spark, sf_dir):
    """T6, cumulative variant: account-age shares since the start of the stream."""
    users = snapshot_users(spark, users_e(spark, sf_dir), "age_running")
    landing = _landed(spark, posts_e(spark, sf_dir), "age_running")
    stream = _stream(spark, landing)
    wide = S.running_account_age(S.enrich(stream, users), FIXTURE_E_CUTOFF)
    out = _complete_to_table(spark, wide, "age_running")
    drop_snapshot(spark, users)
    return S.account_age_rows(latest_epoch(spark, out))


def q_stream_observed(spark, sf_dir):
    """Exact running count of observed posts."""
    landing = _landed(spark, posts_e(spark, sf_dir), "observed")
    stream = _stream(spark, landing)
    out = _complete_to_table(spark, S.observed_posts(stream), "observed")
    return latest_epoch(spark, out)


def _rounded(means: DataFrame) -> DataFrame:
    return means.withColumn("mean_of_means", F.round("mean_of_means", 6))  # for the comparison alone


def q_stream_followers(spark, sf_dir):
    """T4: follower means; batches are ingest days, sums stored per epoch."""
    users = snapshot_users(spark, users_e(spark, sf_dir), "followers")
    landing = _landed(spark, posts_e(spark, sf_dir), "followers")
    out = _per_batch_to_table(spark, _stream(spark, landing), S.batch_follower_sums(users, "ingest_date"), "followers")
    drop_snapshot(spark, users)
    return _rounded(S.followers_from_sums(spark.read.parquet(out).drop(EPOCH)))


def q_stream_batch_means(spark, sf_dir):
    """T4: mean of the means of the micro-batches, users leaving authors out."""
    sums = _sliced(spark, sf_dir, S.batch_follower_sums(_known(spark, sf_dir)), "means")
    return _rounded(S.followers_from_sums(sums, "batch_id"))


def q_stream_batch_means_all(spark, sf_dir):
    """T4: mean of the means of the micro-batches, over all users."""
    sums = _sliced(spark, sf_dir, S.batch_follower_sums(users_e(spark, sf_dir)), "means-all")
    return _rounded(S.followers_from_sums(sums, "batch_id"))


def q_stream_batch_samples(spark, sf_dir):
    """T5: five posts of known authors per polarity from every micro-batch."""
    users = _known(spark, sf_dir)
    found = _sliced(spark, sf_dir, lambda b: A.sample_posts(join_users(b, users, dedupe=False)), "samples")
    return found.select("batch_id", "polarity", "post_id", "text")


def q_stream_batch_samples_all(spark, sf_dir):
    """T5: five posts per polarity from every micro-batch, over all users."""
    users = users_e(spark, sf_dir)
    found = _sliced(spark, sf_dir, lambda b: A.sample_posts(join_users(b, users, dedupe=False)), "samples-all")
    return found.select("batch_id", "polarity", "post_id", "text")


def q_stream_running_samples(spark, sf_dir):
    """O2 + T5: the last five posts of each polarity so far, kept as a merged state."""
    out = scratch_path(spark, "running-samples")

    def batch(posts: DataFrame, epoch: int) -> None:
        before = spark.read.parquet(out).where(F.col(EPOCH) == epoch - 1) if epoch else None
        write_latest(merge_states(sample_state(posts, latest=True), before, latest=True), out, epoch)

    _by_slice(spark, sf_dir, "running-samples", batch)
    return samples(latest_epoch(spark, out))


def q_stream_event_time(spark, sf_dir):
    """A2-A3 in event time: slices come out of order, and what is more than ten
    days behind is late.  ``kind, window_start, count_pos, count_neg``."""
    job = EventTimeWindows(spark, scratch_path(spark, "event-time"), delay="10 days")
    _by_slice(spark, sf_dir, "event-time", job.batch, order=OUT_OF_ORDER)
    late = job.late().select("window_start", first_tag().alias("tag")).groupBy("window_start").agg(
        F.count_if(F.col("tag").contains("positive")).alias("count_pos"), F.count_if(F.col("tag").contains("negative")).alias("count_neg"))
    kinds = [("closed", job.closed()), ("open", job.open()), ("late", late)]
    rows = [df.select(F.lit(k).alias("kind"), F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "count_pos", "count_neg") for k, df in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def q_stream_rule_changes(spark, sf_dir):
    """R4 + T1: rule 2 goes with the second slice, a rule for gloves comes with the third."""
    log, out = RuleLog(spark, scratch_path(spark, "rule-log")), scratch_path(spark, "rule-changes")
    log.add(rules_frame(spark, default_rules()), 0)

    def before(k: int) -> None:
        if k == 1:
            log.delete(spark.createDataFrame([("2",)], "rule_id string"), 1)
        if k == 2:
            log.add(rules_frame(spark, RuleSet((Rule("5", "positive keywords", ("gloves",), "keyword", exclude=RULE_EXCLUDE),))), 2)

    _by_slice(spark, sf_dir, "rule-changes", log.tagger(out), before, branch_posts(spark, sf_dir))
    tagged = spark.read.parquet(out).where(F.size("matching_rules") > 0)
    return tagged.select(F.col(EPOCH).cast("long").alias("batch_id"), F.col("data.id").alias("post_id"), F.size("matching_rules").alias("n_rules"), first_tag().alias("first_tag"))


def q_stream_user_stream(spark, sf_dir):
    """Posts joined with a stream of user rows that come within two days after
    them; a post whose author isn't seen by then comes with NULLs."""
    t = _tables(spark, sf_dir, "events", "orders")
    posts = t["events"].select(*X.event_post_columns(), F.col("ts").cast("timestamp").alias(ARRIVED))
    users = X.user_snapshots_from_orders(t["orders"])
    end = F.lit("2024-03-01").cast("timestamp")  # last rows of nobody: both watermarks pass every wait
    none = F.lit(None).cast("string")
    last_post = spark.range(1).select(*X.post_columns(none, F.lit("nobody"), none, none, none, no_rules()), end.alias(ARRIVED))
    last_user = spark.range(1).select(F.lit("no one").alias("id"), end.alias("seen_at"), none.alias("created_at"), F.lit(None).cast("boolean").alias("verified"),
                                      F.lit(None).cast(users.schema["public_metrics"].dataType).alias("public_metrics"))
    folder = {n: scratch_path(spark, f"two-streams-{n}") for n in ("posts", "users", "ckpt", "out")}
    half = F.lit("2024-01-16").cast("timestamp")
    parts = [(posts.where(F.col(ARRIVED) < half), users.where(F.col("seen_at") < half)), (posts.where(F.col(ARRIVED) >= half), users.where(F.col("seen_at") >= half)), (last_post, last_user)]
    for p, u in parts:
        p.write.mode("append").parquet(folder["posts"])
        u.write.mode("append").parquet(folder["users"])
        streams = file_stream(spark, folder["posts"], posts.schema), file_stream(spark, folder["users"], users.schema)
        run_available(S.join_user_stream(*streams, ARRIVED, "seen_at", wait="2 days"), folder["ckpt"], sink_path=folder["out"])
    found = spark.read.schema("post_id string, author_id string, seen_at timestamp, verified boolean, followers bigint").parquet(folder["out"])
    return found.where(F.col("post_id").isNotNull()).withColumn("seen_at", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"))


def q_stream_account_age(spark, sf_dir):
    """Account-age shares per micro-batch (not accumulated)."""
    users = _known(spark, sf_dir)
    found = _sliced(spark, sf_dir, lambda b: A.account_age_split(b, users, cutoff=FIXTURE_E_CUTOFF, dedupe=False), "age")
    return found.select("batch_id", "description", "n_posts", "percentage")


def q_stream_account_age_all(spark, sf_dir):
    """Account-age shares per micro-batch, over all users."""
    users = users_e(spark, sf_dir)
    found = _sliced(spark, sf_dir, lambda b: A.account_age_split(b, users, cutoff=FIXTURE_E_CUTOFF, dedupe=False), "age-all")
    return found.select("batch_id", "description", "n_posts", "percentage")


def q_stream_joined_indicators(spark, sf_dir):
    """Running indicator counts over the posts of known authors."""
    users = _known(spark, sf_dir)
    found = _sliced(spark, sf_dir, lambda b: indicator_counts(b, event_lexicon(), users=users), "joined")
    return found.groupBy("polarity", "position", "indicator").agg(F.sum("n_posts").alias("n_posts"))


def q_stream_joined_indicators_all(spark, sf_dir):
    """Running indicator counts over posts of all users."""
    users = users_e(spark, sf_dir)
    found = _sliced(spark, sf_dir, lambda b: indicator_counts(b, event_lexicon(), users=users), "joined-all")
    return found.groupBy("polarity", "position", "indicator").agg(F.sum("n_posts").alias("n_posts"))


def q_stream_late_users(spark, sf_dir):
    """T7 + S10: half of the users arrive after two slices; their posts were
    parked and are counted then."""
    users, folder = users_e(spark, sf_dir), scratch_path(spark, "late-users")
    late = F.col("id").cast("long") % 2 == 1

    def before(k: int) -> None:
        if k in (0, 2):
            users.where(late if k else ~late).write.mode("append").parquet(folder)

    job = Live(spark, scratch_path(spark, "late-out"), lambda: spark.read.parquet(folder), event_lexicon(), FIXTURE_E_CUTOFF)
    _by_slice(spark, sf_dir, "late", job.batch, before)
    return job.total("verified")


def _arriving(spark, sf_dir, name: str, foreach_batch, expiry: str) -> None:
    """Posts of fixture E and two deliveries of users (half of them with the
    first slice, half with the third) as streams with times of arrival."""
    posts = _tables(spark, sf_dir, "events")["events"].select(*X.event_post_columns(), F.col("ts").cast("timestamp").alias(ARRIVED))
    users, odd = users_e(spark, sf_dir), F.col("id").cast("long") % 2 == 1
    first, late = (F.lit(t).cast("timestamp") for t in DELIVERIES)
    folder = {n: scratch_path(spark, f"{name}-{n}") for n in ("posts", "users", "ckpt")}
    slice_ = F.floor((F.dayofmonth(ARRIVED) - 1) / SLICE_DAYS)
    with configured(spark, STATE_STORE):
        for k in range(-(-31 // SLICE_DAYS)):
            if k in (0, 2):
                users.where(odd if k else ~odd).withColumn(ARRIVED, late if k else first).write.mode("append").parquet(folder["users"])
            posts.where(slice_ == k).write.mode("append").parquet(folder["posts"])
            streams = [file_stream(spark, folder[n], s) for n, s in (("posts", posts.schema), ("users", users.withColumn(ARRIVED, first).schema))]
            run_available(join_arriving(*streams, expiry=expiry), folder["ckpt"], foreach_batch=foreach_batch)


def q_stream_parked_posts(spark, sf_dir):
    """T7 + S10: posts wait in keyed state; what waits longer than 12 days is let go.
    ``status, polarity, n_posts``: verified accounts' posts, and expired posts."""
    out = scratch_path(spark, "parked-out")
    _arriving(spark, sf_dir, "parked", per_batch_writer(lambda rows: rows, out), "12 days")
    rows = spark.read.parquet(out).withColumn("tag", first_tag())
    verified = (F.col("status") == JOINED) & F.col("verified")
    counts = [("verified", p, F.count_if(verified & F.col("tag").contains(p))) for p in ("positive", "negative")]
    counts += [("expired", p, F.count_if((F.col("status") == EXPIRED) & F.col("tag").contains(p))) for p in ("positive", "negative")]
    arrived = F.sum(F.when((F.col("status") != EXPIRED) & ~F.col("waited"), F.col("n_posts")).otherwise(0))
    wide = rows.agg(*[c.alias(f"{s}_{p}") for s, p, c in counts], arrived.alias("observed"))
    return wide.select(F.inline(F.array(
        *[F.struct(F.lit(s).alias("status"), F.lit(p).alias("polarity"), F.col(f"{s}_{p}").alias("n_posts")) for s, p, _ in counts],
        F.struct(F.lit("observed").alias("status"), F.lit(None).cast("string").alias("polarity"), F.col("observed").alias("n_posts")))))


def q_stream_landing(spark, sf_dir):
    """S3 + S7: JSON post files read as a stream, landed as Parquet by day
    (file sink, exactly-once), read back as an archive."""
    raw = scratch_path(spark, "raw-json")
    land_posts(posts_e(spark, sf_dir), raw, fmt="json")
    out, ckpt = scratch_path(spark, "landed"), scratch_path(spark, "landed-ckpt")
    q = land_stream(_stream(spark, raw, fmt="json"), out, ckpt,
                    trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"landing stream failed: {q.exception()}")
    return _flat_posts(read_posts(spark, out, fmt="parquet"))


STREAM_QUERIES = {
    "stream_landing": q_stream_landing,
    "stream_indicator_counts": q_stream_indicator_counts,
    "stream_verified_counts": q_stream_verified_counts,
    "stream_verified_windows": q_stream_verified_windows,
    "stream_observed": q_stream_observed,
    "stream_followers": q_stream_followers,
    "stream_batch_means": q_stream_batch_means,
    "stream_batch_means_all": q_stream_batch_means_all,
    "stream_batch_samples": q_stream_batch_samples,
    "stream_batch_samples_all": q_stream_batch_samples_all,
    "stream_running_samples": q_stream_running_samples,
    "stream_event_time": q_stream_event_time,
    "stream_rule_changes": q_stream_rule_changes,
    "stream_user_stream": q_stream_user_stream,
    "stream_joined_indicators": q_stream_joined_indicators,
    "stream_joined_indicators_all": q_stream_joined_indicators_all,
    "stream_late_users": q_stream_late_users,
    "stream_parked_posts": q_stream_parked_posts,
    "stream_account_age": q_stream_account_age,
    "stream_account_age_all": q_stream_account_age_all,
    "stream_account_age_running": q_stream_account_age_running,
}

_HALF = (f"WITH {PE}, {UE}, j AS (SELECT pe.*, ue.followers, ue.created_at AS user_created_at, "
         f"CAST(floor((CAST(substr(pe.created_at, 9, 2) AS INTEGER) - 1) / {SLICE_DAYS}) AS BIGINT) AS slice "
         "FROM pe JOIN ue ON ue.id = pe.author_id AND CAST(ue.id AS BIGINT) % 2 = 0), "
         "b AS (SELECT slice, dense_rank() OVER (ORDER BY slice) - 1 AS batch_id FROM j GROUP BY slice)")

_ALL = _HALF.replace(" AND CAST(ue.id AS BIGINT) % 2 = 0", "")


def _age_rows() -> str:
    count = lambda tag, op: f"count(post_id) FILTER (WHERE tag LIKE '{tag}%' AND user_created_at {op} '{FIXTURE_E_CUTOFF}')"
    rows = []
    for age, op in (("older", "<"), ("newer", ">")):
        for tag, other in (("positive", "negative"), ("negative", "positive")):
            rows.append(f"SELECT batch_id, '{age} accounts, {tag}' AS description, {count(tag, op)} AS n_posts, "
                        f"{count(tag, op)} / NULLIF({count(tag, op)} + {count(other, op)}, 0) * 100 AS percentage "
                        "FROM j JOIN b USING (slice) GROUP BY batch_id")
    return " UNION ALL ".join(rows)


def _means(table: str, key: str) -> str:
    """True mean, and mean of the means per ``key``, of both polarities."""
    rows = []
    for tag in ("positive", "negative"):
        mean = f"avg(followers) FILTER (WHERE tag LIKE '%{tag}%')"
        rows.append(f"SELECT '{tag}' AS polarity, (SELECT {mean} FROM {table}) AS true_mean, round(avg(m), 6) AS mean_of_means, "
                    f"count(m) AS n_batches FROM (SELECT {mean} AS m FROM {table} GROUP BY {key})")
    return " UNION ALL ".join(rows)


_LEXICON_E = ", ".join("({}, '{}', '{}')".format(*row) for row in event_lexicon())

_SAMPLES = ("p AS (SELECT 'positive' AS polarity, * FROM j WHERE tag LIKE '%positive%' "
            "UNION ALL SELECT 'negative', * FROM j WHERE tag LIKE '%negative%'), "
            "r AS (SELECT *, row_number() OVER (PARTITION BY slice, polarity ORDER BY created_at, post_id) AS n FROM p) "
            "SELECT batch_id, polarity, post_id, text FROM r JOIN b USING (slice) WHERE n <= 5")
_INDICATORS = (f"lex(position, indicator, polarity) AS (VALUES {_LEXICON_E}) "
               "SELECT l.polarity, l.position, l.indicator, count(j.post_id) AS n_posts "
               "FROM lex l LEFT JOIN j ON contains(lower(j.text), l.indicator) GROUP BY l.polarity, l.position, l.indicator")

_DAY_MS = 86_400_000

_TURN = f"array_position([{', '.join(map(str, OUT_OF_ORDER))}], CAST(floor((day(ts) - 1) / {SLICE_DAYS}) AS INTEGER))"
_EVENT_TIME = (
    f"WITH {PE}, p AS (SELECT pe.tag, e.ts, date_trunc('hour', e.ts) AS w, {_TURN} AS turn FROM pe JOIN events e ON CAST(e.event_id AS VARCHAR) = pe.post_id), "
    # posts carry milliseconds
    "q AS (SELECT *, (SELECT max(date_trunc('millisecond', ts)) FROM p x WHERE x.turn < p.turn) - INTERVAL 10 DAY AS mark FROM p), "
    "r AS (SELECT *, coalesce(w + INTERVAL 1 HOUR <= mark, false) AS late, (SELECT max(date_trunc('millisecond', ts)) FROM p) - INTERVAL 10 DAY AS last FROM q) "
    "SELECT CASE WHEN late THEN 'late' WHEN w + INTERVAL 1 HOUR <= last THEN 'closed' ELSE 'open' END AS kind, strftime(w, '%Y-%m-%d %H:%M') AS window_start, "
    "count(*) FILTER (WHERE tag LIKE '%positive%') AS count_pos, count(*) FILTER (WHERE tag LIKE '%negative%') AS count_neg FROM r GROUP BY kind, w")


def _rule_changes() -> str:
    """The branches' rules by slice: the default ones, without rule 2, with gloves."""
    first = {"purchase": (2, "positive keywords"), "error": (2, "positive emojis"), "click": (1, "positive keywords"), "low": (1, "negative emojis")}
    second = {**first, "purchase": (1, "positive keywords"), "error": (1, "negative keywords")}
    third = {**second, "low": (2, "negative emojis")}
    values = ", ".join(f"({k}, '{kind}', {n}, '{tag}')" for k, found in enumerate((first, second, third, third)) for kind, (n, tag) in found.items())
    return (f"WITH f(batch_id, kind, n_rules, first_tag) AS (VALUES {values}), e AS (SELECT event_id, user_id, CAST(floor((day(ts) - 1) / {SLICE_DAYS}) AS INTEGER) AS batch_id, "
            "CASE WHEN event_type = 'view' AND value < 20 THEN 'low' WHEN event_type <> 'view' THEN event_type END AS kind FROM events) "
            "SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(event_id AS VARCHAR) AS post_id, n_rules, first_tag FROM e JOIN f USING (batch_id, kind) WHERE user_id % 5 <> 0")


STREAM_ORACLE = {
    "stream_event_time": _EVENT_TIME,
    "stream_rule_changes": _rule_changes(),
    "stream_user_stream": (
        "WITH u AS (SELECT CAST(o_custkey AS VARCHAR) AS id, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') "
        "+ (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) // 80) AS seen_at, o_orderpriority < '3' AS verified, CAST(floor(o_totalprice) AS BIGINT) AS followers FROM orders) "
        "SELECT CAST(event_id AS VARCHAR) AS post_id, CAST(user_id AS VARCHAR) AS author_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at, verified, followers "
        "FROM events LEFT JOIN u ON CAST(user_id AS VARCHAR) = u.id AND seen_at >= ts AND seen_at < ts + INTERVAL 2 DAY"),
    "stream_landing": _batch_oracle()["landing_roundtrip"],
    "stream_indicator_counts": _batch_oracle()["indicator_counts"],
    "stream_verified_counts": _batch_oracle()["verified_counts"],
    "stream_late_users": _batch_oracle()["verified_counts"],
    # 12 days in sixteenths; the second delivery comes when the watermark is a minute before the last post of slice 1
    "stream_parked_posts": (
        f"WITH {PE}, {UE}, p AS (SELECT pe.*, e.ts, ue.id, ue.verified, CAST(e.user_id AS BIGINT) % 2 = 1 AS late, "
        f"(SELECT max(ts) FROM events WHERE day(ts) <= {2 * SLICE_DAYS}) - INTERVAL 1 MINUTE AS mark, "
        f"(SELECT max(ts) FROM events) - INTERVAL 1 MINUTE AS last, "
        f"make_timestamp(CAST(ceil((epoch_ms(e.ts) + {12 * _DAY_MS}) / {12 * _DAY_MS // GRANULES}.0) AS BIGINT) * {12 * _DAY_MS // GRANULES} * 1000) AS until "
        "FROM pe JOIN events e ON CAST(e.event_id AS VARCHAR) = pe.post_id LEFT JOIN ue ON ue.id = pe.author_id WHERE pe.author_id IS NOT NULL), "
        "r AS (SELECT *, CASE WHEN id IS NULL AND until < last OR late AND until < mark THEN 'expired' "
        "WHEN id IS NOT NULL THEN 'joined' ELSE 'waiting' END AS status FROM p) "
        + " UNION ALL ".join(
            f"SELECT 'verified' AS status, '{tag}' AS polarity, count(*) FILTER (WHERE tag LIKE '%{tag}%' AND verified AND status = 'joined') AS n_posts FROM r "
            f"UNION ALL SELECT 'expired', '{tag}', count(*) FILTER (WHERE tag LIKE '%{tag}%' AND status = 'expired') FROM r" for tag in ("positive", "negative"))
        + " UNION ALL SELECT 'observed', NULL, count(*) FROM r"),
    "stream_verified_windows": (
        f"WITH {PE}, {UE}, p AS (SELECT pe.*, e.ts, CASE WHEN e.event_id % 3 = 0 THEN '{HOT_AUTHOR}' ELSE pe.author_id END AS author "
        "FROM pe JOIN events e ON CAST(e.event_id AS VARCHAR) = pe.post_id) "
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) FILTER (WHERE tag LIKE '%positive%') AS pos, "
        "count(*) FILTER (WHERE tag LIKE '%negative%') AS neg FROM p JOIN ue ON ue.id = p.author AND ue.verified "
        "WHERE tag LIKE '%positive%' OR tag LIKE '%negative%' GROUP BY 1"),
    "stream_observed": "SELECT count(*) AS n_posts FROM events",
    "stream_account_age_running": _batch_oracle()["account_age_split"],
    "stream_followers": (f"WITH {PE}, {UE}, j AS (SELECT pe.*, ue.followers FROM pe JOIN ue ON ue.id = pe.author_id) "
                         + _means("j", "substr(created_at, 1, 10)")),
    "stream_batch_means": f"{_HALF} " + _means("j", "slice"),
    "stream_batch_samples": f"{_HALF}, " + _SAMPLES,
    "stream_batch_samples_all": f"{_ALL}, " + _SAMPLES,
    "stream_running_samples": (
        f"WITH {PE} (SELECT 'positive' AS polarity, post_id, text FROM pe WHERE tag LIKE '%positive%' ORDER BY created_at DESC, post_id DESC LIMIT 5) "
        "UNION ALL (SELECT 'negative', post_id, text FROM pe WHERE tag LIKE '%negative%' ORDER BY created_at DESC, post_id DESC LIMIT 5)"),
    "stream_account_age": f"{_HALF} " + _age_rows(),
    "stream_batch_means_all": f"{_ALL} " + _means("j", "slice"),
    "stream_account_age_all": f"{_ALL} " + _age_rows(),
    "stream_joined_indicators": f"{_HALF}, " + _INDICATORS,
    "stream_joined_indicators_all": f"{_ALL}, " + _INDICATORS,
}
