"""Streaming forms of the analyses.

Two patterns, both checkpointed so a restarted query resumes where it was:

* **state store** - running totals as a streaming aggregate
  (``running_indicator_counts``, ``running_verified_counts``,
  ``running_account_age``, ``observed_posts``), output mode ``complete``
  (a handful of rows);
* **per micro-batch** - the batch analysis applied to each micro-batch in
  ``foreachBatch`` and written by epoch (``sinks.per_batch_writer``): samples,
  account-age shares, and the follower sums behind the mean of batch means.
  Inside ``foreachBatch`` the batch is an ordinary DataFrame, so the
  per-author pre-aggregation and AQE apply there too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlens.functions.polarity import CONTAINS, PREFIX, first_tag, flag, is_negative, is_positive, tag_col
from moodlens.operators.indicators import LOWER_TEXT, _hit, _hits, _unpivot
from moodlens.operators.join import per_author, with_users
from moodlens.plans.analyses import (
    NEWER_NEGATIVE, NEWER_POSITIVE, OLDER_NEGATIVE, OLDER_POSITIVE, _two_way, follower_sums,
)


# ------------------------------------------------------------- state store --
def running_indicator_counts(stream_posts: DataFrame, lexicon) -> DataFrame:
    """Running posts-per-indicator as ONE wide streaming aggregate row."""
    lexicon = list(lexicon)
    base = stream_posts.select(F.lower(F.col("data.text")).alias(LOWER_TEXT))
    return base.agg(*_hits([ind for _, ind, _ in lexicon])).toDF(*[_hit(i) for i in range(len(lexicon))])


def indicator_rows(wide: DataFrame, lexicon) -> DataFrame:
    """Wide running counts -> ``polarity, position, indicator, n_posts``."""
    lexicon = list(lexicon)
    rows = _unpivot(wide, lexicon, {"n_posts": [_hit(i) for i in range(len(lexicon))]})
    return rows.select("polarity", "position", "indicator", F.col("n_posts").cast("long").alias("n_posts"))


def enrich(stream_posts: DataFrame, users_static: DataFrame) -> DataFrame:
    """Stream-static inner join of posts with users (one row per user id).

    ``users_static`` should be a written, deduplicated table (see
    ``snapshot_users``) so each micro-batch reads it instead of recomputing it.
    """
    return stream_posts.join(users_static, stream_posts["data.author_id"] == users_static["id"], "inner")


def running_verified_counts(enriched: DataFrame, match: str = CONTAINS) -> DataFrame:
    """Running posts by verified authors per polarity (wide: ``pos, neg``)."""
    verified = F.coalesce(F.col("verified"), F.lit(False))
    return enriched.agg(F.count_if(is_positive(match) & verified).alias("pos"),
                        F.count_if(is_negative(match) & verified).alias("neg"))


def running_account_age(enriched: DataFrame, cutoff: str, match: str = PREFIX) -> DataFrame:
    """Cumulative account-age counts (wide: ``old_pos, old_neg, new_pos, new_neg``).

    The since-start variant of the per-batch account-age table; feed the
    wide row to ``account_age_rows``.  Posts count by non-NULL post id.
    """
    tag = first_tag()
    has_id = F.col("data.id").isNotNull()
    older = F.col("created_at") < F.lit(cutoff)
    newer = F.col("created_at") > F.lit(cutoff)
    pos, neg = is_positive(match, tag) & has_id, is_negative(match, tag) & has_id
    return enriched.agg(F.count_if(pos & older).alias("old_pos"), F.count_if(neg & older).alias("old_neg"),
                        F.count_if(pos & newer).alias("new_pos"), F.count_if(neg & newer).alias("new_neg"))


def author_windows(stream_posts: DataFrame, at: str, width: str = "1 hour", delay: str = "1 minute", match: str = CONTAINS) -> DataFrame:
    """Posts per author, polarity and window of the time ``at`` (append mode).

    The first of two stateful operators: sums are taken in the map tasks, so an
    author with a third of the stream is one row per task and window in the
    exchange, and one row per window in the state and in what follows.
    """
    flat = stream_posts.withWatermark(at, delay).select(F.col(at).alias("at"), F.col("data.author_id").alias("author_id"),
                                                        flag(is_positive(match)).alias("pos"), flag(is_negative(match)).alias("neg"))
    sums = flat.groupBy(F.window("at", width), "author_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # not before the sums: posts that are filtered out don't move the watermark
    return sums.where(F.col("pos") + F.col("neg") > 0)


def verified_windows(windows: DataFrame, users_static: DataFrame) -> DataFrame:
    """Posts of verified authors per window and polarity (append mode): author
    windows meet the users, not posts; the second stateful operator merges them."""
    known = users_static.where("verified").select("id")
    return (windows.join(known, windows["author_id"] == known["id"])
            .groupBy("window").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .select(F.col("window.start").alias("window_start"), "pos", "neg"))


def join_user_stream(posts: DataFrame, users: DataFrame, at: str, seen: str, wait: str = "1 day", delay: str = "1 minute") -> DataFrame:
    """Posts joined with the rows of a user stream that come within ``wait`` after
    them (append mode): ``post_id, author_id, seen_at, verified, followers``.

    Both streams have a watermark and the condition bounds the time between the
    two, so state ends: a post goes when the users' watermark has passed its
    wait, and one whose author wasn't seen by then comes out with NULLs.
    """
    p = posts.withWatermark(at, delay).select(F.col("data.id").alias("post_id"), F.col("data.author_id").alias("author_id"), F.col(at).alias("_at"))
    u = users.withWatermark(seen, delay).select(F.col("id").alias("_user"), F.col(seen).alias("seen_at"), "verified",
                                                F.col("public_metrics.followers_count").alias("followers"))
    near = F.expr(f"author_id = _user AND seen_at >= _at AND seen_at < _at + INTERVAL {wait}")
    return p.join(u, near, "left_outer").select("post_id", "author_id", "seen_at", "verified", "followers")


def account_age_rows(wide: DataFrame) -> DataFrame:
    """Wide running account-age counts -> ``description, n_posts, percentage``."""
    return _two_way(wide, [(OLDER_POSITIVE, OLDER_NEGATIVE, "old_pos", "old_neg"),
                           (NEWER_POSITIVE, NEWER_NEGATIVE, "new_pos", "new_neg")])


def observed_posts(stream_posts: DataFrame) -> DataFrame:
    """Exact running number of posts seen (the original estimated batches x 80)."""
    return stream_posts.agg(F.count(F.lit(1)).alias("n_posts"))


# ---------------------------------------------------------- per micro-batch --
def batch_follower_sums(users: DataFrame, key: str | None = None, match: str = CONTAINS):
    """Per-batch function: post-weighted follower sums of the micro-batch, or
    per value of ``key`` within it (``ingest_date``: the day is the batch)."""
    def fn(batch: DataFrame) -> DataFrame:
        per = per_author(batch, {"batch": F.col(key)} if key else None,
                         pos=flag(is_positive(match, tag_col())), neg=flag(is_negative(match, tag_col())))
        return follower_sums(with_users(per, users, dedupe=False), ["batch"] if key else [])
    return fn


def followers_from_sums(sums: DataFrame, batch: str = "batch") -> DataFrame:
    """Combine stored follower sums of all epochs; ``batch`` names the column
    that tells batches apart (the epoch, or a key of ``batch_follower_sums``).

    ``true_mean`` = mean over all posts; ``mean_of_means`` = unweighted mean
    of the per-batch means (batches without a polarity skipped);
    ``n_batches`` = batches that had the polarity.
    """
    per_batch = sums.groupBy(batch).agg(*[F.sum(c).alias(c) for c in ("s_pos", "c_pos", "s_neg", "c_neg")])

    def mean(s, c):
        return F.try_divide(F.col(s).cast("double"), F.col(c).cast("double"))

    wide = per_batch.agg(
        F.sum("s_pos").alias("ts_pos"),
        F.sum("c_pos").alias("tc_pos"), F.sum("s_neg").alias("ts_neg"), F.sum("c_neg").alias("tc_neg"),
        F.avg(mean("s_pos", "c_pos")).alias("mm_pos"), F.avg(mean("s_neg", "c_neg")).alias("mm_neg"),
        F.count(mean("s_pos", "c_pos")).alias("nb_pos"), F.count(mean("s_neg", "c_neg")).alias("nb_neg"))
    rows = [F.struct(F.lit(label).alias("polarity"),
                     mean(f"ts_{k}", f"tc_{k}").alias("true_mean"),
                     F.col(f"mm_{k}").alias("mean_of_means"),
                     F.col(f"nb_{k}").alias("n_batches"))
            for label, k in (("positive", "pos"), ("negative", "neg"))]
    return wide.select(F.inline(F.array(*rows)))
