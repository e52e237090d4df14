"""Users as versions: every post sees the user row that was valid at its time.

A table of user snapshots holds a user once per time it was seen.  ``as_of_join``
joins a post with the latest snapshot at or before the post's time.  It never
forms the pairs of a user's posts and versions: time is cut into buckets, and

1. the (author, bucket) pairs that hold posts get the version that was valid
   when the bucket began, by one window over versions and such pairs (a hot
   author is one row per bucket there, not one per post);
2. within a bucket that version and those that start in it make up intervals;
3. posts meet the intervals of their own (author, bucket), of which one holds
   their time.

So the join key of an author with a third of all posts is as many keys as there
are buckets, and what the window sorts grows with versions and buckets alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlens.operators.join import USER_ORDER

SEEN = "seen_at"
BUCKET = "1 day"


def post_time(created_at: str | Column = "data.created_at") -> Column:
    """The post's time (NULL where the text is no time)."""
    return F.try_to_timestamp(F.col(created_at) if isinstance(created_at, str) else created_at)


def user_versions(snapshots: DataFrame) -> DataFrame:
    """``id, since, until, user``: the intervals in which a user's row held.

    Of several rows of one user and time the largest by ``USER_ORDER`` counts; a
    snapshot that changes nothing starts no interval.  ``until`` is NULL for the
    last.  Rows without an id or a time are dropped.
    """
    order = [c for c in USER_ORDER if c in snapshots.columns]
    order += [c for c in snapshots.columns if c not in (*order, "id", SEEN)]
    one = (snapshots.where(F.col("id").isNotNull() & F.col(SEEN).isNotNull())
           .groupBy("id", F.col(SEEN).alias("since")).agg(F.max(F.struct(*order)).alias("user")))
    by_time = Window.partitionBy("id").orderBy("since")
    changed = one.withColumn("before", F.lag("user").over(by_time)).where(~F.col("user").eqNullSafe(F.col("before"))).drop("before")
    return changed.withColumn("until", F.lead("since").over(by_time)).select("id", "since", "until", "user")


def _bucket(at: Column, width: str) -> Column:
    return F.window(at, width)["start"]


def as_of_join(posts: DataFrame, versions: DataFrame, at: Column | None = None, width: str = BUCKET, before: str = "first") -> DataFrame:
    """Every column of ``posts``, ``id`` and the columns of the user valid at the post's time.

    ``versions`` come from :func:`user_versions`.  A post from before its
    author's first version sees that version (``before="first"``, as a user
    looked up after the post would be) or is dropped (``before="drop"``).  Posts
    without a known author or a time are dropped.
    """
    if before not in ("first", "drop"):
        raise ValueError("before must be 'first' or 'drop'")
    timed = posts.withColumn("_at", post_time() if at is None else at).where(F.col("_at").isNotNull() & F.col("data.author_id").isNotNull())
    timed = timed.withColumn("_bucket", _bucket(F.col("_at"), width))
    pairs = timed.select(F.col("data.author_id").alias("id"), "_bucket").distinct()
    user = versions.schema["user"].dataType
    # one row per pair, at the bucket's beginning, and one per version
    marks = (pairs.select("id", "_bucket", F.col("_bucket").alias("since"), F.lit(True).alias("has_posts"), F.lit(None).cast(user).alias("user"))
             .unionByName(versions.select("id", _bucket(F.col("since"), width).alias("_bucket"), "since", F.lit(None).cast("boolean").alias("has_posts"), "user")))
    line = Window.partitionBy("id").orderBy("since", F.col("has_posts").asc_nulls_first())
    valid = F.last("user", ignorenulls=True).over(line)
    if before == "first":
        valid = F.coalesce(valid, F.first("user", ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    own = Window.partitionBy("id", "_bucket")
    intervals = (marks.withColumn("valid", valid).withColumn("in_use", F.max("has_posts").over(own))
                 .withColumn("until", F.lead("since").over(own.orderBy("since", F.col("has_posts").asc_nulls_first())))
                 .where(F.col("in_use") & F.col("valid").isNotNull() & (F.col("until").isNull() | (F.col("since") < F.col("until"))))
                 .select("id", F.col("_bucket").alias("_start"), "since", "until", "valid"))
    held = ((F.col("data.author_id") == F.col("id")) & (F.col("_bucket") == F.col("_start")) & (F.col("_at") >= F.col("since"))
            & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    return timed.join(intervals, held).select(*posts.columns, "id", "valid.*")
