"""The six questions, each one declarative plan.

Conventions shared by all functions:

* ``posts`` has the POST shape (``data`` struct + ``matching_rules``);
  ``users`` the USER shape.  Nothing is collected to the driver.
* polarity comes from the first rule's tag; ``match`` picks substring
  (``contains``) or prefix matching, defaulting to what the original used
  for that question.
* shares are fractions (hourly table) or percentages 0..100 (split tables),
  always DOUBLE, NULL instead of a division by zero.
* every analysis over posts ⋈ users pre-aggregates per author before the
  join (see ``operators/join.py``); users are deduplicated first unless
  ``dedupe=False`` says they already are (e.g. a written user snapshot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlens.functions.polarity import (
    CONTAINS, PREFIX, TAG, first_tag, flag, hour_utc, is_negative, is_positive, tag_col,
)
from moodlens.operators.join import per_author, user_columns, with_users

# Result labels of the two split tables.
OLDER_POSITIVE = "older accounts, positive"
OLDER_NEGATIVE = "older accounts, negative"
NEWER_POSITIVE = "newer accounts, positive"
NEWER_NEGATIVE = "newer accounts, negative"
ACTIVE_POSITIVE = "active authors, positive"
ACTIVE_NEGATIVE = "active authors, negative"
LESS_ACTIVE_POSITIVE = "less active authors, positive"
LESS_ACTIVE_NEGATIVE = "less active authors, negative"
# ---- FIXED VALUES -----------------------------------------------------------
# Account age cut-off of the original (string comparison, both sides strict).
ACCOUNT_AGE_CUTOFF = "2019-01-01"
# Separator between sampled texts in the display string.
SAMPLE_SEPARATOR = "\nTWEET:"
# ---- end of fixed values ----------------------------------------------------


def _share(part: Column, other: Column, scale: float | None = None) -> Column:
    share = F.try_divide(part.cast("double"), (part + other).cast("double"))
    return share * F.lit(scale) if scale is not None else share


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def _two_way(wide: DataFrame, groups: list[tuple[str, str, str, str]]) -> DataFrame:
    """Wide counts -> ``(description, n_posts, percentage)`` rows.

    ``groups`` holds (positive label, negative label, positive col, negative
    col); the percentage is within the pair.
    """
    rows = []
    for pos_label, neg_label, pos_col, neg_col in groups:
        p, n = F.col(pos_col), F.col(neg_col)
        rows.append(F.struct(F.lit(pos_label).alias("description"), p.alias("n_posts"),
                             _share(p, n, 100.0).alias("percentage")))
        rows.append(F.struct(F.lit(neg_label).alias("description"), n.alias("n_posts"),
                             _share(n, p, 100.0).alias("percentage")))
    return wide.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- Q2 ------
def polarity_totals(posts: DataFrame, match: str = CONTAINS) -> DataFrame:
    """Number of positive and of negative posts: ``polarity, n_posts``."""
    tags = posts.select(first_tag().alias(TAG))
    wide = tags.agg(F.count_if(is_positive(match, tag_col())).alias("p"),
                    F.count_if(is_negative(match, tag_col())).alias("n"))
    return wide.select(F.inline(F.array(
        F.struct(F.lit("positive").alias("polarity"), F.col("p").alias("n_posts")),
        F.struct(F.lit("negative").alias("polarity"), F.col("n").alias("n_posts")))))


def hourly_polarity(posts: DataFrame, match: str = CONTAINS, keep_partial_hours: bool = False) -> DataFrame:
    """Posts per UTC hour of day by polarity, with the shares of each.

    One scan and one ``groupBy(hour)`` with two conditional counts (the
    original joined two hourly tables).  Hours lacking one polarity (or with
    no parsable hour) are dropped unless ``keep_partial_hours``.
    Output: ``hour_utc, count_pos, count_neg, pct_pos, pct_neg`` (fractions).
    """
    pos, neg = is_positive(match, tag_col()), is_negative(match, tag_col())
    # No filter before the aggregate: untagged posts only add zeros to the
    # partial counts, and a filter here would be pushed below the post
    # projection and evaluate the tag expression twice.
    hourly = (posts.select(hour_utc().alias("hour_utc"), first_tag().alias(TAG))
                   .select("hour_utc", pos.alias("_p"), neg.alias("_n"))
                   .groupBy("hour_utc")
                   .agg(F.count_if("_p").alias("count_pos"), F.count_if("_n").alias("count_neg")))
    if keep_partial_hours:
        hourly = hourly.where((F.col("count_pos") > 0) | (F.col("count_neg") > 0))
    else:
        hourly = hourly.where(F.col("hour_utc").isNotNull() & (F.col("count_pos") > 0) & (F.col("count_neg") > 0))
    cp, cn = F.col("count_pos"), F.col("count_neg")
    return (hourly.select("hour_utc", "count_pos", "count_neg",
                          _share(cp, cn).alias("pct_pos"), _share(cn, cp).alias("pct_neg"))
                  .repartition(1).sortWithinPartitions("hour_utc"))  # at most 25 rows


# ---------------------------------------------------------------- Q1 ------
def sample_posts(posts: DataFrame, n: int = 5, match: str = CONTAINS) -> DataFrame:
    """First ``n`` posts of each polarity by (created_at, id): ``polarity, post_id, text``.

    The first pass ranks ids alone, in one scan for both polarities; Spark
    limits each rank group before the shuffle, to ``n`` rows per task.  The
    second looks up the texts of those ``2 n`` ids, so texts are read but only
    the sampled ones leave their task.
    """
    order = [F.col("created_at").asc_nulls_first(), F.col("post_id").asc_nulls_first()]
    keys = posts.select(F.col("data.id").alias("post_id"), F.col("data.created_at").alias("created_at"), first_tag().alias(TAG))
    polarity = F.explode(F.array_compact(F.array(F.when(is_positive(match, tag_col()), F.lit("positive")),
                                                 F.when(is_negative(match, tag_col()), F.lit("negative")))))
    keys = keys.select("post_id", "created_at", polarity.alias("polarity"))
    first = (keys.withColumn("_r", F.row_number().over(Window.partitionBy("polarity").orderBy(*order)))
                 .where(F.col("_r") <= n).select("polarity", "post_id", "created_at").distinct())
    texts = posts.select(F.col("data.id").alias("_id"), F.col("data.created_at").alias("_at"), F.col("data.text").alias("text"))
    found = texts.join(F.broadcast(first),  # at most 2 n rows
                       F.col("_id").eqNullSafe(F.col("post_id")) & F.col("_at").eqNullSafe(F.col("created_at")))
    # posts with equal id and time: all were looked up, n remain
    last = Window.partitionBy("polarity").orderBy(*order, F.col("text").asc_nulls_first())
    return found.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).select("polarity", "post_id", "text")


def samples_as_text(samples: DataFrame, separator: str = SAMPLE_SEPARATOR) -> DataFrame:
    """The sampled texts of each polarity joined into one display string.

    Only for the bounded output of ``sample_posts`` (``n`` rows per group).
    """
    return (samples.groupBy("polarity")
                   .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_id", "text"))),
                                                 lambda s: s["text"]), separator).alias("texts")))


# ---------------------------------------------------------------- J1 ------
def post_user_table(joined: DataFrame) -> DataFrame:
    """Flat view of posts ⋈ users: ``post_id, author_id, user_created_at, verified, followers``."""
    return joined.select(F.col("data.id").alias("post_id"), F.col("data.author_id").alias("author_id"),
                         F.col("created_at").alias("user_created_at"), F.col("verified"),
                         F.col("public_metrics.followers_count").alias("followers"))


# ---------------------------------------------------------------- Q4 ------
def account_age_split(posts: DataFrame, users: DataFrame, cutoff: str = ACCOUNT_AGE_CUTOFF,
                      match: str = PREFIX, dedupe: bool = True, compare: str = "string") -> DataFrame:
    """Polarity shares for accounts created before / after ``cutoff``.

    By default a string comparison on the user's ``created_at``, strict on
    both sides: an account created exactly at the cut-off is in neither
    group (with full ISO text, ``...T00:00:00.000Z > 'YYYY-MM-DD'`` holds, so
    only bare dates tie).  ``compare="timestamp"`` parses both sides first
    (unparsable values fall in neither group).  Posts are counted by non-NULL
    post id.  Output: ``description, n_posts, percentage``.
    """
    has_id = F.col("_has_id")
    per = per_author(posts, carry={"_has_id": F.col("data.id").isNotNull()},
                     pos=flag(is_positive(match, tag_col()) & has_id),
                     neg=flag(is_negative(match, tag_col()) & has_id))
    joined = with_users(per, user_columns(users, ["created_at"], dedupe), dedupe=False)
    created, cut = F.col("created_at"), F.lit(cutoff)
    if compare == "timestamp":
        created, cut = F.try_to_timestamp(created), F.try_to_timestamp(cut)
    elif compare != "string":
        raise ValueError("compare must be 'string' or 'timestamp'")
    older, newer = created < cut, created > cut
    wide = joined.agg(
        _zero(F.sum(F.when(older, F.col("pos")))).alias("old_pos"),
        _zero(F.sum(F.when(older, F.col("neg")))).alias("old_neg"),
        _zero(F.sum(F.when(newer, F.col("pos")))).alias("new_pos"),
        _zero(F.sum(F.when(newer, F.col("neg")))).alias("new_neg"))
    return _two_way(wide, [(OLDER_POSITIVE, OLDER_NEGATIVE, "old_pos", "old_neg"),
                           (NEWER_POSITIVE, NEWER_NEGATIVE, "new_pos", "new_neg")])


# ---------------------------------------------------------------- Q5 ------
def verified_counts(posts: DataFrame, users: DataFrame, match: str = CONTAINS,
                    dedupe: bool = True) -> DataFrame:
    """Positive / negative posts by verified accounts: ``polarity, n_posts``."""
    per = per_author(posts, pos=flag(is_positive(match, tag_col())), neg=flag(is_negative(match, tag_col())))
    joined = with_users(per, user_columns(users, ["verified"], dedupe).where("verified"), dedupe=False)
    wide = joined.agg(_zero(F.sum("pos")).alias("p"), _zero(F.sum("neg")).alias("n"))
    return wide.select(F.inline(F.array(
        F.struct(F.lit("positive").alias("polarity"), F.col("p").alias("n_posts")),
        F.struct(F.lit("negative").alias("polarity"), F.col("n").alias("n_posts")))))


# ---------------------------------------------------------------- Q6 ------
def follower_sums(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Post-weighted follower sums per polarity (exact: DECIMAL(38,0))."""
    f = F.col("public_metrics.followers_count")
    known = f.isNotNull()
    dec = "decimal(38,0)"
    return joined.groupBy(*keys).agg(
        F.sum(F.when(known, f.cast(dec) * F.col("pos").cast(dec))).alias("s_pos"),
        F.sum(F.when(known, F.col("pos"))).alias("c_pos"),
        F.sum(F.when(known, f.cast(dec) * F.col("neg").cast(dec))).alias("s_neg"),
        F.sum(F.when(known, F.col("neg"))).alias("c_neg"))


def _mean(s: str, c: str) -> Column:
    return F.try_divide(F.col(s).cast("double"), F.col(c).cast("double"))


def followers_mean(posts: DataFrame, users: DataFrame, match: str = CONTAINS,
                   dedupe: bool = True) -> DataFrame:
    """Mean followers of the author, per post, by polarity: ``polarity, avg_followers``.

    Per-author counts are joined with users and weighted by followers, which
    equals ``avg(followers)`` over the joined posts, without shipping posts.
    """
    per = per_author(posts, pos=flag(is_positive(match, tag_col())), neg=flag(is_negative(match, tag_col())))
    sums = follower_sums(with_users(per, user_columns(users, ["public_metrics"], dedupe), dedupe=False), [])
    return sums.select(F.inline(F.array(
        F.struct(F.lit("positive").alias("polarity"), _mean("s_pos", "c_pos").alias("avg_followers")),
        F.struct(F.lit("negative").alias("polarity"), _mean("s_neg", "c_neg").alias("avg_followers")))))


def followers_mean_of_means(posts: DataFrame, users: DataFrame, batch: Column | None = None,
                            match: str = CONTAINS, dedupe: bool = True) -> DataFrame:
    """Unweighted mean over batches of the per-batch follower means.

    ``batch`` assigns a post to a batch (default: the calendar day of the
    post).  A batch without posts of a polarity has no mean and is skipped.
    Output: ``polarity, avg_followers``.
    """
    batch = F.substring("data.created_at", 1, 10) if batch is None else batch
    per = per_author(posts, {"batch": batch}, pos=flag(is_positive(match, tag_col())),
                     neg=flag(is_negative(match, tag_col())))
    sums = follower_sums(with_users(per, user_columns(users, ["public_metrics"], dedupe), dedupe=False), ["batch"])
    means = sums.select(_mean("s_pos", "c_pos").alias("m_pos"), _mean("s_neg", "c_neg").alias("m_neg"))
    wide = means.agg(F.avg("m_pos").alias("p"), F.avg("m_neg").alias("n"))
    return wide.select(F.inline(F.array(
        F.struct(F.lit("positive").alias("polarity"), F.col("p").alias("avg_followers")),
        F.struct(F.lit("negative").alias("polarity"), F.col("n").alias("avg_followers")))))


# ---------------------------------------------------------------- Q3 ------
def _activity_histogram(posts: DataFrame, match: str) -> DataFrame:
    """Authors per (polarity, per-author count), plus the global mean.

    1. per author (partial aggregation, so a hot author is one row per map
       task): ``n_all`` = posts with a non-NULL author (the NULL author group
       counts 0, as ``count(author)`` does), ``n_pos``, ``n_neg``;
    2. histogram: authors and their all-polarity posts per (polarity, n).
       The number of distinct n per polarity is at most sqrt(2 * posts) + 1
       (distinct counts of disjoint groups sum to at most the post total), so
       this table is small whatever the data size;
    3. the mean posts per author over ALL authors is a window total over that
       small table: the posts are scanned and shuffled once, where a scalar
       subquery would recompute the per-author aggregate.

    Output: ``polarity, n, n_authors, mean_posts``.
    """
    author = F.col("author_id")
    flat = (posts.select(F.col("data.author_id").alias("author_id"), first_tag().alias(TAG))
                 .select("author_id",
                         flag(is_positive(match, tag_col()) & author.isNotNull()).alias("p"),
                         flag(is_negative(match, tag_col()) & author.isNotNull()).alias("n")))
    per = flat.groupBy("author_id").agg(
        F.count("author_id").alias("n_all"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    long = per.select(F.inline(F.array(
        F.struct(F.lit("positive").alias("polarity"), F.col("n_pos").alias("n"), F.col("n_all").alias("n_all")),
        F.struct(F.lit("negative").alias("polarity"), F.col("n_neg").alias("n"), F.col("n_all").alias("n_all")))))
    hist = long.groupBy("polarity", "n").agg(F.count(F.lit(1)).alias("n_authors"),
                                              F.sum("n_all").alias("s_all"))
    # every author appears once per polarity: totals over one polarity's rows.
    # A window over that small table: joining an aggregate of it instead was
    # planned with a second scan of the posts, as pruning tells the two apart.
    everyone = Window.partitionBy()
    one = F.col("polarity") == F.lit("positive")
    total_posts = F.sum(F.when(one, F.col("s_all"))).over(everyone)
    total_authors = F.sum(F.when(one, F.col("n_authors"))).over(everyone)
    return hist.select("polarity", "n", "n_authors",
                       F.try_divide(total_posts.cast("double"), total_authors.cast("double")).alias("mean_posts"))


def _group(n: Column, mean: Column) -> Column:
    return (F.when(n > mean, F.lit("active"))
             .when(n < mean, F.lit("less_active"))
             .otherwise(F.lit("at_mean")))


def activity_split(posts: DataFrame, match: str = PREFIX) -> DataFrame:
    """Polarity shares for authors above / below the mean posts per author.

    An author's positive count and negative count are each compared with the
    mean of ALL-polarity counts (strict on both sides), so one author can be
    active in one polarity and less active in the other; authors exactly at
    the mean are in neither group.  Output: ``description, n_posts, percentage``.
    """
    hist = _activity_histogram(posts, match)
    n, mean = F.col("n"), F.col("mean_posts")
    posts_n = n * F.col("n_authors")

    def total(pol: str, cond: Column) -> Column:
        return _zero(F.sum(F.when((F.col("polarity") == F.lit(pol)) & cond, posts_n)))

    wide = hist.agg(total("positive", n > mean).alias("act_pos"), total("negative", n > mean).alias("act_neg"),
                    total("positive", n < mean).alias("less_pos"), total("negative", n < mean).alias("less_neg"))
    return _two_way(wide, [(ACTIVE_POSITIVE, ACTIVE_NEGATIVE, "act_pos", "act_neg"),
                           (LESS_ACTIVE_POSITIVE, LESS_ACTIVE_NEGATIVE, "less_pos", "less_neg")])


def activity_groups(posts: DataFrame, match: str = PREFIX) -> DataFrame:
    """Authors and posts per (polarity, activity group), ``at_mean`` included.

    Authors are counted in a polarity only when they have posts of it.
    Output: ``polarity, activity_group, n_authors, n_posts``.
    """
    hist = _activity_histogram(posts, match).where(F.col("n") > 0)
    return (hist.groupBy("polarity", _group(F.col("n"), F.col("mean_posts")).alias("activity_group"))
                .agg(F.sum("n_authors").cast("long").alias("n_authors"),
                     F.sum(F.col("n") * F.col("n_authors")).cast("long").alias("n_posts")))
