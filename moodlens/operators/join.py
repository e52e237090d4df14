"""Posts ⋈ users.

Two shapes:

* ``join_users`` - the row-level inner join (one output row per post whose
  author is known); the user side is unique per key, and AQE's skew join
  splits the partition of an author with very many posts;
* ``per_author`` + ``with_users`` - pre-aggregate additive measures per
  author first, then join one row per author with one row per user.  Every
  analysis that only needs sums over the join uses this shape: the shuffle
  carries one partial row per (map task, author) instead of every post, and a
  hot author cannot overload a join task because it is a single row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlens.functions.polarity import TAG, first_tag

AUTHOR = "author_id"


#: The columns that decide between rows of one user, in this order.
USER_ORDER = ("created_at", "verified", "public_metrics")


def dedupe_users(users: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per user id: the largest by ``USER_ORDER`` (a null is smallest),
    then by any other column that is asked for.

    A user listed twice must not multiply that user's posts, and every question
    must see the same row of that user, so the order doesn't depend on the
    question: these three narrow columns are read whichever of them ``columns``
    names.  ``max`` over a struct is deterministic, so a re-executed task after
    an executor loss yields the same row; partial aggregation collapses copies
    map-side.
    """
    wanted = [c for c in (columns if columns is not None else users.columns) if c != "id"]
    known = users.where(F.col("id").isNotNull())
    if not wanted:
        return known.select("id").distinct()
    order = [c for c in USER_ORDER if c in users.columns]
    order += [c for c in wanted if c not in order]
    return (known.groupBy("id")
                 .agg(F.max(F.struct(*order)).alias("_u"))
                 .select("id", *[F.col(f"_u.{c}").alias(c) for c in wanted]))


def user_columns(users: DataFrame, columns: list[str], dedupe: bool) -> DataFrame:
    """``id`` and the named columns, one row per id."""
    return dedupe_users(users, columns) if dedupe else users.select("id", *columns)


def join_users(posts: DataFrame, users: DataFrame, dedupe: bool = True) -> DataFrame:
    """``posts INNER JOIN users ON users.id = posts.data.author_id``.

    Output: every post column plus the user columns at top level (``id``,
    ``created_at``, ``verified``, ``public_metrics``), like ``SELECT *``.
    Posts without a known author are dropped (inner join).
    """
    u = dedupe_users(users) if dedupe else users
    return posts.join(u, F.col("data.author_id") == u["id"])


def per_author(posts: DataFrame, extra_keys: dict[str, Column] | None = None,
               carry: dict[str, Column] | None = None, **sums: Column) -> DataFrame:
    """Sum per-post measures by author (and optional named extra keys).

    Posts are first projected to flat columns: the author, the first tag
    (``functions.polarity.TAG``, read ONCE), the extra keys and any
    ``carry`` columns; ``sums`` are then evaluated on that flat frame (build
    them with ``is_positive(match, tag_col())`` etc.) and summed per author.
    Reading each post field once lets Catalyst collapse the projections and
    prune the scan to the columns actually used; grouping by plain
    attributes avoids an extra projection that would keep a constructed
    ``data`` struct alive.
    """
    extra = dict(extra_keys or {})
    carry = dict(carry or {})
    base = posts.select(F.col("data.author_id").alias(AUTHOR), first_tag().alias(TAG),
                        *[c.alias(n) for n, c in extra.items()],
                        *[c.alias(n) for n, c in carry.items()])
    flat = base.select(AUTHOR, *extra, *[c.alias(n) for n, c in sums.items()])
    return flat.groupBy(AUTHOR, *extra).agg(*[F.sum(n).alias(n) for n in sums])


def with_users(author_rows: DataFrame, users: DataFrame, how: str = "inner",
               dedupe: bool = True) -> DataFrame:
    """Join per-author rows with (deduplicated) users, one user row per author.

    Both sides are unique per key, so the join has no hot key.  AQE turns it
    into a broadcast join at run time when the user side turns out small.
    """
    u = dedupe_users(users) if dedupe else users
    return author_rows.join(u, author_rows[AUTHOR] == u["id"], how)


def known_authors(author_rows: DataFrame, users: DataFrame) -> DataFrame:
    """Keep per-author rows whose author is a known user (semi join)."""
    u = users.select("id").where(F.col("id").isNotNull())
    return author_rows.join(u, author_rows[AUTHOR] == u["id"], "left_semi")
