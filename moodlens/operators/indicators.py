"""Indicator words/emojis counted in post text.

The original counts each indicator with its own query (one scan + join per
indicator, twice).  Here all indicators are counted in ONE pass: each post is
lower-cased once and every indicator becomes one ``count_if(contains(...))``
column of a single aggregate, which Spark evaluates with partial aggregation
inside whole-stage codegen and no join at all.  The wide row is then turned
into one row per indicator (joined with the small lexicon table).  Matching is a literal substring test (``fav``
also hits ``favorite``); a post counts once per indicator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlens.functions.polarity import CONTAINS, is_negative, is_positive
from moodlens.operators.join import AUTHOR, known_authors

LOWER_TEXT = "_lower_text"
INDEX = "_lex_index"


def _hit(index: int) -> str:
    return f"_hit_{index}"


def _with_lower_text(posts: DataFrame, *extra: Column) -> DataFrame:
    return posts.select(F.lower(F.col("data.text")).alias(LOWER_TEXT), *extra)


def _hits(terms) -> list[Column]:
    """One ``count_if(contains(lower_text, term))`` per term, unnamed."""
    text = F.col(LOWER_TEXT)
    return [F.count_if(F.contains(text, F.lit(t))) for t in terms]


def _matched_indexes(terms) -> Column:
    """Lexicon indexes whose term occurs in ``LOWER_TEXT`` (each at most once).

    A ``concat`` of one-element-or-empty arrays stays in generated code.
    """
    text, empty = F.col(LOWER_TEXT), F.array().cast("array<int>")
    return F.concat(*[F.when(F.contains(text, F.lit(t)), F.array(F.lit(i))).otherwise(empty)
                      for i, t in enumerate(terms)])


def lexicon_frame(spark, lexicon) -> DataFrame:
    """The lexicon as a small table with its list index (fixed, bounded size)."""
    return spark.createDataFrame([(i, pos, ind, pol) for i, (pos, ind, pol) in enumerate(lexicon)],
                                 f"{INDEX} int, position int, indicator string, polarity string")


def _unpivot(wide: DataFrame, lexicon, kinds: dict[str, list[str]]) -> DataFrame:
    """One wide row -> one row per lexicon entry.

    ``kinds`` maps an output column to the wide columns holding it, in
    lexicon order.  The values are zipped into one array, exploded with their
    index, and joined with the (bounded, broadcast) lexicon table.
    """
    arrays = [F.array(*cols).alias(name) for name, cols in kinds.items()]
    exploded = (wide.select(F.posexplode(F.arrays_zip(*arrays)).alias(INDEX, "_v"))
                    .select(INDEX, *[F.col(f"_v.{name}").alias(name) for name in kinds]))
    lex = F.broadcast(lexicon_frame(wide.sparkSession, lexicon))
    return lex.join(exploded, INDEX).drop(INDEX)


def indicator_counts(posts: DataFrame, lexicon, users: DataFrame | None = None,
                     dedupe: bool = False) -> DataFrame:
    """Posts containing each indicator: ``polarity, position, indicator, n_posts``.

    With ``users``, only posts whose author is a known user count (the
    original counts over posts joined with users).  That restriction is done
    after a sparse per-author pre-aggregate (one row per author and indicator
    hit), so the join never sees individual posts.
    Indicators without any hit still appear with 0.  A repeated indicator
    keeps one row per position unless ``dedupe`` keeps only its first one.
    """
    lexicon = list(lexicon)
    if dedupe:
        seen: set = set()
        lexicon = [e for e in lexicon if not (e[1] in seen or seen.add(e[1]))]
    names = [_hit(i) for i in range(len(lexicon))]
    terms = [ind for _, ind, _ in lexicon]
    if users is None:
        wide = _with_lower_text(posts).agg(*_hits(terms)).toDF(*names)
        rows = _unpivot(wide, lexicon, {"n_posts": names})
    else:
        # Sparse per-author counts: one row per (author, indicator) that
        # occurs at all, so the shuffle and the user join carry only hits.
        base = _with_lower_text(posts, F.col("data.author_id").alias(AUTHOR))
        per = (base.select(AUTHOR, F.explode(_matched_indexes(terms)).alias(INDEX))
                   .groupBy(AUTHOR, INDEX).agg(F.count(F.lit(1)).alias("n_posts")))
        totals = known_authors(per, users).groupBy(INDEX).agg(F.sum("n_posts").alias("n_posts"))
        lex = F.broadcast(lexicon_frame(posts.sparkSession, lexicon))
        rows = lex.join(totals, INDEX, "left").drop(INDEX)
    return rows.select("polarity", "position", "indicator",
                       F.coalesce(F.col("n_posts"), F.lit(0)).cast("long").alias("n_posts"))


def indicator_quality(posts: DataFrame, lexicon, match: str = CONTAINS, rules: DataFrame | None = None) -> DataFrame:
    """How well each distinct indicator goes with each polarity.

    ``hits`` = posts containing the indicator; ``share_pos`` / ``share_neg`` =
    the fraction of those posts whose first tag is positive / negative
    (NULL when there are no hits).  ``rules`` (``post_id, matching_rules``)
    gives the posts' tags if they come from another table; the indexes of the
    indicators in a text are found in the scan, and only they meet the rules.
    """
    distinct = list(dict.fromkeys(ind for _, ind, _ in lexicon))
    if rules is None:
        base = _with_lower_text(posts, is_positive(match).alias("_pos"), is_negative(match).alias("_neg"))
        found = base.select(F.explode(_matched_indexes(distinct)).alias(INDEX), "_pos", "_neg")
    else:
        base = _with_lower_text(posts, F.col("data.id").alias("post_id"))
        hits = base.select("post_id", _matched_indexes(distinct).alias("_hits")).where(F.size("_hits") > 0)
        tags = rules.select("post_id", is_positive(match).alias("_pos"), is_negative(match).alias("_neg"))
        found = hits.join(tags, "post_id", "left").select(F.explode("_hits").alias(INDEX), "_pos", "_neg")
    totals = found.groupBy(INDEX).agg(F.count(F.lit(1)).alias("hits"), F.count_if("_pos").alias("p"), F.count_if("_neg").alias("n"))
    lex = F.broadcast(lexicon_frame(posts.sparkSession, [(i, ind, "") for i, ind in enumerate(distinct)]))
    rows = lex.join(totals, INDEX, "left")
    return rows.select("indicator", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
                       F.try_divide(F.col("p"), F.col("hits")).alias("share_pos"),
                       F.try_divide(F.col("n"), F.col("hits")).alias("share_neg"))
