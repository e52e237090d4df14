"""Views of the driver's test tables as posts and users.

The test tables hold no social posts, so they are read *as* posts:

* fixture E: ``events`` are posts, ``customer`` (+ first ``orders`` date) are
  the users;
* fixture O: ``orders`` are posts of customers (activity split);
* fixture D: ``documents`` (+ ``labels``) are posts with real text.

Every function is a projection of the table (plus one grouped look-up for the
users), so it scales with the tables and Catalyst prunes unused columns down
to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.functions.polarity import no_rules, rule_matches
from moodlens.lexicons import (
    TAG_NEGATIVE_EMOJIS, TAG_NEGATIVE_KEYWORDS, TAG_POSITIVE_EMOJIS, TAG_POSITIVE_KEYWORDS,
)

RULES_TYPE = "array<struct<id:string,tag:string>>"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
DATE_ONLY = "yyyy-MM-dd"
# Account age cut-off used with fixture E (user created_at is a bare date).
FIXTURE_E_CUTOFF = "1995-07-01"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    """Parquet scans of the named tables."""
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def post_columns(post_id, author_id, created_at, text, lang, rules) -> list[Column]:
    return [
        F.struct(
            post_id.cast("string").alias("id"),
            author_id.cast("string").alias("author_id"),
            created_at.alias("created_at"),
            text.alias("text"),
            lang.alias("lang"),
        ).alias("data"),
        rules.alias("matching_rules"),
    ]


def posts_from_events(events: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Fixture E (see :func:`event_post_columns`)."""
    return events.select(*event_post_columns(only))


def event_post_columns(only: tuple[str, ...] | None = None) -> list[Column]:
    """An event as a post.  Rule ids 1..4 follow the four stream rules' order.

    ``only`` names the ``data`` fields that a question needs; the others are
    NULL and their columns are not read (a struct whose fields meet functions
    is built whole otherwise).
    """
    et, value = F.col("event_type"), F.col("value")
    rules = rule_matches([
        (et.isin("purchase", "signup"), "1", TAG_POSITIVE_KEYWORDS),
        (value >= 100, "2", TAG_POSITIVE_EMOJIS),
        (et == "error", "3", TAG_NEGATIVE_KEYWORDS),
        ((et == "view") & (value < 20), "4", TAG_NEGATIVE_EMOJIS),
    ])
    fields = {"id": F.col("event_id"), "author_id": F.col("user_id"), "created_at": F.date_format("ts", ISO_MILLIS),
              "text": F.concat_ws(" ", "event_type", "props")}
    kept = [c if only is None or k in only else F.lit(None).cast("string") for k, c in fields.items()]
    return post_columns(*kept, F.lit("en"), rules)


def users_from_customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Fixture E users: one row per customer.

    ``created_at`` is the date of the customer's first order (date only),
    ``verified`` means market segment BUILDING, followers = floor(balance).
    The first-order look-up is a grouped aggregate (partial aggregation on
    the map side, so a customer with a third of all orders costs one row per
    map task), joined 1:1 with the customer table.
    """
    first = (orders.groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order")))
    joined = customer.join(first, customer["c_custkey"] == first["o_custkey"], "left")
    return joined.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.date_format("first_order", DATE_ONLY).alias("created_at"),
        (F.col("c_mktsegment") == F.lit("BUILDING")).alias("verified"),
        F.struct(F.floor("c_acctbal").cast("long").alias("followers_count")).alias("public_metrics"),
    )


def user_snapshots_from_orders(orders: DataFrame) -> DataFrame:
    """Fixture E users seen again and again: an order is a snapshot of its
    customer; seven years of orders are drawn together into the events' month."""
    since = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
                               + F.floor((F.unix_micros(F.col("o_orderdate").cast("timestamp")) - F.unix_micros(F.lit("1995-01-01").cast("timestamp"))) / 80))
    return orders.select(
        F.col("o_custkey").cast("string").alias("id"), since.alias("seen_at"), F.date_format("o_orderdate", DATE_ONLY).alias("created_at"),
        (F.col("o_orderpriority") < F.lit("3")).alias("verified"),
        F.struct(F.floor("o_totalprice").cast("long").alias("followers_count")).alias("public_metrics"))


def posts_from_orders(orders: DataFrame) -> DataFrame:
    """Fixture O: an order is a post of its customer, one rule per post.

    Priorities 1-URGENT, 2-HIGH, 3-MEDIUM are positive, the rest negative.
    """
    positive = F.col("o_orderpriority") < F.lit("4")
    rules = F.array(F.when(positive, F.struct(F.lit("1").alias("id"), F.lit(TAG_POSITIVE_KEYWORDS).alias("tag")))
                    .otherwise(F.struct(F.lit("3").alias("id"), F.lit(TAG_NEGATIVE_KEYWORDS).alias("tag"))))
    return orders.select(*post_columns(
        F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", ISO_MILLIS),
        F.col("o_orderpriority"), F.lit("en"), rules))


def label_rules(labels: DataFrame) -> DataFrame:
    """``post_id, matching_rules`` of the labelled documents, one row each.

    quality = 1 gives ``positive keywords``; otherwise toxic = 1 gives
    ``negative keywords``; everything else has no rule.  Repeated label rows
    collapse in the partial aggregate (max of each flag).  Grouped by the id that posts
    have, so Catalyst knows it is unique and leaves the join with the posts out where no rule is read.
    """
    flags = labels.groupBy(F.col("doc_id").cast("string").alias("post_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    positive = F.col("quality") == 1
    rules = rule_matches([(positive, "1", TAG_POSITIVE_KEYWORDS),
                          (~positive & (F.col("toxic") == 1), "3", TAG_NEGATIVE_KEYWORDS)])
    return flags.select("post_id", rules.alias("matching_rules"))


def posts_from_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Fixture D: documents as posts, tagged from ``labels`` (see :func:`label_rules`).

    Work on the texts should come before the join with the labels
    (``operators.indicators.indicator_quality`` takes them apart), so that no
    exchange carries texts; this joined form serves small look-ups and landing.
    """
    posts = documents.select(*post_columns(
        F.col("doc_id"), F.col("source"), F.lit(None).cast("string"),
        F.col("text"), F.col("lang"), no_rules()))
    if labels is None:
        return posts
    rules = label_rules(labels)
    return (posts.drop("matching_rules").join(rules, F.col("data.id") == F.col("post_id"), "left")
            .select("data", F.coalesce("matching_rules", no_rules()).alias("matching_rules")))
