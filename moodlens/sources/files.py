"""File sources and sinks for posts and users.

All readers use the fixed schemas (no inference pass; an empty folder is an
empty DataFrame).  Formats: JSON lines (what the stream service delivers)
and Parquet (the landing format: columnar, filter push-down, nested-field
pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.schemas import CORRUPT_COLUMN, ENVELOPE, POST, POST_WITH_CORRUPT, USER


def _reader(spark: SparkSession, fmt: str, schema):
    if fmt not in ("json", "parquet"):
        raise ValueError(f"format must be json or parquet, got {fmt!r}")
    return spark.read.format(fmt).schema(schema)


def read_posts(spark: SparkSession, path: str | list[str], fmt: str = "json",
               mode: str | None = None) -> DataFrame:
    """Scan a post archive (file or folder, JSON lines or Parquet).

    ``mode`` (JSON only): ``PERMISSIVE`` (default; malformed lines become
    all-NULL rows), ``DROPMALFORMED`` (they are skipped) or ``FAILFAST``.
    Use :func:`read_posts_with_quarantine` to keep and count them instead.
    """
    reader = _reader(spark, fmt, POST)
    if mode:
        if fmt != "json":
            raise ValueError("mode applies to JSON input only")
        reader = reader.option("mode", mode)
    return reader.load(path)


def read_users(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """Scan user records (one user per JSON line, or Parquet)."""
    return _reader(spark, fmt, USER).load(path)


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """``{"data": [user, ...]}`` documents -> one row per user.

    ``explode`` (not ``explode_outer``): an envelope without users yields no
    row.  Each envelope is bounded by the look-up API (100 ids per call).
    """
    return envelopes.select(F.explode("data").alias("u")).select("u.*")


def read_user_envelopes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read look-up responses (one JSON document per line) as user rows."""
    return explode_envelopes(spark.read.schema(ENVELOPE).json(path))


def read_posts_with_quarantine(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read JSON lines keeping malformed lines in ``_corrupt_record``.

    A line that does not parse (cut off mid-object, ``null``) keeps its raw
    text in the corrupt column; split with :func:`quarantine_split`.
    """
    return (spark.read.schema(POST_WITH_CORRUPT)
                 .option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
                 .json(path))


def quarantine_split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good posts, quarantined rows).

    Good = parsed and carries a post id.  Everything else (malformed text,
    ``null`` lines, objects without ``data.id``) is quarantined with a reason.
    """
    bad_text = F.col(CORRUPT_COLUMN).isNotNull()
    no_id = F.col("data.id").isNull()
    good = raw.where(~bad_text & ~no_id).drop(CORRUPT_COLUMN)
    quarantine = (raw.where(bad_text | no_id)
                     .select(F.when(bad_text, F.lit("malformed")).otherwise(F.lit("no_post_id")).alias("reason"),
                             F.col(CORRUPT_COLUMN).alias("raw")))
    return good, quarantine


def quarantine_report(raw: DataFrame) -> DataFrame:
    """Counts of good and quarantined lines: ``status, n``."""
    bad_text = F.col(CORRUPT_COLUMN).isNotNull()
    status = (F.when(bad_text, F.lit("malformed"))
               .when(F.col("data.id").isNull(), F.lit("no_post_id"))
               .otherwise(F.lit("good")))
    return raw.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def land_posts(posts: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "ingest_date",
               max_records_per_file: int | None = None, mode: str = "append") -> None:
    """Write posts to a landing folder, partitioned by the day of the post.

    ``ingest_date`` is derived from ``data.created_at`` when asked for and
    missing.  Posts are clustered by the day before they are written (a
    rebalancing exchange: AQE splits a day that is too large for one task), so
    a day gets as few files as its size asks for, not one per task.  Files are
    rolled every ``max_records_per_file`` rows.  The file sink commits
    atomically, so a streaming reader never sees half a file.
    """
    df = posts
    if partition_by == "ingest_date" and "ingest_date" not in df.columns:
        df = df.withColumn("ingest_date", F.coalesce(F.substring("data.created_at", 1, 10), F.lit("unknown")))
    if partition_by:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    writer.save(path)


def authors_to_fetch(posts: DataFrame, known_users: DataFrame | None = None) -> DataFrame:
    """Distinct authors of ``posts`` that still need a user look-up.

    Distributed and de-duplicated (the original collected every id into one
    string on the driver).  With ``known_users``, authors already known are
    removed by an anti join.  Output: ``author_id``.
    """
    authors = (posts.select(F.col("data.author_id").alias("author_id"))
                    .where(F.col("author_id").isNotNull())
                    .distinct())
    if known_users is not None:
        known = known_users.select(F.col("id").alias("author_id"))
        authors = authors.join(known, "author_id", "left_anti")
    return authors


def register_views(spark: SparkSession, **frames: DataFrame) -> None:
    """Optional: expose DataFrames to ``spark.sql`` under the given names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
