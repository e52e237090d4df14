"""Streaming sources: a landing folder of post files read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlens.operators.join import dedupe_users
from moodlens.schemas import POST
from moodlens.session import scratch_path

# Bound of a micro-batch unless given: a few scan splits per core of a large cluster.
BYTES_PER_TRIGGER = 64 << 30

# Landed post files carry the ingest day as a folder partition.
LANDED_POST = T.StructType(POST.fields + [T.StructField("ingest_date", T.StringType())])


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", arrived: str | None = None, **options) -> DataFrame:
    """Files of ``folder`` as a stream; ``arrived`` names a column for the time at
    which a row's file was written, unless ``schema`` has such a column."""
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.load(folder)
    if arrived and arrived not in schema.names:
        rows = rows.select("*", F.col("_metadata.file_modification_time").alias(arrived))
    return rows


def post_stream(spark: SparkSession, landing_dir: str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None,
                max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Posts as a Structured Streaming source over ``landing_dir``.

    A micro-batch is bounded by ``max_files_per_trigger`` (or
    ``max_bytes_per_trigger`` for Parquet), the counterpart of the original
    "read 99 lines per pass".  Files must be complete when they appear; the
    parquet/json file sinks of ``land_posts`` commit atomically.
    """
    reader = spark.readStream.format(fmt).schema(LANDED_POST)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", int(max_bytes_per_trigger))
    return reader.load(landing_dir)


def snapshot_users(spark: SparkSession, users: DataFrame, name: str = "users", buckets: int | None = None,
                   dedupe: bool = True) -> DataFrame:
    """The static side of a stream-static join, written once.

    Users are deduplicated once and written below the shared checkpoint
    folder as a table bucketed (and sorted) by ``id``.  Every micro-batch then
    reads a plain bucketed table: the user side is neither recomputed nor
    shuffled, only the micro-batch is (streaming queries run without AQE, so
    this is decided here).  Drop the table with :func:`drop_snapshot`.  ``buckets`` defaults to
    ``spark.sql.shuffle.partitions`` so the planner keeps the bucketing.
    """
    n = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    safe = "".join(ch if ch.isalnum() else "_" for ch in name)
    table = f"moodlens_users_{safe}_{uuid.uuid4().hex[:10]}"
    df = dedupe_users(users) if dedupe else users
    (df.write.format("parquet").bucketBy(n, "id").sortBy("id")
       .option("path", scratch_path(spark, f"{name}-users")).saveAsTable(table))
    return spark.table(table)


def drop_snapshot(spark: SparkSession, snapshot: DataFrame) -> None:
    """Forgets a table of :func:`snapshot_users` once its stream has stopped
    (its files are below the shared checkpoint folder, which the cluster cleans)."""
    for name in {r.name for r in spark.catalog.listTables() if r.name.startswith("moodlens_users_")}:
        if spark.table(name).sameSemantics(snapshot):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
