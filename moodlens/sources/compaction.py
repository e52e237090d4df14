"""Compaction of landed files behind a manifest.

A landing folder grows by small files.  ``compact`` merges the small files of a
day into files of about ``target_bytes`` and publishes a manifest, the list of
files that make up the table, as the next version.  Files are only ever added:
merged ones go below ``_compacted``, where readers of the plain folder don't look,
and old ones stay until ``vacuum``.  So a reader of an earlier version goes on
reading whole days while a job runs, and sees either none or all of a version.

A version is written by one Spark job and counts once its ``_SUCCESS`` marker is
there.  A job that fails before that leaves the table as it was, and one that is
run again finds no small files and changes nothing.  What has landed since a
manifest was made belongs to the table, too (``read_compacted``), and is listed
by the next version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlens.schemas import POST
from moodlens.session import configured, scratch_path

DAY = "ingest_date"
DAY_OF = f"(?:^|/){DAY}=([^/]*)/"
TARGET_BYTES = 256 << 20
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: A file below this share of the target is small.
SMALL = 0.5
#: One row per file: its day, its name below the folder, and its size.  ``merged``
#: lists files that compaction has replaced (they are no part of the table).
MANIFEST = T.StructType([T.StructField(DAY, T.StringType()), T.StructField("file", T.StringType()),
                         T.StructField("bytes", T.LongType()), T.StructField("merged", T.BooleanType())])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions of the manifest, oldest first."""
    fs, path = _fs(spark, f"{folder}/_manifests")
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.isDirectory()]
    return sorted(int(p.getName().removeprefix("v=")) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Rows of a published manifest (the newest by default; empty before the first)."""
    known = versions(spark, folder)
    if version is not None and version not in known:
        raise ValueError(f"no version {version} of {folder}")
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifests/v={known[-1] if version is None else version}")


def _files(spark: SparkSession, folder: str, below: str = "") -> DataFrame:
    """``ingest_date, file, bytes`` of the Parquet files below ``folder/below``, as
    Spark lists them; names are relative to ``folder``."""
    name = folder.rstrip("/").split("://")[-1].split("/", 1)[-1]
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder + below)
             .select("path", F.col("length").alias("bytes")))  # names and sizes alone: no content is read
    named = files.select(F.regexp_extract("path", f"(?:^|/)\\Q{name}\\E/(.*)$", 1).alias("file"), "bytes")
    return named.select(F.regexp_extract("file", DAY_OF, 1).alias(DAY), "file", "bytes").where(F.col(DAY) != "")


def _rows(spark: SparkSession, names: list[str], schema: T.StructType) -> DataFrame:
    """Rows of the named files and their ``ingest_date``.  Spark looks the files up in one
    job, by default with a task for each of them: a few tasks per core do."""
    with configured(spark, {LISTING_TASKS: str(4 * spark.sparkContext.defaultParallelism)}):
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*names)
    return rows.select("*", F.regexp_extract("_metadata.file_path", DAY_OF, 1).alias(DAY))


def live_files(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """``ingest_date, file, bytes``: the files that make up the table now, or
    those of one version."""
    listed = manifest(spark, folder, version)
    held = listed.where(~F.col("merged")).drop("merged")
    if version is not None:
        return held
    return held.unionByName(_files(spark, folder).join(listed.select("file"), "file", "left_anti").select(held.columns))


def read_compacted(spark: SparkSession, folder: str, version: int | None = None, schema: T.StructType = POST) -> DataFrame:
    """Posts and their ``ingest_date``: the newest manifest and what has landed
    since, or one version.

    The list of files is read by the driver, as Spark's own file listing is."""
    files = [f"{folder}/{r.file}" for r in live_files(spark, folder, version).select("file").collect()]
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(DAY, T.StringType())]))
    return _rows(spark, files, schema)


def compact(spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, schema: T.StructType = POST) -> int | None:
    """Merges the small files of each day that has two or more; returns the new
    version, or None if there is nothing to merge and nothing new to list."""
    folder = folder.rstrip("/")
    before = manifest(spark, folder)
    # listed once: a list that changed under the job could name files that weren't merged
    listing = scratch_path(spark, "listing")
    live_files(spark, folder).withColumn("small", F.col("bytes") < int(target_bytes * SMALL)).write.parquet(listing)
    now = spark.read.schema(f"{DAY} string, file string, bytes bigint, small boolean").parquet(listing)
    days = (now.where("small").groupBy(DAY).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
            .where("n > 1").select(F.col(DAY).alias("_day"), F.ceil(F.col("total") / target_bytes).cast("int").alias("_parts")))
    old = now.where("small").join(days, F.col(DAY) == F.col("_day"), "left_semi").select(DAY, "file", "bytes")
    names = [f"{folder}/{r.file}" for r in old.select("file").collect()]
    if not names and now.join(before.select("file"), "file", "left_anti").isEmpty():
        return None
    new = spark.createDataFrame([], MANIFEST)
    if names:
        below = f"/_compacted/{uuid.uuid4().hex[:12]}"
        rows = _rows(spark, names, schema)
        # a day's rows are dealt over as many tasks as it gets files (a number of
        # partitions that is given isn't coalesced; spare ones keep parts apart)
        total = days.agg(F.sum("_parts")).first()[0]
        dealt = rows.join(days, F.col(DAY) == F.col("_day")).withColumn("_part", F.pmod(F.xxhash64(*schema.names), F.col("_parts")))
        dealt.repartition(4 * total, DAY, "_part").select(*schema.names, DAY).write.partitionBy(DAY).parquet(folder + below)
        new = _files(spark, folder, below).withColumn("merged", F.lit(False))
    gone = before.where("merged").unionByName(old.withColumn("merged", F.lit(True)))
    kept = now.drop("small").join(old.select("file"), "file", "left_anti").withColumn("merged", F.lit(False))
    version = (versions(spark, folder) or [0])[-1] + 1
    out = kept.select(MANIFEST.names).unionByName(new.select(MANIFEST.names)).unionByName(gone.select(MANIFEST.names))
    # the marker, which is written last, makes the version count
    out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").mode("overwrite").parquet(f"{folder}/_manifests/v={version}")
    return version


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes files that the newest manifest lists as merged, once no reader of an
    older version is left; returns how many."""
    fs, _ = _fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    names = [r.file for r in manifest(spark, folder).where("merged").select("file").collect()]
    return sum(bool(fs.delete(path(f"{folder}/{n}"), False)) for n in names)
