"""Compaction behind a manifest: equal rows, fewer files, versions that readers can hold on to."""

import os

import pytest
from pyspark.sql import functions as F

from moodlens.schemas import POST
from moodlens.sources.compaction import DAY, compact, live_files, manifest, read_compacted, vacuum, versions
from moodlens.sources.files import land_posts
from tests.conftest import post


def posts(spark, first, n, days=3):
    rows = [post(str(i), text="t" * (i % 7), tags=["positive keywords"], created=f"2024-01-{1 + i % days:02d}T10:00:00.000Z") for i in range(first, first + n)]
    return spark.createDataFrame(rows, POST)


def ids(df):
    return sorted(int(r.id) for r in df.select("data.id").collect())


def per_day(df):
    return {r[DAY]: r["count"] for r in df.groupBy(DAY).count().collect()}


def test_small_files_become_one_per_day_and_rows_stay(spark, tmp_path):
    folder = str(tmp_path / "landing")
    land_posts(posts(spark, 0, 300), folder, max_records_per_file=10)
    before = live_files(spark, folder).count()
    assert before >= 30
    assert compact(spark, folder) == 1
    assert per_day(live_files(spark, folder)) == {f"2024-01-{d:02d}": 1 for d in (1, 2, 3)}
    got = read_compacted(spark, folder)
    assert ids(got) == list(range(300)) and {r[DAY] for r in got.select(DAY).distinct().collect()} == {"2024-01-01", "2024-01-02", "2024-01-03"}
    assert got.where(F.col(DAY) != F.substring("data.created_at", 1, 10)).count() == 0
    # readers of the plain folder still see every post once
    assert ids(spark.read.schema(POST).parquet(folder)) == list(range(300))
    assert compact(spark, folder) is None and versions(spark, folder) == [1]  # run again: nothing changes


def test_an_older_version_stays_readable_until_vacuum(spark, tmp_path):
    folder = str(tmp_path / "landing")
    land_posts(posts(spark, 0, 60), folder, max_records_per_file=5)
    compact(spark, folder)
    reader = read_compacted(spark, folder)  # holds the files of version 1
    land_posts(posts(spark, 60, 60), folder, max_records_per_file=5)
    assert ids(read_compacted(spark, folder)) == list(range(120))  # landed since
    assert ids(read_compacted(spark, folder, version=1)) == list(range(60))
    assert compact(spark, folder) == 2
    assert ids(reader) == list(range(60)) and ids(read_compacted(spark, folder)) == list(range(120))
    gone = manifest(spark, folder).where("merged").count()
    assert vacuum(spark, folder) == gone > 0
    assert ids(read_compacted(spark, folder)) == list(range(120)) and per_day(live_files(spark, folder)) == {f"2024-01-{d:02d}": 1 for d in (1, 2, 3)}


def test_a_failed_job_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "landing")
    land_posts(posts(spark, 0, 60), folder, max_records_per_file=5)
    compact(spark, folder)
    land_posts(posts(spark, 60, 30), folder, max_records_per_file=5)
    compact(spark, folder)
    os.remove(f"{folder}/_manifests/v=2/_SUCCESS")  # as if it had ended before
    assert versions(spark, folder) == [1]
    assert ids(read_compacted(spark, folder)) == list(range(90))
    assert compact(spark, folder) == 2 and ids(read_compacted(spark, folder)) == list(range(90))


def test_a_large_day_gets_several_files(spark, tmp_path):
    folder = str(tmp_path / "landing")
    land_posts(posts(spark, 0, 4000, days=1), folder, max_records_per_file=100)
    size = live_files(spark, folder).agg(F.sum("bytes")).first()[0]
    compact(spark, folder, target_bytes=size // 3)
    assert 2 <= live_files(spark, folder).count() <= 4 and ids(read_compacted(spark, folder)) == list(range(4000))


def test_files_are_looked_up_by_a_few_tasks(spark, tmp_path):
    """Not by a task for each file."""
    folder, sc = str(tmp_path / "landing"), spark.sparkContext
    land_posts(posts(spark, 0, 300), folder, max_records_per_file=2)
    assert live_files(spark, folder).count() >= 150
    sc.setJobGroup("lookup", "compaction")
    assert compact(spark, folder) == 1
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("lookup") for s in sc.statusTracker().getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) <= 64
    assert ids(read_compacted(spark, folder)) == list(range(300))


def test_empty_folder(spark, tmp_path):
    folder = str(tmp_path / "landing")
    land_posts(posts(spark, 0, 1).limit(0), folder)
    assert compact(spark, folder) is None and read_compacted(spark, folder).count() == 0 and vacuum(spark, folder) == 0
    with pytest.raises(Exception):
        read_compacted(spark, folder, version=7).count()
