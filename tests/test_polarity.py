from pyspark.sql import functions as F

from moodlens.functions.polarity import first_tag, hour_utc, is_negative, is_positive
from moodlens.schemas import POST
from tests.conftest import post


def test_first_tag_edge_cases(spark):
    rows = [post("1", tags=[]), post("2", tags=None),
            post("3", tags=["negative keywords", "positive emojis"]),
            post("4", tags=["positive keywords"])]
    df = spark.createDataFrame(rows, POST)
    got = {r.pid: r.tag for r in df.select(F.col("data.id").alias("pid"), first_tag().alias("tag")).collect()}
    assert got == {"1": None, "2": None, "3": "negative keywords", "4": "positive keywords"}


def test_two_rules_negative_first_counts_negative_only(spark):
    df = spark.createDataFrame([post("1", tags=["negative emojis", "positive keywords"])], POST)
    r = df.select(is_positive().alias("p"), is_negative().alias("n")).first()
    assert (r.p, r.n) == (False, True)


def test_substring_vs_prefix(spark):
    df = spark.createDataFrame([post("1", tags=["not positive"])], POST)
    r = df.select(is_positive("contains").alias("c"), is_positive("prefix").alias("p")).first()
    assert (r.c, r.p) == (True, False)


def test_hour_utc_is_chars_12_13(spark):
    df = spark.createDataFrame([post("1", created="2021-03-01T07:59:59.000Z")], POST)
    assert df.select(hour_utc().alias("h")).first().h == "07"


def test_scale_conf_bounds():
    from moodlens.session import scale_conf
    small = scale_conf(10 * 1024 ** 2)
    assert small["spark.sql.shuffle.partitions"] == "200"
    big = scale_conf(100 * 1024 ** 4)  # 100 TB
    assert big["spark.sql.shuffle.partitions"] == "409600"
    mid = scale_conf(1024 ** 4, text_heavy=True)  # 1 TB of text
    assert mid["spark.sql.shuffle.partitions"] == "4096"
    assert mid["spark.sql.files.maxPartitionBytes"] == str(64 * 1024 ** 2)


def test_checkpoint_root_reads_session_setting(spark):
    from moodlens.session import checkpoint_root, scratch_path
    root = checkpoint_root(spark)
    assert root and scratch_path(spark, "x").startswith(root + "/moodlens/x-")
