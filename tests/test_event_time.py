"""Windows in the posts' own time, rules that change during a stream, two streams joined."""

import pytest
from pyspark.sql import functions as F

from moodlens.lexicons import Rule, RuleSet, default_rules
from moodlens.operators.rules import rules_frame
from moodlens.schemas import POST
from moodlens.streaming.event_time import EventTimeWindows
from moodlens.streaming.rule_log import RuleLog
from tests.conftest import post


def at(hours, tag="positive keywords"):
    rows = [post(str(i), tags=[tag], created=h if h is None or isinstance(h, str) else f"2024-01-01T{h:02d}:30:00.000Z") for i, h in enumerate(hours)]
    return rows


def test_every_post_is_in_one_window_or_late(spark, tmp_path):
    job = EventTimeWindows(spark, str(tmp_path / "w"), delay="2 hours")
    run = lambda hours, epoch: job.batch(spark.createDataFrame(at(hours), POST), epoch)
    closed = lambda: {r.window_start.hour: r.count_pos for r in job.closed().collect()}
    run([1, 1, 2], 0)
    assert closed() == {} and {r.window_start.hour: r.count_pos for r in job.open().collect()} == {1: 2, 2: 1}
    run([5, 1, None, "no time"], 1)  # mark 3:30; hour 1 is still open for this micro-batch
    assert closed() == {1: 3, 2: 1} and job.late().count() == 2
    run([2, 3, 9], 2)
    run([2, 3, 9], 2)  # replayed
    assert closed() == {1: 3, 2: 1, 3: 1, 5: 1}
    assert sorted(r.window_start.hour if r.window_start else None for r in job.late().where("window_start is not null").collect()) == [2]
    run([], 3)  # nothing comes: the mark stays
    total = sum(closed().values()) + job.late().count() + sum(r.count_pos for r in job.open().collect())
    assert total == 10 and {r.window_start.hour for r in job.open().collect()} == {9}
    run([4, 10], 4)  # hour 4 ended before the mark of 7:30
    assert job.late().where("window_start is not null").count() == 2


def test_no_posts_at_all(spark, tmp_path):
    job = EventTimeWindows(spark, str(tmp_path / "w"))
    job.batch(spark.createDataFrame([], POST), 0)
    assert job.closed().count() == job.open().count() == job.late().count() == 0


def test_rules_hold_from_their_micro_batch_on_also_when_replayed(spark, tmp_path):
    log, out = RuleLog(spark, str(tmp_path / "log")), str(tmp_path / "out")
    log.add(rules_frame(spark, default_rules()), 0)
    posts = spark.createDataFrame([post("1", text="love 😀"), post("2", text="gloves"), post("3", text=None)], POST)
    tag = log.tagger(out)
    tags = lambda epoch: {r.data.id: [m.id for m in r.matching_rules] for r in spark.read.parquet(f"{out}/epoch={epoch}").collect()}
    tag(posts, 0)
    assert tags(0) == {"1": ["1", "2"], "2": [], "3": []}
    log.delete(spark.createDataFrame([("2",), ("unknown",)], "rule_id string"), 1)
    log.add(rules_frame(spark, RuleSet((Rule("5", "positive keywords", ("gloves",), "keyword"),))), 2)
    for epoch, want in ((0, {"1": ["1", "2"], "2": [], "3": []}), (1, {"1": ["1"], "2": [], "3": []}), (2, {"1": ["1"], "2": ["5"], "3": []})):
        tag(posts, epoch)
        assert tags(epoch) == want
    log.add(rules_frame(spark, RuleSet((Rule("1", "negative keywords", ("gloves",), "keyword"),))), 3)  # replaces rule 1
    assert {r.rule_id: r.tag for r in log.at(3).collect()}["1"] == "negative keywords" and log.at(2).count() == log.at(3).count()


def test_displayed_lines(spark):
    from moodlens.functions.text import displayed

    df = spark.createDataFrame([(1, "a\nb", None)], "`x.y` int, t string, n double")
    assert displayed(df).first().line == "1 | a\nb | NULL"


@pytest.mark.parametrize("wait, seen", [("1 day", {("1", 5), ("2", None), ("3", None), ("4", None)}), ("3 days", {("1", 5), ("2", 7), ("3", None), ("4", None)})])
def test_posts_meet_users_that_come_in_time(spark, wait, seen):
    from moodlens.streaming.analyses import join_user_stream

    t = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    posts = spark.createDataFrame([post("1", "a"), post("2", "b"), post("3", "c"), post("4", None)], POST).withColumn("at", t(5))
    users = spark.createDataFrame([("a", True, 5, "2024-01-05"), ("b", False, 7, "2024-01-07"), ("c", True, 9, "2024-01-04"), (None, True, 1, "2024-01-05")],
                                  "id string, verified boolean, f long, s string")
    users = users.select("id", "verified", F.struct(F.col("f").alias("followers_count")).alias("public_metrics"), F.col("s").cast("timestamp").alias("seen"))
    got = join_user_stream(posts, users, "at", "seen", wait=wait)
    assert {(r.post_id, r.followers) for r in got.collect()} == seen
