"""Polarity per window of the posts' own time, with late posts kept apart.

A window is closed when the mark passes its end: the latest post time of the
micro-batches so far, less ``delay``.  A post whose window was closed before its
micro-batch came is late: it is listed in the ``late`` table, by micro-batch, and
in no window, so every post is in exactly one of the two.  (A stateful operator
of Spark drops late rows without a trace.)  Closed windows are written once, by
the micro-batch that closed them; open ones are the running state, two slots of
at most one row per window.  Sums are taken in the map tasks, so an hour that holds
most of a stream is one row per task.

Defined results: a post whose time doesn't parse is listed as late with no
window.  A replayed micro-batch reads the mark and state of the one before it and
replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.functions.polarity import CONTAINS, first_tag, is_negative, is_positive
from moodlens.operators.versions import post_time
from moodlens.streaming.sinks import EPOCH, SLOT, write_epoch, write_latest

WINDOW = "window_start timestamp, window_end timestamp, count_pos bigint, count_neg bigint"


class EventTimeWindows:
    """``batch`` is the ``foreachBatch`` function; ``closed``, ``open`` and ``late`` read the results."""

    def __init__(self, spark: SparkSession, out: str, width: str = "1 hour", delay: str = "1 hour", match: str = CONTAINS):
        self.spark, self.out, self.width, self.delay, self.match = spark, out.rstrip("/"), width, delay, match

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def _before(self, name: str, epoch: int, schema: str) -> DataFrame:
        """What the micro-batch before this one left in a table of two slots."""
        if epoch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(name)).where(F.col(EPOCH) == epoch - 1).drop(EPOCH, SLOT)

    def batch(self, posts: DataFrame, epoch: int) -> None:
        read = posts.select("data", "matching_rules", post_time().alias("at"), first_tag().alias("tag")).persist()
        timed = read.select("*", F.window("at", self.width).alias("w"))  # leaves out rows without a time
        mark = self._before("mark", epoch, "mark timestamp").first()
        before = F.lit(mark.mark if mark else None).cast("timestamp")
        late = F.coalesce(F.col("w.end") <= before, F.lit(False))
        untimed = read.where(F.col("at").isNull()).select("data", "matching_rules", F.lit(None).cast("timestamp").alias("window_start"))
        write_epoch(timed.where(late).select("data", "matching_rules", F.col("w.start").alias("window_start")).unionByName(untimed), self.path("late"), epoch)
        now = timed.agg((F.max("at") - F.expr(f"INTERVAL {self.delay}")).alias("now")).select(F.greatest("now", before).alias("mark"))
        write_latest(now, self.path("mark"), epoch)
        new = (timed.where(~late).groupBy(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))
               .agg(F.count_if(is_positive(self.match, F.col("tag"))).alias("count_pos"), F.count_if(is_negative(self.match, F.col("tag"))).alias("count_neg")))
        held = self._before("open", epoch, WINDOW).unionByName(new)
        sums = held.groupBy("window_start", "window_end").agg(F.sum("count_pos").alias("count_pos"), F.sum("count_neg").alias("count_neg"))
        passed = F.coalesce(F.col("window_end") <= F.lit(now.first().mark), F.lit(False))
        write_epoch(sums.where(passed), self.path("closed"), epoch)
        write_latest(sums.where(~passed), self.path("open"), epoch)
        read.unpersist()

    def _rows(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, {EPOCH} bigint").parquet(self.path(name))

    def closed(self) -> DataFrame:
        return self._rows("closed", WINDOW).drop(EPOCH)

    def open(self) -> DataFrame:
        rows = self._rows("open", WINDOW)
        return rows.join(rows.agg(F.max(EPOCH).alias("_last")), F.col(EPOCH) == F.col("_last")).drop(EPOCH, "_last")

    def late(self) -> DataFrame:
        """``data, matching_rules, window_start, epoch`` of every late post."""
        return self.spark.read.parquet(self.path("late"))
