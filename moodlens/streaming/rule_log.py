"""Rules that change while a stream runs.

A rule log is a table of changes, each with the micro-batch from which on it
holds.  A micro-batch is tagged by the rules of its own number: the latest change
of each rule that holds by then.  A change names a later micro-batch than those
that have run, so one that is replayed, also after a restart, meets the rules that
it met before.

Defined results: of several changes of a rule for one micro-batch the one logged
last counts (``logged``, the time of logging, then deletion).  Deleting an unknown
rule changes nothing; adding a known one replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlens.operators.patterns import tag_posts_by_table
from moodlens.schemas import RULE
from moodlens.streaming.sinks import write_epoch

LOG = T.StructType([T.StructField("from_epoch", T.LongType()), T.StructField("logged", T.TimestampType()), T.StructField("deleted", T.BooleanType()), *RULE.fields])


class RuleLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rules: DataFrame, from_epoch: int) -> None:
        """Rules (RULE shape) that hold from a micro-batch on."""
        self._log(rules.select(*RULE.names), from_epoch, False)

    def delete(self, ids: DataFrame, from_epoch: int) -> None:
        """Rule ids (first column) that no longer hold from a micro-batch on."""
        gone = ids.select(F.col(ids.columns[0]).cast("string").alias("rule_id"))
        self._log(gone.select("rule_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RULE.fields if f.name != "rule_id"]), from_epoch, True)

    def _log(self, rows: DataFrame, from_epoch: int, deleted: bool) -> None:
        (rows.select(F.lit(int(from_epoch)).cast("long").alias("from_epoch"), F.current_timestamp().alias("logged"), F.lit(deleted).alias("deleted"), *RULE.names)
         .write.mode("append").parquet(self.path))

    def at(self, epoch: int) -> DataFrame:
        """The rules of a micro-batch (RULE shape)."""
        changes = self.spark.read.schema(LOG).parquet(self.path).where(F.col("from_epoch") <= int(epoch))
        newest = Window.partitionBy("rule_id").orderBy(F.desc("from_epoch"), F.desc("logged"), F.desc("deleted"))
        return changes.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") == 1) & ~F.col("deleted")).select(*RULE.names)

    def tagger(self, out: str) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: posts tagged by the rules of their micro-batch, one folder per epoch."""
        def batch(posts: DataFrame, epoch: int) -> None:
            write_epoch(tag_posts_by_table(posts.select("data", "matching_rules"), self.at(epoch)), out, epoch)
        return batch
