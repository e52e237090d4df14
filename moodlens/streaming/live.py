"""The live questions, all in one pass per micro-batch.

``KeyedLive`` takes the rows of ``parked.join_arriving``, whose state keeps the
posts of authors that aren't known yet; it reads no user table.  ``Live`` does
without a state store: each micro-batch reads the users as they are now.  Posts whose author isn't
known yet are parked and tried again with the next micro-batch, and their
authors are listed in ``to_fetch``; so a post counts once its author arrives,
however late.  A micro-batch's posts are joined with the users once, and all tables
are made from those rows: a join each would read posts and users again for every
table.  Spark splits a hot author's share of that join at run time.

Running totals live in tables of two slots: a micro-batch reads the slot of the
one before it, adds its own rows, and writes the other slot.  A replayed
micro-batch reads and writes the same slots again, so its rows count once, and
the tables stay as small as their keys.  ``samples`` and ``account_age`` (per
micro-batch, not accumulated) keep one folder per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.functions.polarity import CONTAINS, TAG, first_tag, flag, is_negative, is_positive, tag_col
from moodlens.operators.indicators import indicator_counts
from moodlens.operators.join import AUTHOR, dedupe_users
from moodlens.operators.topk import merge_states, sample_state, samples
from moodlens.plans import analyses as A
from moodlens.sources.files import authors_to_fetch
from moodlens.streaming import analyses as S
from moodlens.streaming.parked import EXPIRED, JOINED, UNKNOWN
from moodlens.streaming.sinks import EPOCH, SLOT, latest_epoch, write_epoch, write_latest

#: Running totals: their keys (all other columns are sums).
TOTALS = {"indicators": ["polarity", "position", "indicator"], "verified": ["polarity"], "observed": [], "followers": [], "expired": ["polarity"]}


class Live:
    """``batch`` is the ``foreachBatch`` function; ``tables`` reads the results."""

    def __init__(self, spark: SparkSession, out: str, users: Callable[[], DataFrame], lexicon, cutoff: str,
                 after: Callable[[dict], object] | None = None):
        self.spark, self.out, self.users = spark, out.rstrip("/"), users
        self.lexicon, self.cutoff, self.after = list(lexicon), cutoff, after

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def before(self, name: str, epoch: int) -> DataFrame | None:
        """What the micro-batch before this one left in a table of two slots."""
        if epoch == 0:
            return None
        return self.spark.read.parquet(self.path(name)).where(F.col(EPOCH) == epoch - 1).drop(EPOCH, SLOT)

    def batch(self, arrived: DataFrame, epoch: int) -> None:
        users = dedupe_users(self.users(), ["created_at", "verified", "public_metrics"])
        arrived = arrived.select("data", "matching_rules")
        parked = self.before("parked", epoch)
        waiting = arrived if parked is None else arrived.unionByName(parked)
        waiting = waiting.where(F.col("data.author_id").isNotNull())
        # posts meet the users once, and are read from there for all tables
        tried = waiting.join(users, F.col("data.author_id") == F.col("id"), "left").persist()
        unknown, joined = tried.where(F.col("id").isNull()).select("data", "matching_rules"), tried.where(F.col("id").isNotNull())
        write_latest(unknown, self.path("parked"), epoch)
        write_latest(authors_to_fetch(unknown), self.path("to_fetch"), epoch)
        sums = {**self.sums(joined), "observed": arrived.agg(F.count(F.lit(1)).alias("n_posts"))}
        for name, rows in sums.items():
            self.add(name, rows, epoch)
        write_epoch(A.sample_posts(joined), self.path("samples"), epoch)
        write_epoch(S.account_age_rows(S.running_account_age(joined, self.cutoff)), self.path("account_age"), epoch)
        tried.unpersist()
        if self.after:
            self.after(self.tables())

    def sums(self, joined: DataFrame) -> dict[str, DataFrame]:
        """What a micro-batch's joined rows add to the running totals."""
        verified = S.running_verified_counts(joined)
        tagged = joined.select("public_metrics", first_tag().alias(TAG))
        weighted = tagged.select("public_metrics", flag(is_positive(CONTAINS, tag_col())).alias("pos"), flag(is_negative(CONTAINS, tag_col())).alias("neg"))
        return {"indicators": indicator_counts(joined, self.lexicon), "verified": polarity_rows(verified, "pos", "neg"),
                "followers": self.with_means(A.follower_sums(weighted, []))}

    def add(self, name: str, rows: DataFrame, epoch: int) -> None:
        keys = TOTALS[name]
        earlier = self.before(name, epoch)
        every = rows if earlier is None else earlier.unionByName(rows)
        sums = [F.sum(c).cast(t).alias(c) for c, t in rows.dtypes if c not in keys]
        write_latest(every.groupBy(*keys).agg(*sums), self.path(name), epoch)

    @staticmethod
    def with_means(sums: DataFrame) -> DataFrame:
        mean = lambda k: F.try_divide(F.col(f"s_{k}").cast("double"), F.col(f"c_{k}").cast("double"))
        return sums.select("*", *[mean(k).alias(f"m_{k}") for k in ("pos", "neg")],
                           *[mean(k).isNotNull().cast("long").alias(f"b_{k}") for k in ("pos", "neg")])

    def total(self, name: str) -> DataFrame:
        return latest_epoch(self.spark, self.path(name))

    def followers(self) -> DataFrame:
        """``polarity, true_mean, mean_of_means, n_batches``: over all posts, and
        the unweighted mean of the means of the micro-batches that had one."""
        share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
        return self.total("followers").select(F.inline(F.array(*[
            F.struct(F.lit(label).alias("polarity"), share(f"s_{k}", f"c_{k}").alias("true_mean"),
                     share(f"m_{k}", f"b_{k}").alias("mean_of_means"), F.col(f"b_{k}").alias("n_batches"))
            for label, k in (("positive", "pos"), ("negative", "neg"))])))

    def per_batch(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name)).withColumnRenamed(EPOCH, "batch_id")

    def tables(self) -> dict[str, DataFrame]:
        """All results so far; samples and account ages of the latest micro-batch."""
        last = lambda name: latest_epoch(self.spark, self.path(name))
        return {"indicator counts": self.total("indicators").orderBy("position"), "verified accounts": self.total("verified"),
                "observed posts": self.total("observed"), "mean followers": self.followers(), "sample posts": last("samples"),
                "old vs new accounts": last("account_age")}


class KeyedLive(Live):
    """The same tables from rows that are joined already (``parked.join_arriving``), and
    ``expired``: posts that were let go, by polarity; ``latest``: the last five posts
    of each polarity so far.  ``samples`` are the last five of a micro-batch."""

    def __init__(self, spark: SparkSession, out: str, lexicon, cutoff: str, after: Callable[[dict], object] | None = None):
        super().__init__(spark, out, lambda: None, lexicon, cutoff, after)

    def batch(self, rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()  # read once for all tables
        joined = rows.where(F.col("status") == JOINED)
        gone = rows.where(F.col("status") == EXPIRED).select(first_tag().alias(TAG), "n_posts")
        unknown = rows.where(F.col("status") == UNKNOWN)
        write_latest(unknown.select(AUTHOR).distinct(), self.path("to_fetch"), epoch)
        sums = {
            **self.sums(joined),
            "observed": rows.where((F.col("status") != EXPIRED) & ~F.col("waited")).agg(F.coalesce(F.sum("n_posts"), F.lit(0)).alias("n_posts")),
            "expired": polarity_rows(gone.agg(F.count_if(is_positive(CONTAINS, tag_col())).alias("pos"), F.count_if(is_negative(CONTAINS, tag_col())).alias("neg")), "pos", "neg"),
        }
        for name, new in sums.items():
            self.add(name, new, epoch)
        state = sample_state(joined, latest=True)  # one scan for the batch's samples and for the running ones
        write_epoch(samples(state), self.path("samples"), epoch)
        write_latest(merge_states(state, self.before("latest", epoch), latest=True), self.path("latest"), epoch)
        write_epoch(S.account_age_rows(S.running_account_age(joined, self.cutoff)), self.path("account_age"), epoch)
        rows.unpersist()
        if self.after:
            self.after(self.tables())

    def tables(self) -> dict[str, DataFrame]:
        return {**super().tables(), "latest posts": samples(self.total("latest")), "expired posts": self.total("expired")}


def polarity_rows(wide: DataFrame, pos: str, neg: str) -> DataFrame:
    return wide.select(F.inline(F.array(F.struct(F.lit("positive").alias("polarity"), F.col(pos).alias("n_posts")),
                                        F.struct(F.lit("negative").alias("polarity"), F.col(neg).alias("n_posts")))))
