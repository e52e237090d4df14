"""Posts and users as two streams: posts wait in keyed state for their author.

Authors share ``groups`` keys, by a hash: the state of a key is the user rows of
its authors, as far as they have come, and the posts that wait for the others, in
chunks.  A call of the state store costs far more than a row, and a key needs a
few calls in a micro-batch however many of its authors come: so the calls grow
with the keys, not with the users.  ``groups`` is to be sized so that the users of
a key stay in the hundreds or few thousands.  A post of a known
author goes on at once.  Another is parked, and goes on in the micro-batch in
which its author's row comes.  A post that has waited for ``expiry`` is let go: a
timer hands it over as expired, so parked posts never outlive
``expiry * (1 + 1/GRANULES)`` of the streams' time, and none is lost unseen.

The streams' time is arrival (``arrived``, a timestamp on every row of both),
which is what the watermark follows: a post may be about any time, and nothing is
late unless arrival runs back by more than ``delay``.  State belongs to a
micro-batch: one that is replayed starts from the same state and gives the same
rows.

``salts`` spreads the posts of one author, who may hold a third of a stream, over
that many keys; the few user rows go to all of them.  Of the posts that wait, a
task holds ``CHUNK`` at a time.  A checkpoint belongs to its ``groups``, ``salts``
and ``expiry``, and to this layout of the state (one by author can't be resumed).

Defined results: a post without an author is dropped (it can't have one).  Of
several rows of one user the largest by ``operators.join.USER_ORDER`` counts from
the micro-batch after its arrival on, or within its own for posts that were
waiting.  A user row without id is dropped.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moodlens.operators.join import AUTHOR
from moodlens.schemas import POST

ARRIVED = "arrived"
JOINED, UNKNOWN, EXPIRED = "joined", "unknown", "expired"
#: Timers of a key fire at multiples of a sixteenth of the expiry.
GRANULES = 16
#: Keys that authors share.
GROUPS = 1 << 14
#: Posts in a chunk, and posts of a key that are held outside the state at a time.
CHUNK = 1000
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Rows of the operator are flat: a post travels as JSON text, and so does its state.
USER_STATE = T.StructType([T.StructField("created_at", T.StringType()), T.StructField("verified", T.BooleanType()), T.StructField("followers", T.LongType())])
NUMBER, TEXT = T.StructType([T.StructField("n", T.LongType())]), T.StructType([T.StructField("json", T.StringType())])
#: ``status``; ``waited``: the post was parked before; ``n_posts``: 1, or the
#: posts that a key has parked in a micro-batch (``unknown``: no post in the row).
FLAT = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("waited", T.BooleanType()), T.StructField("n_posts", T.LongType()),
    T.StructField(AUTHOR, T.StringType()), T.StructField("post", T.StringType()), *USER_STATE.fields])
FLAT_ROW, NO_USER = Row(*FLAT.names), [None] * len(USER_STATE)


def _order(user: tuple) -> tuple:
    """A user state as a key in which a null is smallest."""
    return tuple((x is not None, x) for x in user)


class ParkedPosts(StatefulProcessor):
    """State of the authors of a key, as JSON.

    ``users``: author to user row.  ``chunks``: number to ``[until, author, post]`` of
    posts that wait.  ``waiting``: the next number, the timers that are set, and by
    chunk its first ``until``, its size and its authors, so that only chunks that
    hold what is asked for are read.
    """

    def __init__(self, expiry_ms: int):
        self.expiry = expiry_ms
        self.granule = max(1, expiry_ms // GRANULES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getValueState("users", TEXT)
        self.waiting = handle.getValueState("waiting", TEXT)
        self.chunks = handle.getMapState("chunks", NUMBER, TEXT)

    def until(self, arrived_ms: int) -> int:
        """When a post that arrived then is let go: the next granule after its expiry."""
        return -(-(arrived_ms + self.expiry) // self.granule) * self.granule

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        users, waiting = self.load(self.users) or {}, self.load(self.waiting) or {"next": 0, "timers": [], "chunks": {}}
        earlier, came, parked, chunk = waiting["next"], {}, Counter(), []
        for *_, author, arrived_ms, post, created_at, verified, followers in rows:
            known = users.get(author)
            if post is None:
                candidate, best = (created_at, verified, followers), came.get(author, known)
                if best is None or _order(candidate) > _order(best):
                    came[author] = candidate
            elif known is not None:
                yield self.row(JOINED, False, author, post, known)
            else:
                chunk.append([self.until(arrived_ms), author, post])
                parked[author] += 1
                if len(chunk) >= CHUNK:
                    self.park(waiting, chunk)
                    chunk = []
        fresh = {a: u for a, u in came.items() if a not in users}
        if fresh:
            for n in [n for n, (_, _, authors) in waiting["chunks"].items() if not fresh.keys().isdisjoint(authors)]:
                # those of this micro-batch come after the ones that waited already
                for _, author, post in self.take(waiting, n, lambda p: p[1] in fresh):
                    yield self.row(JOINED, int(n) < earlier, author, post, fresh[author])
            for _, author, post in chunk:
                if author in fresh:
                    yield self.row(JOINED, False, author, post, fresh[author])
            chunk = [p for p in chunk if p[1] not in fresh]
        if chunk:
            self.park(waiting, chunk)
        if came:
            self.users.update((json.dumps({**users, **came}),))
        if parked or fresh:
            if not waiting["chunks"]:
                for t in waiting["timers"]:
                    self.handle.deleteTimer(t)
                waiting["timers"] = []
            self.save(waiting)
        for author, n in parked.items():
            if author not in fresh:
                yield self.row(UNKNOWN, False, author, None, None, n)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        waiting, now = self.load(self.waiting), expiredTimerInfo.getExpiryTimeInMs()
        if waiting is None:
            return
        for n in [n for n, (first, *_) in waiting["chunks"].items() if first <= now]:
            for _, author, post in self.take(waiting, n, lambda p: p[0] <= now):
                yield self.row(EXPIRED, True, author, post, None)
        waiting["timers"] = [t for t in waiting["timers"] if t != now]
        self.save(waiting)

    @staticmethod
    def load(state: Any) -> Any:
        found = state.get()
        return None if found is None else json.loads(found[0])

    def save(self, waiting: dict) -> None:
        if waiting["chunks"] or waiting["timers"]:
            self.waiting.update((json.dumps(waiting),))
        else:
            self.waiting.clear()

    def park(self, waiting: dict, posts: list) -> None:
        """Adds a chunk; last chunks that aren't larger go into it, so they stay few and a post moves seldom."""
        for t in {p[0] for p in posts}.difference(waiting["timers"]):
            self.handle.registerTimer(t)
            waiting["timers"].append(t)
        while waiting["chunks"]:
            last = next(reversed(waiting["chunks"]))
            size = waiting["chunks"][last][1]
            if size > len(posts) or size + len(posts) > CHUNK:
                break
            posts = self.take(waiting, last, lambda p: True) + posts
        n, waiting["next"] = waiting["next"], waiting["next"] + 1
        self.put(waiting, str(n), posts)

    def put(self, waiting: dict, n: str, posts: list) -> None:
        self.chunks.updateValue((int(n),), (json.dumps(posts),))
        waiting["chunks"][n] = [min(p[0] for p in posts), len(posts), list(dict.fromkeys(p[1] for p in posts))]

    def take(self, waiting: dict, n: str, wanted: Any) -> list:
        """Takes the wanted posts out of a chunk."""
        posts = json.loads(self.chunks.getValue((int(n),))[0])
        rest = [p for p in posts if not wanted(p)]
        if not rest:
            self.chunks.removeKey((int(n),))
            del waiting["chunks"][n]
        elif len(rest) < len(posts):
            self.put(waiting, n, rest)
        return [p for p in posts if wanted(p)]

    def row(self, status: str, waited: bool, author: str, post: str | None, user: Any, n: int = 1) -> Row:
        return FLAT_ROW(status, waited, n, author, post, *(user or NO_USER))


def join_arriving(posts: DataFrame, users: DataFrame, expiry: str = "14 days", delay: str = "1 minute", salts: int = 4, groups: int = GROUPS) -> DataFrame:
    """The streaming DataFrame (append mode) of ``status``, ``waited``, ``n_posts``,
    ``author_id``, the columns of POST and those of USER but for the id.

    ``posts`` and ``users`` are streams of the POST and USER shapes with a column
    ``arrived``.  The session needs the state store of ``STATE_STORE``.
    """
    milliseconds = posts.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {expiry}) AS ms").first().ms
    none = {f.name: F.lit(None).cast(f.dataType) for f in USER_STATE}
    salt = F.pmod(F.xxhash64("data.id"), F.lit(salts)).cast("int")
    a = (posts.where(F.col("data.author_id").isNotNull())
         .select(F.col("data.author_id").alias(AUTHOR), salt.alias("salt"), ARRIVED, F.to_json(F.struct(*POST.names)).alias("post")).withColumns(none))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    b = users.where(F.col("id").isNotNull()).select(
        F.col("id").alias(AUTHOR), every.alias("salt"), ARRIVED, F.lit(None).cast("string").alias("post"),
        "created_at", "verified", F.col("public_metrics.followers_count").alias("followers"))
    both = (a.unionByName(b).withWatermark(ARRIVED, delay)
            .select(F.pmod(F.xxhash64(AUTHOR), F.lit(groups)).cast("int").alias("group"), "salt", ARRIVED,
                    AUTHOR, F.unix_millis(ARRIVED).alias("arrived_ms"), "post", *USER_STATE.names))
    rows = both.groupBy("group", "salt").transformWithState(ParkedPosts(int(milliseconds)), FLAT, "Append", "EventTime")
    return (rows.withColumn("post", F.from_json("post", POST))
            .select("status", "waited", "n_posts", AUTHOR, *[F.col(f"post.{c}").alias(c) for c in POST.names], "created_at", "verified",
                    F.struct(F.col("followers").alias("followers_count")).alias("public_metrics")))
