"""Command line: ``python -m moodlens archive|live ...``.

``archive`` answers the questions over stored posts (and users, when given)
and prints each result table in full.  ``live`` answers them over a landing
folder until stopped (or once over what is there, ``--once``), prints the
tables after every micro-batch and keeps them below ``--out``.
"""

from __future__ import annotations

import argparse
import sys

from moodlens.functions.text import displayed
from moodlens.lexicons import default_lexicon
from moodlens.operators.indicators import indicator_counts
from moodlens.plans import analyses as A
from moodlens.session import apply_scale_conf, get_spark, input_bytes
from moodlens.sources.files import read_posts, read_users
from moodlens.streaming.sources import BYTES_PER_TRIGGER


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="moodlens", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    a = sub.add_parser("archive", help="analyse stored posts")
    a.add_argument("--posts", required=True, help="post files or folder")
    a.add_argument("--users", help="user files or folder (enables the user questions)")
    a.add_argument("--format", default="json", choices=["json", "parquet"])
    a.add_argument("--cutoff", default=A.ACCOUNT_AGE_CUTOFF, help="account age cut-off (string compare)")

    live = sub.add_parser("live", help="stream over a landing folder")
    live.add_argument("--landing", required=True, help="folder where post files arrive")
    live.add_argument("--users", required=True, help="folder where user files arrive")
    live.add_argument("--park", default="14 days", help="how long a post waits for its author")
    live.add_argument("--out", required=True, help="shared folder for checkpoints and result tables")
    live.add_argument("--format", default="parquet", choices=["json", "parquet"], help="format of landed posts")
    live.add_argument("--users-format", default="parquet", choices=["json", "parquet"])
    live.add_argument("--bytes-per-batch", type=int, default=BYTES_PER_TRIGGER, help="bound of a micro-batch")
    live.add_argument("--trigger", default="5 seconds", help="processing-time trigger interval")
    live.add_argument("--cutoff", default=A.ACCOUNT_AGE_CUTOFF)
    live.add_argument("--once", action="store_true", help="process what is there, then stop")

    p.add_argument("--master", help="Spark master (default: from spark-submit)")
    return p


def archive(spark, args) -> dict:
    apply_scale_conf(spark, input_bytes(spark, *filter(None, (args.posts, args.users))))
    posts = read_posts(spark, args.posts, fmt=args.format)
    tables = {
        "polarity totals": A.polarity_totals(posts),
        "posts by UTC hour": A.hourly_polarity(posts),
        "active vs less active authors": A.activity_split(posts),
        "indicator counts": indicator_counts(posts, default_lexicon()),
        "sample posts": A.sample_posts(posts),
    }
    if args.users:
        users = read_users(spark, args.users, fmt=args.format)
        tables.update({
            "old vs new accounts": A.account_age_split(posts, users, cutoff=args.cutoff),
            "verified accounts": A.verified_counts(posts, users),
            "mean followers": A.followers_mean(posts, users),
        })
    for title, df in tables.items():
        show_all(title, df)
    return tables


def show_all(title: str, df) -> None:
    """Prints every row and whole texts; the tables are bounded (a row per
    hour, group, indicator or sampled post)."""
    print(f"\n== {title} ==\n{' | '.join(df.columns)}")
    for row in displayed(df).collect():
        print(row.line)


def live(spark, args) -> dict:
    """One query over the landing folder answers all questions per micro-batch."""
    from moodlens.schemas import USER
    from moodlens.streaming.live import KeyedLive
    from moodlens.streaming.parked import ARRIVED, STATE_STORE, join_arriving
    from moodlens.streaming.sinks import start
    from moodlens.streaming.sources import LANDED_POST, file_stream

    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    job = KeyedLive(spark, args.out, default_lexicon(), args.cutoff, after=lambda tables: [show_all(k, v) for k, v in tables.items()])
    posts = file_stream(spark, args.landing, LANDED_POST, args.format, ARRIVED, maxBytesPerTrigger=args.bytes_per_batch)
    users = file_stream(spark, args.users, USER, args.users_format, ARRIVED)
    stream = join_arriving(posts, users, expiry=args.park)
    trigger = {"availableNow": True} if args.once else {"processingTime": args.trigger}
    query = start(stream, f"{args.out.rstrip('/')}/_checkpoint", trigger=trigger, foreach_batch=job.batch)
    query.awaitTermination()
    return job.tables()


def main(argv=None, spark=None):
    args = _parser().parse_args(argv)
    spark = spark or get_spark(args.master)
    if args.command == "archive":
        return archive(spark, args)
    return live(spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
