"""Registered batch queries over the driver's test tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables through
the fixture views (``sources/fixtures.py``); ``oracle_sql.py`` holds the
independent DuckDB statement for the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlens.functions.polarity import first_tag
from moodlens.functions.text import displayed, tokens
from moodlens.lexicons import (
    Rule, RuleSet, POSITIVE_EMOJIS, NEGATIVE_EMOJIS, RULE_EXCLUDE, default_lexicon, default_rules, lexicon_from_lists,
)
from moodlens.operators.indicators import indicator_counts, indicator_quality
from moodlens.operators.join import join_users
from moodlens.operators.patterns import contains_counts, rule_hits, tag_posts_by_table
from moodlens.operators.rules import add_rules, delete_rules, rules_frame, rules_from_frame, tag_posts, tagged_only
from moodlens.operators.topk import merge_states, sample_state, samples
from moodlens.operators.versions import as_of_join, user_versions
from moodlens.plans import analyses as A
from moodlens.session import scratch_path
from moodlens.sources import fixtures as X
from moodlens.sources.compaction import compact, read_compacted
from moodlens.sources.files import (
    authors_to_fetch, land_posts, quarantine_report, read_posts, read_posts_with_quarantine,
    read_user_envelopes, read_users, register_views,
)

# ---- FIXED VALUES: test lexicon for fixture D (the original lexicon has
# almost no hits in the invented prose); "ster" is repeated on purpose -------
FIXTURE_POSITIVE = ["love", "best", "great", "tion", "elated"]
FIXTURE_NEGATIVE = ["hate", "stupid", "bad", "ster", "ster"]
# ---- end of fixed values ----------------------------------------------------

FIXTURE_LEXICON = lexicon_from_lists(FIXTURE_POSITIVE, FIXTURE_NEGATIVE)


def fixture_rules() -> RuleSet:
    """Rules for fixture D: the test words as keyword rules, the real emojis."""
    return RuleSet((
        Rule("1", "positive keywords", tuple(FIXTURE_POSITIVE), "keyword", exclude=RULE_EXCLUDE),
        Rule("2", "positive emojis", tuple(POSITIVE_EMOJIS), "emoji"),
        Rule("3", "negative keywords", tuple(dict.fromkeys(FIXTURE_NEGATIVE)), "keyword", exclude=RULE_EXCLUDE),
        Rule("4", "negative emojis", tuple(NEGATIVE_EMOJIS), "emoji"),
    ))


def admin_rules() -> RuleSet:
    """Rule administration: delete rule 3, add rule 5 (no exclusion word)."""
    return fixture_rules().delete("3").add(
        Rule("5", "negative keywords", ("hate", "stupid", "bad", "ster", "terrible"), "keyword"))


def _tables(spark, sf_dir, *names):
    return X.load_tables(spark, sf_dir, names)


def posts_e(spark, sf_dir) -> DataFrame:
    return X.posts_from_events(_tables(spark, sf_dir, "events")["events"])


def users_e(spark, sf_dir) -> DataFrame:
    t = _tables(spark, sf_dir, "customer", "orders")
    return X.users_from_customers(t["customer"], t["orders"])


def posts_o(spark, sf_dir) -> DataFrame:
    return X.posts_from_orders(_tables(spark, sf_dir, "orders")["orders"])


def posts_d(spark, sf_dir) -> DataFrame:
    t = _tables(spark, sf_dir, "documents", "labels")
    return X.posts_from_documents(t["documents"], t["labels"])


def _flat_posts(posts: DataFrame) -> DataFrame:
    return posts.select(F.col("data.id").alias("post_id"), F.col("data.author_id").alias("author_id"),
                        F.col("data.created_at").alias("created_at"), F.col("data.text").alias("text"),
                        first_tag().alias("first_tag"))


def _tag_report(posts: DataFrame) -> DataFrame:
    return tagged_only(posts).select(F.col("data.id").alias("post_id"),
                                     F.size("matching_rules").alias("n_rules"),
                                     first_tag().alias("first_tag"))


def _rounded(means: DataFrame, column: str = "avg_followers") -> DataFrame:
    """For the comparison alone: the order of a floating-point sum doesn't show."""
    return means.withColumn(column, F.round(column, 6))


# ----------------------------------------------------------------- queries --
def q_polarity_totals(spark, sf_dir):
    return A.polarity_totals(posts_e(spark, sf_dir))


def q_hourly_polarity(spark, sf_dir):
    return A.hourly_polarity(posts_e(spark, sf_dir))


def q_post_user_join(spark, sf_dir):
    return A.post_user_table(join_users(posts_e(spark, sf_dir), users_e(spark, sf_dir), dedupe=False))


def q_account_age_split(spark, sf_dir):
    return A.account_age_split(posts_e(spark, sf_dir), users_e(spark, sf_dir), cutoff=X.FIXTURE_E_CUTOFF, dedupe=False)


def q_verified_counts(spark, sf_dir):
    return A.verified_counts(posts_e(spark, sf_dir), users_e(spark, sf_dir), dedupe=False)


def q_followers_mean(spark, sf_dir):
    return A.followers_mean(posts_e(spark, sf_dir), users_e(spark, sf_dir), dedupe=False)


def q_followers_mean_of_means(spark, sf_dir):
    return _rounded(A.followers_mean_of_means(posts_e(spark, sf_dir), users_e(spark, sf_dir), dedupe=False))


def q_activity_split(spark, sf_dir):
    return A.activity_split(posts_o(spark, sf_dir))


def q_activity_groups(spark, sf_dir):
    return A.activity_groups(posts_o(spark, sf_dir))


def q_indicator_counts(spark, sf_dir):
    # counts use every post whatever its tag, so the labels are not read
    docs = _tables(spark, sf_dir, "documents")["documents"]
    return indicator_counts(X.posts_from_documents(docs), FIXTURE_LEXICON)


def event_lexicon() -> list[tuple[int, str, str]]:
    """The real lexicon and, for fixture E, three words that its texts have."""
    lexicon = default_lexicon()
    more = (("purchase", "positive"), ("error", "negative"), ("view", "negative"))
    return lexicon + [(len(lexicon) + i, word, polarity) for i, (word, polarity) in enumerate(more)]


def q_indicator_counts_joined(spark, sf_dir):
    """The original's shape: indicators over posts ⋈ users (fixture E, real lexicon + event words)."""
    posts = X.posts_from_events(_tables(spark, sf_dir, "events")["events"], only=("author_id", "text"))
    return indicator_counts(posts, event_lexicon(), users=users_e(spark, sf_dir))


def q_indicator_quality(spark, sf_dir):
    t = _tables(spark, sf_dir, "documents", "labels")
    return indicator_quality(X.posts_from_documents(t["documents"]), FIXTURE_LEXICON, rules=X.label_rules(t["labels"]))


def q_sample_posts(spark, sf_dir):
    return A.sample_posts(posts_d(spark, sf_dir))


def q_rule_tagging(spark, sf_dir):
    return _tag_report(tag_posts(posts_d(spark, sf_dir), fixture_rules()))


def q_rule_admin(spark, sf_dir):
    return _tag_report(tag_posts(posts_d(spark, sf_dir), admin_rules()))


def branch_posts(spark, sf_dir) -> DataFrame:
    """Fixture E with texts that reach every branch of the stream rules: a
    phrase, an excluded word, emojis (one with a variation selector), two rules
    at once, an emoji of no rule, another language."""
    e = _tables(spark, sf_dir, "events")["events"]
    kind = F.col("event_type")
    text = (F.when(kind == "purchase", F.lit("Well, THANK you all 😀!"))
            .when(kind == "signup", F.lit("I love it, no doubt"))
            .when(kind == "error", F.lit("a bad ♥️ day"))
            .when(kind == "click", F.lit("thankyou, lovely"))
            .when(F.col("value") < 20, F.lit("gloves 💔"))
            .otherwise(F.lit("plain 🎈 text")))
    lang = F.when(F.col("user_id") % 5 == 0, F.lit("fr")).otherwise(F.lit("en"))
    return e.select(*X.post_columns(F.col("event_id"), F.col("user_id"), F.date_format("ts", X.ISO_MILLIS), text, lang, F.array().cast(X.RULES_TYPE)))


def q_rule_branches(spark, sf_dir):
    """The four stream rules over texts that reach each branch."""
    return _tag_report(tag_posts(branch_posts(spark, sf_dir), default_rules()))


def q_rule_tables(spark, sf_dir):
    """Rules kept as a table; rule 2 deleted, a rule for gloves added."""
    rules = rules_frame(spark, default_rules())
    gone = spark.createDataFrame([("2",)], "rule_id string")
    more = rules_frame(spark, RuleSet((Rule("5", "positive keywords", ("gloves",), "keyword", exclude=RULE_EXCLUDE),)))
    return _tag_report(tag_posts(branch_posts(spark, sf_dir), rules_from_frame(add_rules(delete_rules(rules, gone), more))))


def q_rule_join(spark, sf_dir):
    """The rule tables of ``rule_tables``, joined instead of collected."""
    rules = rules_frame(spark, default_rules())
    gone = spark.createDataFrame([("2",)], "rule_id string")
    more = rules_frame(spark, RuleSet((Rule("5", "positive keywords", ("gloves",), "keyword", exclude=RULE_EXCLUDE),)))
    return _tag_report(tag_posts_by_table(branch_posts(spark, sf_dir), add_rules(delete_rules(rules, gone), more)))


#: Rules that ``rule_lexicon`` makes of the conversations' words.
GENERATED_RULES = 1000


def spoken_words(spark, sf_dir) -> DataFrame:
    """Distinct tokens of the conversations: ``term``."""
    spoken = _tables(spark, sf_dir, "conversations")["conversations"]
    return spoken.select(F.explode(tokens("text")).alias("term")).where(F.col("term") != "").distinct()


def rule_lexicon(spark, sf_dir) -> DataFrame:
    """A thousand rules from the conversations: words and two-word openings dealt
    by hash; every third rule for English alone, every second with an excluded word."""
    spoken = _tables(spark, sf_dir, "conversations")["conversations"].select(tokens("text").alias("t"))
    phrases = (spoken.where((F.get("t", F.lit(0)) != "") & (F.coalesce(F.get("t", F.lit(1)), F.lit("")) != ""))
               .select(F.concat_ws(" ", F.get("t", F.lit(0)), F.get("t", F.lit(1))).alias("term")).distinct())
    path = scratch_path(spark, "words")  # read twice; Catalyst would leave the distinct out below a maximum
    spoken_words(spark, sf_dir).write.parquet(path)
    words = spark.read.schema("term string").parquet(path)
    dealt = lambda place: F.conv(F.substring(F.md5("term"), place, 6), 16, 10).cast("long") % GENERATED_RULES
    terms = words.unionByName(phrases).groupBy(dealt(1).alias("r")).agg(F.collect_set("term").alias("terms"))
    exclude = words.groupBy(dealt(7).alias("x")).agg(F.max("term").alias("word"))
    return terms.join(exclude, F.col("r") == F.col("x"), "left").select(
        F.lpad(F.col("r").cast("string"), 4, "0").alias("rule_id"),
        F.when(F.col("r") % 4 < 2, F.lit("positive keywords")).otherwise(F.lit("negative keywords")).alias("tag"), "terms",
        F.when(F.col("r") % 3 == 0, F.lit("en")).alias("lang"), F.when(F.col("r") % 2 == 0, F.col("word")).alias("exclude"))


def q_rule_lexicon(spark, sf_dir):
    """A thousand rules from the tables over all documents, as a join."""
    hits = rule_hits(posts_d(spark, sf_dir), rule_lexicon(spark, sf_dir))
    return hits.select("post_id", F.size("matching_rules").alias("n_rules"), first_tag().alias("first_tag"))


def q_large_lexicon(spark, sf_dir):
    """J3 with every word of the conversations as an indicator, over all documents."""
    return contains_counts(posts_d(spark, sf_dir), spoken_words(spark, sf_dir).where(F.length("term") > 1))


def known_users(spark, sf_dir) -> DataFrame:
    """Half of the users of fixture E."""
    return users_e(spark, sf_dir).where(F.col("id").cast("long") % 2 == 0)


def q_known_author_join(spark, sf_dir):
    """J1 where half of the authors are unknown: their posts are dropped."""
    return A.post_user_table(join_users(posts_e(spark, sf_dir), known_users(spark, sf_dir), dedupe=False))


def q_unknown_authors(spark, sf_dir):
    """Authors that still need a look-up."""
    return authors_to_fetch(posts_e(spark, sf_dir), known_users(spark, sf_dir))


def q_users_roundtrip(spark, sf_dir):
    """Users written as JSON lines and read by the fixed schema."""
    path = scratch_path(spark, "users")
    users_e(spark, sf_dir).write.json(path)
    return read_users(spark, path, fmt="json").select("id", "created_at", "verified", F.col("public_metrics.followers_count").alias("followers"))


def q_samples_text(spark, sf_dir):
    """the sampled texts of a polarity as one string."""
    return A.samples_as_text(A.sample_posts(posts_e(spark, sf_dir)))


def q_quarantine_kinds(spark, sf_dir):
    """Per post a good line, a cut one, one without a post id, and ``null``."""
    line = F.to_json(F.struct("data", "matching_rules"))
    anonymous = F.to_json(F.struct(F.struct(F.col("data.text").alias("text")).alias("data")))
    kinds = [line, F.substring(line, 1, F.floor(F.length(line) / 2).cast("int")), anonymous, F.lit("null")]
    path = scratch_path(spark, "quarantine-kinds")
    posts_e(spark, sf_dir).select(F.explode(F.array(*kinds)).alias("value")).write.text(path)
    return quarantine_report(read_posts_with_quarantine(spark, path))


def q_empty_batch(spark, sf_dir):
    """A folder without posts adds nothing and is no error."""
    path = scratch_path(spark, "empty")
    posts = posts_e(spark, sf_dir)
    land_posts(posts.where(F.lit(False)), path, fmt="json")
    return A.polarity_totals(posts.select("data", "matching_rules").unionByName(read_posts(spark, path, fmt="json")))


def q_view_sql(spark, sf_dir):
    """Posts and users as temporary views, joined by SQL."""
    register_views(spark, moodlens_posts=posts_e(spark, sf_dir), moodlens_users=users_e(spark, sf_dir))
    return spark.sql("SELECT u.verified, count(*) AS n_posts FROM moodlens_posts p JOIN moodlens_users u ON u.id = p.data.author_id GROUP BY u.verified")


def repeated_users(spark, sf_dir) -> DataFrame:
    """Fixture E users with further rows for two thirds of the ids: an older and
    verified copy of every third, and a copy of the next third that only has
    more followers."""
    users = users_e(spark, sf_dir)
    third, followers = F.col("id").cast("long") % 3, F.col("public_metrics.followers_count")
    older = users.where(third == 0).select("id", F.lit("1990-01-01").alias("created_at"), F.lit(True).alias("verified"),
                                           F.struct((followers + 5000).alias("followers_count")).alias("public_metrics"))
    more = users.where(third == 1).select("id", "created_at", "verified",
                                          F.struct((F.abs(followers) + 20_000).alias("followers_count")).alias("public_metrics"))
    return users.unionByName(older).unionByName(more)


def q_repeated_users(spark, sf_dir):
    """Age, verified and follower questions over users with repeated ids: all
    three see the same row of a user.  ``question, label, value``."""
    posts, users = posts_e(spark, sf_dir), repeated_users(spark, sf_dir)
    age = A.account_age_split(posts, users, cutoff=X.FIXTURE_E_CUTOFF)
    return (age.select(F.lit("age").alias("question"), F.col("description").alias("label"), F.col("n_posts").cast("double").alias("value"))
            .unionByName(A.verified_counts(posts, users).select(
                F.lit("verified").alias("question"), F.col("polarity").alias("label"), F.col("n_posts").cast("double").alias("value")))
            .unionByName(A.followers_mean(posts, users).select(
                F.lit("followers").alias("question"), F.col("polarity").alias("label"), F.col("avg_followers").alias("value"))))


def q_post_user_as_of(spark, sf_dir):
    """Every post with the user row that was valid at its time."""
    t = _tables(spark, sf_dir, "events", "orders")
    posts = t["events"].select(*X.event_post_columns(), F.col("ts").cast("timestamp").alias("ts"))
    joined = as_of_join(posts, user_versions(X.user_snapshots_from_orders(t["orders"])), at=F.col("ts"))
    return A.post_user_table(joined)


def q_author_lookup(spark, sf_dir):
    return authors_to_fetch(posts_e(spark, sf_dir))


def q_user_envelope(spark, sf_dir):
    """Users packed into look-up responses of at most 100 users, written and read back."""
    users = users_e(spark, sf_dir)
    env = (users.groupBy(F.floor(F.col("id").cast("long") / 100).alias("envelope"))
                .agg(F.collect_list(F.struct(*users.columns)).alias("data"))
                .select(F.to_json(F.struct("data")).alias("value")))
    path = scratch_path(spark, "envelopes")
    env.write.text(path)
    return read_user_envelopes(spark, path).select(
        "id", "created_at", "verified", F.col("public_metrics.followers_count").alias("followers"))


def q_corrupt_quarantine(spark, sf_dir):
    """Every post as a JSON line plus a cut-off copy of it; malformed lines
    are quarantined, the rest parsed."""
    posts = posts_e(spark, sf_dir)
    line = F.to_json(F.struct("data", "matching_rules"))
    lines = posts.select(F.inline(F.array(
        F.struct(line.alias("value")),
        F.struct(F.substring(line, 1, F.floor(F.length(line) / 2).cast("int")).alias("value")))))
    path = scratch_path(spark, "quarantine")
    lines.write.text(path)
    return quarantine_report(read_posts_with_quarantine(spark, path))


def q_landing_roundtrip(spark, sf_dir):
    """Land posts as JSON lines by day (rolled at 1000 lines), read back."""
    path = scratch_path(spark, "landing")
    land_posts(posts_e(spark, sf_dir), path, fmt="json", max_records_per_file=1000)
    return _flat_posts(read_posts(spark, path, fmt="json"))


def q_displayed_rows(spark, sf_dir):
    """The lines that the command line prints for indicators and samples."""
    posts = posts_e(spark, sf_dir)
    shown = {"indicator counts": indicator_counts(posts, event_lexicon()), "sample posts": A.sample_posts(posts)}
    lines = [displayed(df).select(F.lit(t).alias("title"), "line") for t, df in shown.items()]
    return lines[0].unionByName(lines[1])


def q_sample_state(spark, sf_dir):
    """O2 in one scan: the samples' state of fixture E, merged from four parts."""
    posts, state = posts_e(spark, sf_dir), None
    for k in range(4):
        part = posts.where(F.pmod(F.col("data.id").cast("long"), F.lit(4)) == k)
        state = merge_states(sample_state(part), state)
    return samples(state)


def q_landing_compacted(spark, sf_dir):
    """Posts landed in many small files, compacted twice (more land between),
    read through the manifest."""
    path = scratch_path(spark, "compacted")
    posts = posts_e(spark, sf_dir)
    late = F.col("data.id").cast("long") % 4 == 0
    land_posts(posts.where(~late), path, max_records_per_file=200)
    compact(spark, path)
    land_posts(posts.where(late), path, max_records_per_file=200)
    compact(spark, path)
    return _flat_posts(read_compacted(spark, path))


QUERIES = {
    "polarity_totals": q_polarity_totals,
    "hourly_polarity": q_hourly_polarity,
    "post_user_join": q_post_user_join,
    "account_age_split": q_account_age_split,
    "verified_counts": q_verified_counts,
    "followers_mean": q_followers_mean,
    "followers_mean_of_means": q_followers_mean_of_means,
    "activity_split": q_activity_split,
    "activity_groups": q_activity_groups,
    "indicator_counts": q_indicator_counts,
    "indicator_counts_joined": q_indicator_counts_joined,
    "indicator_quality": q_indicator_quality,
    "sample_posts": q_sample_posts,
    "displayed_rows": q_displayed_rows,
    "sample_state": q_sample_state,
    "rule_tagging": q_rule_tagging,
    "rule_admin": q_rule_admin,
    "rule_branches": q_rule_branches,
    "rule_tables": q_rule_tables,
    "rule_join": q_rule_join,
    "rule_lexicon": q_rule_lexicon,
    "large_lexicon": q_large_lexicon,
    "known_author_join": q_known_author_join,
    "unknown_authors": q_unknown_authors,
    "users_roundtrip": q_users_roundtrip,
    "samples_text": q_samples_text,
    "quarantine_kinds": q_quarantine_kinds,
    "empty_batch": q_empty_batch,
    "view_sql": q_view_sql,
    "repeated_users": q_repeated_users,
    "post_user_as_of": q_post_user_as_of,
    "author_lookup": q_author_lookup,
    "user_envelope": q_user_envelope,
    "corrupt_quarantine": q_corrupt_quarantine,
    "landing_roundtrip": q_landing_roundtrip,
    "landing_compacted": q_landing_compacted,
}
