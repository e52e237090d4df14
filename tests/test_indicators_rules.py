from pyspark.sql import functions as F

from moodlens.lexicons import RuleSet, Rule, default_lexicon, default_rules
from moodlens.operators.indicators import indicator_counts, indicator_quality
from moodlens.operators.rules import add_rules, delete_rules, rules_frame, tag_posts, tagged_only
from moodlens.functions.polarity import first_tag
from moodlens.schemas import POST, USER
from tests.conftest import post, user


def _counts(df):
    return {(r.position, r.indicator): r.n_posts for r in df.collect()}


def test_substring_hits_and_once_per_post(spark):
    posts = spark.createDataFrame([post("1", text="Glove favorites love love"), post("2", text="nothing")], POST)
    lex = [(0, "love", "positive"), (1, "fav", "positive"), (2, "favorite", "positive"), (3, "hate", "negative")]
    got = _counts(indicator_counts(posts, lex))
    assert got == {(0, "love"): 1, (1, "fav"): 1, (2, "favorite"): 1, (3, "hate"): 0}


def test_heart_variation_selector(spark):
    bare, vs = "♥", "♥️"
    posts = spark.createDataFrame([post("1", text=f"a {vs} b"), post("2", text=f"c {bare} d")], POST)
    got = _counts(indicator_counts(posts, [(0, bare, "positive"), (1, vs, "positive")]))
    assert got == {(0, bare): 2, (1, vs): 1}


def test_wildcards_are_literal(spark):
    posts = spark.createDataFrame([post("1", text="100% sure"), post("2", text="a_b"), post("3", text="ab")], POST)
    got = _counts(indicator_counts(posts, [(0, "%", "positive"), (1, "a_b", "positive")]))
    assert got == {(0, "%"): 1, (1, "a_b"): 1}


def test_duplicate_positions_kept(spark):
    posts = spark.createDataFrame([post("1", text="I am \U0001F630")], POST)
    got = indicator_counts(posts, default_lexicon()).where(F.col("indicator") == "\U0001F630").collect()
    assert sorted(r.position for r in got) == [42, 43] and all(r.n_posts == 1 for r in got)
    assert indicator_counts(posts, default_lexicon()).count() == 62


def test_counts_restricted_to_known_users(spark):
    posts = spark.createDataFrame([post("1", "a", text="love"), post("2", "b", text="love"),
                                   post("3", "a", text="hate")], POST)
    users = spark.createDataFrame([user("a"), user("a")], USER)
    got = _counts(indicator_counts(posts, [(0, "love", "positive"), (1, "hate", "negative")], users=users))
    assert got == {(0, "love"): 1, (1, "hate"): 1}


def test_indicator_quality(spark):
    posts = spark.createDataFrame([post("1", text="love it", tags=["positive keywords"]),
                                   post("2", text="love it not", tags=["negative keywords"]),
                                   post("3", text="love", tags=[])], POST)
    r = {x.indicator: x for x in indicator_quality(posts, [(0, "love", "positive"), (1, "zzz", "positive")]).collect()}
    assert r["love"].hits == 3 and abs(r["love"].share_pos - 1 / 3) < 1e-12
    assert r["zzz"].hits == 0 and r["zzz"].share_pos is None


def _tags(spark, rows, rules=None):
    posts = spark.createDataFrame(rows, POST)
    out = tag_posts(posts, rules or default_rules())
    return {r.pid: (r.n, r.tag) for r in out.select(F.col("data.id").alias("pid"), F.size("matching_rules").alias("n"),
                                                    first_tag().alias("tag")).collect()}


def test_keyword_rules_are_token_based(spark):
    got = _tags(spark, [post("1", text="glove favorites"), post("2", text="I LOVE it"),
                        post("3", text="love it? no."), post("4", text="thank   you!"),
                        post("5", text="love", lang="fr"), post("6", text="stop, that's bad")])
    assert got["1"] == (0, None)
    assert got["2"] == (1, "positive keywords")
    assert got["3"] == (0, None)          # excluded by the word "no"
    assert got["4"] == (1, "positive keywords")
    assert got["5"] == (0, None)          # language
    assert got["6"] == (1, "negative keywords")


def test_emoji_rules_and_rule_order(spark):
    got = _tags(spark, [post("1", text="sad \U0001F622 but love"), post("2", text="♥️"),
                        post("3", text="♥"), post("4", text="no \U0001F600")])
    assert got["1"] == (2, "positive keywords")
    assert got["2"] == (1, "positive emojis")
    assert got["3"] == (0, None)          # bare heart is not in the rule list
    assert got["4"] == (1, "positive emojis")  # emoji rules have no exclusion
    posts = spark.createDataFrame([post("1", text="love"), post("2", text="x")], POST)
    assert tagged_only(tag_posts(posts, default_rules())).count() == 1


def test_rule_admin(spark):
    rs = default_rules().delete("1").add(Rule("9", "positive keywords", ("yay",), "keyword"))
    assert [r.rule_id for r in rs] == ["2", "3", "4", "9"]
    got = _tags(spark, [post("1", text="yay no"), post("2", text="love")], rs)
    assert got == {"1": (1, "positive keywords"), "2": (0, None)}
    df = rules_frame(spark, default_rules())
    extra = rules_frame(spark, RuleSet((Rule("7", "x", ("a",), "keyword"),)))
    ids = spark.createDataFrame([("1",), ("3",)], "id string")
    out = delete_rules(add_rules(df, extra), ids)
    assert sorted(r.rule_id for r in out.collect()) == ["2", "4", "7"]


def test_duplicate_indicators_dedupe_option(spark):
    posts = spark.createDataFrame([post("1", text="\U0001F630")], POST)
    rows = indicator_counts(posts, default_lexicon(), dedupe=True).where(F.col("indicator") == "\U0001F630").collect()
    assert [(r.position, r.n_posts) for r in rows] == [(42, 1)]
    assert indicator_counts(posts, default_lexicon(), dedupe=True).count() == 61
