"""Substrings and rules as joins, against the literal versions and plain Python."""

import pytest
from pyspark.sql import functions as F

from moodlens.lexicons import Rule, RuleSet, default_lexicon, default_rules
from moodlens.operators import patterns
from moodlens.operators.indicators import indicator_counts
from moodlens.operators.patterns import anchors, contained_terms, contains_counts, rule_hits, tag_posts_by_table
from moodlens.operators.rules import rules_frame, tag_posts
from moodlens.schemas import POST, RULE
from tests.conftest import post

TEXTS = ["I LOVE it", "fav favorite 😀", "thank you so much", "thank  you, all", "thankyou", "you thank", "no love", "♥️ ♥", "😰😔 bad", "", None, "ab", "a", "é", "x😀y 😀😃",
         "love love love", "İstanbul", "thank\nyou", "no 😀", "LOVE'S", "aaaaaa"]


def posts(spark, texts=TEXTS, langs=("en", None, "de")):
    rows = [post(str(i) if i % 5 else None, text=t, lang=lang) for lang in langs for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:4], POST)


def test_contains_counts_equals_the_literal_lexicon(spark):
    df = posts(spark).persist()
    want = {r.indicator: r.n_posts for r in indicator_counts(df, default_lexicon()).collect()}
    terms = spark.createDataFrame([(i,) for _, i, _ in default_lexicon()], "term string")
    assert {r.term: r.n_posts for r in contains_counts(df, terms).collect()} == want


def test_contains_counts_of_short_long_and_odd_terms(spark):
    lexicon = ["a", "ab", "aaa", "aaaaaaa", "é", "i̇s", "x😀y", "😀😃", "zzz", "", None, " ", "a", "\n", "I", "."]
    want = {}
    for t in {x for x in lexicon if x}:
        want[t] = sum(t in text.lower() for text in TEXTS if text is not None)
    df = spark.createDataFrame([post(str(i), text=t) for i, t in enumerate(TEXTS)], POST)
    got = contains_counts(df, spark.createDataFrame([(t,) for t in lexicon], "term string"))
    assert {r.term: r.n_posts for r in got.collect()} == want


def test_terms_are_indexed_once_under_their_rarest_gram(spark):
    terms = spark.createDataFrame([(t,) for t in ("walking", "talking", "king", "ab", "walking")], "term string")
    index = {r.term: (r.n, r.gram) for r in anchors(terms).collect()}
    assert index["ab"] == (2, "ab") and index["king"] == (4, "king") and index["walking"][1] == "walki" and index["talking"][1] == "talki" and len(index) == 4
    assert contained_terms(spark.createDataFrame([], POST), terms).count() == 0
    assert contains_counts(posts(spark), spark.createDataFrame([], "term string")).count() == 0


def rule_sets():
    return {
        "default": default_rules(),
        "phrases": RuleSet((Rule("1", "p", ("thank you so", "Thank You", "love love"), "keyword", None), Rule("2", "n", ("you", "bad"), "keyword", "de", "thank"),
                            Rule("3", "e", ("😀😃", "♥️"), "emoji", None), Rule("4", "x", ("love's",), "keyword", None, "NO"))),
        "none": RuleSet(),
    }


@pytest.mark.parametrize("name", rule_sets())
def test_rule_join_equals_the_literal_rules(spark, name):
    rules, df = rule_sets()[name], posts(spark).persist()
    key = lambda rows: sorted(((r.data.id, r.data.text, r.data.lang, [(m.id, m.tag) for m in r.matching_rules]) for r in rows), key=repr)
    table = rules_frame(spark, rules) if len(rules) else spark.createDataFrame([], RULE)
    assert key(tag_posts_by_table(df, table).collect()) == key(tag_posts(df, rules).collect())


def test_rule_hits_without_posts_or_terms(spark):
    assert rule_hits(spark.createDataFrame([], POST), rules_frame(spark, default_rules())).count() == 0
    odd = spark.createDataFrame([("1", "t", [], None, None), ("2", "t", ["", " "], None, None), ("3", "t", None, None, None)], RULE)
    assert rule_hits(posts(spark), odd).count() == 0


def test_texts_stay_out_of_the_rule_join(spark):
    """The hits' plan has no exchange that carries a text."""
    hits = rule_hits(posts(spark), rules_frame(spark, default_rules())).groupBy("post_id").agg(F.count(F.lit(1)))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("_text" in line for line in joins)


def test_parts_of_a_lexicon_add_up_where_the_texts_are(spark, monkeypatch):
    """Terms within tokens are counted without an exchange of posts, in parts of the lexicon."""
    monkeypatch.setattr(patterns, "HELD_TERMS", 3, raising=False)
    words = ["a", "ab", "aaa", "love", "ov", "you", "é", "zzz", "'s", "thank", "no", "k y"]
    df = spark.createDataFrame([post(str(i), text=t) for i, t in enumerate(TEXTS)] * 2, POST)
    got = contains_counts(df, spark.createDataFrame([(t,) for t in words], "term string"))
    assert {r.term: r.n_posts for r in got.collect()} == {t: 2 * sum(t in text.lower() for text in TEXTS if text is not None) for t in words}
    got = contains_counts(df, spark.createDataFrame([(t,) for t in words[:-1]], "term string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "post_id" in line for line in plan.splitlines()) and "post_id" not in plan


def test_a_rule_table_reads_the_texts_once(spark, monkeypatch):
    rules = rules_frame(spark, rule_sets()["phrases"])
    key = lambda df: sorted((r.post_id or "", r._hash, [tuple(m) for m in r.matching_rules]) for r in df.collect())
    hits = rule_hits(posts(spark), rules)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    monkeypatch.setattr(patterns, "HELD_TERMS", 2, raising=False)
    assert key(rule_hits(posts(spark), rules)) == key(hits) != []
