"""Rule-based tagging of posts (what the stream service did remotely).

A keyword rule holds when any of its terms occurs as a whole token (or, for
multi-word terms such as "thank you", as a token sequence), the post language
equals the rule language, and the excluded word does not occur as a token.
An emoji rule holds when any emoji occurs as a substring.  All rules that
hold are attached in rule order as ``matching_rules[{id, tag}]``; the first
one decides the polarity downstream.

Rules are a driver-side constant (a handful of literals), so the tagging is a
single narrow projection: no join, no shuffle, whole texts.  Exact shortcuts
keep the per-row work down: the language test runs first, tokens are only
built for posts in a rule language, and emoji scans are skipped for pure
ASCII texts (every emoji is non-ASCII).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.functions.polarity import rule_matches
from moodlens.functions.text import has_non_ascii, token_text, tokens
from moodlens.lexicons import Rule, RuleSet
from moodlens.schemas import RULE

TOKENS = "_tokens"
TOKEN_TEXT = "_token_text"


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def rule_condition(rule: Rule) -> Column:
    text = F.col("data.text")
    if rule.kind == "emoji":
        cond = _any([F.contains(text, F.lit(t)) for t in rule.terms])
        if rule.terms and all(not t.isascii() for t in rule.terms):
            cond = has_non_ascii(text) & cond
    elif rule.kind == "keyword":
        words = [t.lower() for t in rule.terms if " " not in t.strip()]
        phrases = [" " + " ".join(t.lower().split()) + " " for t in rule.terms if " " in t.strip()]
        conds = []
        if words:
            conds.append(F.arrays_overlap(F.col(TOKENS), F.array(*[F.lit(w) for w in words])))
        conds += [F.contains(F.col(TOKEN_TEXT), F.lit(p)) for p in phrases]
        cond = _any(conds)
        if rule.exclude:
            cond = cond & ~F.array_contains(F.col(TOKENS), F.lit(rule.exclude.lower()))
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    if rule.lang:
        cond = (F.col("data.lang") == F.lit(rule.lang)) & cond
    return F.coalesce(cond, F.lit(False))


def _only_for_langs(rules: list[Rule], value: Column) -> Column:
    """``value`` for posts in a language some rule asks for, else NULL."""
    langs = {r.lang for r in rules}
    if None in langs:
        return value
    return F.when(F.col("data.lang").isin(*sorted(langs)), value)


def tag_posts(posts: DataFrame, rules: RuleSet) -> DataFrame:
    """Replace ``matching_rules`` by the rules of ``rules`` that hold.

    The rule array is produced by a one-row generator per post, so a later
    filter on it (e.g. ``tagged_only``) is evaluated on the computed value
    instead of being pushed below and re-running the text scans.
    """
    keyword = [r for r in rules if r.kind == "keyword"]
    phrases = any(" " in t.strip() for r in keyword for t in r.terms)
    df = posts
    if keyword:
        df = df.withColumn(TOKENS, _only_for_langs(keyword, tokens("data.text")))
        if phrases:
            df = df.withColumn(TOKEN_TEXT, _only_for_langs(keyword, token_text("data.text")))
    rules_col = rule_matches([(rule_condition(r), r.rule_id, r.tag) for r in rules])
    keep = [c for c in df.columns if c not in ("matching_rules", TOKENS, TOKEN_TEXT)]
    return df.select(*keep, F.inline(F.array(F.struct(rules_col.alias("matching_rules")))))


def tagged_only(posts: DataFrame) -> DataFrame:
    """Posts the stream would deliver: at least one rule holds."""
    return posts.where(F.size("matching_rules") > 0)


def rules_frame(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rule set as a small table ``(rule_id, tag, terms, lang, exclude)``."""
    return spark.createDataFrame([r.as_row() for r in rules], RULE)


def rules_from_frame(rules_df: DataFrame) -> RuleSet:
    """The rule set of a rule table, by rule id (a handful of rows, collected).
    A rule is an emoji rule if none of its terms has an ASCII character."""
    return RuleSet(tuple(
        Rule(r.rule_id, r.tag, tuple(r.terms), "emoji" if all(not any(c.isascii() for c in t) for t in r.terms) else "keyword", r.lang, r.exclude)
        for r in rules_df.orderBy("rule_id").collect()))


def add_rules(rules_df: DataFrame, new_rules_df: DataFrame) -> DataFrame:
    return rules_df.unionByName(new_rules_df)


def delete_rules(rules_df: DataFrame, ids_df: DataFrame) -> DataFrame:
    return rules_df.join(ids_df.select(F.col(ids_df.columns[0]).alias("rule_id")), "rule_id", "left_anti")
