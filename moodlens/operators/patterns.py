"""Substrings and token patterns of large tables.

``contains_counts`` counts the posts that contain each term of a lexicon table of
any size (the literal columns of ``operators.indicators`` are for a fixed list of
some dozens).  A term without a separator lies within a token, so it is
counted in the tasks that read the texts, against a part of the lexicon of bounded
size at a time: neither texts nor hits are shuffled.  Other terms are indexed under one of their n-grams of five code points
(the one that fewest terms of the lexicon share; a shorter term under itself).
The distinct n-grams of a text meet that index, and an exact ``contains`` decides
about the terms that are left, so terms match inside words as before.

``rule_hits`` tags posts by a rule table: in the tasks that read the texts, the distinct
tokens and their runs meet words, phrases and excluded words, and runs of non-ASCII code
points the emojis, all held as arrays (a bounded part of the rules at a
time), and a task hands on one row of rules a post.  Rules are rows, so other rules need no other plan.

Texts are told apart by id and hash; equal rows have equal hits.  Terms and
n-grams travel in exchanges, texts only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlens.functions.polarity import RULES_TYPE, no_rules
from moodlens.functions.text import TOKEN_SPLIT
from moodlens.operators.strings import HeldOnce, RuleIndex, Strings, pieces, received, sent
from moodlens.session import scratch_path

GRAM = 5
#: Terms that are held in memory at a time, as arrays (larger tables take several passes),
#: and tokens of which a task keeps the terms.
HELD_TERMS, CACHED_TOKENS = 4_000_000, 500_000
#: Code points of a text; runs of ASCII.
CODE_POINTS = "(?s)."
ASCII = "[\\x00-\\x7F]+"


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a table in the shared scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE_POINTS), 0)


def _grams(points: Column, n: int) -> Column:
    """Distinct runs of ``n`` elements, joined."""
    places = F.when(F.size(points) >= n, F.sequence(F.lit(0), F.size(points) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat(*[F.get(points, i + j) for j in range(n)])))


def _sized_grams(points: Column, n: int) -> Column:
    return F.transform(_grams(points, n), lambda gram: F.struct(F.lit(n).alias("n"), gram.alias("gram")))


def anchors(terms: DataFrame) -> DataFrame:
    """``term, n, gram``: the n-gram under which each distinct term is indexed."""
    distinct = terms.select("term").where(F.length("term") > 0).distinct()
    sized = distinct.withColumn("n", F.least(F.length("term"), F.lit(GRAM))).withColumn("_p", _points(F.col("term")))
    every = sized.select("term", "n", F.explode(F.when(F.col("n") < GRAM, F.array("term")).otherwise(_grams(F.col("_p"), GRAM))).alias("gram"))
    shared = every.withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    return shared.groupBy("term", "n").agg(F.min(F.struct("sharing", "gram")).alias("a")).select("term", "n", F.col("a.gram").alias("gram"))


def contained_terms(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """``post_id, _hash, term``: the distinct terms contained in each lower-cased
    text, once per (id, text).  Empty terms and null texts have no row."""
    index = anchors(terms)
    texts = posts.select(F.col("data.id").alias("post_id"), F.lower("data.text").alias("_text")).where(F.col("_text").isNotNull())
    texts = texts.withColumn("_hash", F.xxhash64("_text"))
    pointed = texts.select("post_id", "_hash", _points(F.col("_text")).alias("_p"))
    grams = F.concat(*[_sized_grams(F.col("_p"), n) for n in range(1, GRAM + 1)])
    found = pointed.select("post_id", "_hash", F.explode(grams).alias("_g")).select("post_id", "_hash", "_g.*").join(index, ["n", "gram"])
    # bounded by the lexicon: the terms whose n-gram a text holds
    likely = found.groupBy("post_id", "_hash").agg(F.collect_set("term").alias("_terms"))
    one = texts.dropDuplicates(["post_id", "_hash"]).alias("t").join(
        likely.alias("l"), F.col("t.post_id").eqNullSafe(F.col("l.post_id")) & (F.col("t._hash") == F.col("l._hash")))
    held = F.filter(F.col("l._terms"), lambda term: F.contains(F.col("t._text"), term))
    return one.select("t.post_id", "t._hash", F.explode(held).alias("term"))


def _ready(text: Column) -> Column:
    """Bytes that ``strings.tokens`` takes apart: ASCII as it is, texts with other
    characters lower-cased and without separators (the classes of letters are Java's)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(F.regexp_replace(F.lower(text), TOKEN_SPLIT, " ")).cast("binary")


def _slices(table: DataFrame, key: str) -> Iterator[DataFrame]:
    """``table`` dealt by the hash of a column into parts of about ``HELD_TERMS`` rows."""
    n = -(-table.count() // HELD_TERMS)
    return (table.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n))


def _counted_in_tokens(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n_posts`` of terms without a separator: one lies within a token or nowhere.

    The terms of the distinct tokens are looked up (and kept for so many tokens), a
    text's are the union over its tokens, and tasks hand on one count a term.  Terms
    are compared as bytes of UTF-8, like ``contains`` does."""
    words = terms.select("term").toArrow().column(0).combine_chunks().cast(pa.binary())  # HELD_TERMS, about
    shared = texts.sparkSession.sparkContext.broadcast(sent((words, Strings(words, within=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, strings = received(shared.value)
        counts, held = np.zeros(len(words), np.int64), HeldOnce(strings, CACHED_TOKENS)
        for batch in batches:
            for piece in pieces(batch, "text"):
                for found in held.in_texts(piece.column("text")):
                    counts += np.bincount(found % len(words), minlength=len(words))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(at)).cast(pa.string()), pa.array(counts[at])], names=["term", "n_posts"])

    return texts.mapInArrow(run, "term string, n_posts bigint").groupBy("term").agg(F.sum("n_posts").alias("n_posts"))


def contains_counts(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n_posts`` for every distinct term of ``terms``: the posts whose
    lower-cased text contains it (repeated posts count each).

    Terms without a separator are counted where the texts are; the others
    (phrases, emojis) meet the index of :func:`contained_terms`."""
    every = _written(terms.select("term").where(F.length("term") > 0).distinct(), "terms")
    apart = F.col("term").rlike(TOKEN_SPLIT)
    texts = posts.where(F.col("data.text").isNotNull()).select(_ready(F.col("data.text")).alias("text"))
    counted = [_counted_in_tokens(texts, part) for part in _slices(every.where(~apart), "term")]
    spread = every.where(apart)
    if not spread.isEmpty():
        copies = (posts.where(F.col("data.text").isNotNull()).groupBy(F.col("data.id").alias("_id"), F.xxhash64(F.lower("data.text")).alias("_h"))
                  .agg(F.count(F.lit(1)).alias("_n")))
        counted.append(contained_terms(posts, spread).join(copies, F.col("post_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")))
                       .groupBy("term").agg(F.sum("_n").alias("n_posts")))
    if not counted:
        return every.select("term", F.lit(0).cast("long").alias("n_posts"))
    found = reduce(DataFrame.unionByName, counted).select(F.col("term").alias("_t"), F.col("n_posts").alias("_posts"))
    return every.join(found, F.col("term") == F.col("_t"), "left").select("term", F.coalesce("_posts", F.lit(0)).cast("long").alias("n_posts"))


def _rule_terms(rules: DataFrame) -> DataFrame:
    """``rule_id, lang, emoji, size, item``: every term, its elements joined by
    spaces; a rule is an emoji rule if none of its terms has an ASCII character."""
    emoji = ~F.exists("terms", lambda t: t.rlike("[\\x00-\\x7F]"))
    term = rules.where(F.size("terms") > 0).select("rule_id", "lang", emoji.alias("emoji"), F.explode("terms").alias("term"))
    items = F.when(F.col("emoji"), _points(F.col("term"))).otherwise(F.split(F.trim(F.lower("term")), "\\s+"))
    return (term.select("rule_id", "lang", "emoji", F.size(items).alias("size"), F.array_join(items, " ").alias("item"))
            .where((F.col("item") != "") & (F.col("size") > 0)))


def _rule_index(rules: DataFrame) -> DataFrame:
    """``rule_id, lang, emoji, size, item, veto``: what a run of a text can meet,
    the terms and the excluded words (emoji rules have none)."""
    parts = _rule_terms(rules).where(F.col("rule_id").isNotNull() & F.col("emoji").isNotNull())
    vetoes = rules.where(F.col("exclude").isNotNull() & ~F.contains("exclude", F.lit(" "))).select(
        "rule_id", F.lit(None).cast("string").alias("lang"), F.lit(False).alias("emoji"), F.lit(1).alias("size"), F.lower("exclude").alias("item"))
    vetoes = vetoes.join(parts.where("emoji").select("rule_id").distinct(), "rule_id", "left_anti")
    return parts.withColumn("veto", F.lit(False)).unionByName(vetoes.withColumn("veto", F.lit(True))).distinct()


def _places_met(texts: DataFrame, part: DataFrame) -> DataFrame:
    """``post_id, _hash, _held, _vetoed``: places of the rules that have a term, and of
    those that exclude a word, of each text (none, no row), for a part of the rule index."""
    index = RuleIndex(part.select("item", "emoji", "lang", "veto", "place").toArrow())  # HELD_TERMS, about
    shared = texts.sparkSession.sparkContext.broadcast(sent(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared.value)
        held = HeldOnce(index.signs, CACHED_TOKENS)
        for batch in batches:
            for piece in pieces(batch, "_t"):
                yield from index.hits(piece, held)

    # the signs are read only if a rule asks for some
    needed = texts if len(index.signs) else texts.withColumn("_s", F.lit(None).cast("binary"))
    return needed.mapInArrow(run, "post_id string, _hash bigint, _held array<int>, _vetoed array<int>")


def rule_hits(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """``post_id, _hash, matching_rules`` of the posts that some rule of the table
    (RULE shape) holds for, by rule id; once per (id, language, text)."""
    rules = _written(rules.select("rule_id", "tag", "terms", "lang", "exclude"), "rules")
    # one row with all rules by id: hits travel as places in it
    every = _written(rules.where(F.col("rule_id").isNotNull()).select(F.col("rule_id").alias("id"), "tag").dropDuplicates(["id"])
                     .agg(F.array_sort(F.collect_list(F.struct("id", "tag"))).alias("_rules")), "rule-ids")
    places = every.select(F.posexplode("_rules").alias("place", "rule")).select("place", F.col("rule.id").alias("rule_id"))
    index = _written(_rule_index(rules).join(places, "rule_id"), "rule-index")
    base = posts.select(F.col("data.id").alias("post_id"), F.col("data.lang").alias("_lang"), F.col("data.text").alias("_text")).where(F.col("_text").isNotNull())
    signed = F.octet_length("_text") > F.length("_text")
    texts = base.select("post_id", F.xxhash64("_text", F.coalesce("_lang", F.lit(""))).alias("_hash"), "_lang",
                        _ready(F.col("_text")).alias("_t"),
                        F.when(signed, F.regexp_replace("_text", ASCII, " ")).cast("binary").alias("_s"))
    met = [_places_met(texts, part) for part in _slices(index, "item")] or [_places_met(texts, index)]
    in_all = lambda places: F.flatten(F.collect_list(places)).alias(places)
    sets = reduce(DataFrame.unionByName, met).groupBy("post_id", "_hash").agg(in_all("_held"), in_all("_vetoed"))
    left = sets.select("post_id", "_hash", F.sort_array(F.array_except("_held", "_vetoed")).alias("_left")).where(F.size("_left") > 0)
    named = F.transform("_left", lambda i: F.get("_rules", i)).cast(RULES_TYPE)
    # a one-row generator: what is asked of the rules later is asked of the value, not made again
    return left.crossJoin(F.broadcast(every)).select("post_id", "_hash", F.inline(F.array(F.struct(named.alias("matching_rules")))))


def tag_posts_by_table(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """``posts`` with the ``matching_rules`` of a rule table (an empty array where none holds)."""
    hits = rule_hits(posts, rules).select(F.col("post_id").alias("_id"), F.col("_hash").alias("_h"), F.col("matching_rules").alias("_found"))
    text = F.xxhash64("data.text", F.coalesce("data.lang", F.lit("")))
    joined = posts.join(hits, F.col("data.id").eqNullSafe(F.col("_id")) & F.col("data.text").isNotNull() & (text == F.col("_h")), "left")
    kept = [c for c in posts.columns if c != "matching_rules"]
    return joined.select(*kept, F.coalesce("_found", no_rules()).alias("matching_rules"))
