"""Sets of strings held as arrays, against plain Python; the lexicon and rule operators built on them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moodlens.functions import text as T
from moodlens.lexicons import Rule, RuleSet
from moodlens.operators import strings
from moodlens.operators.patterns import contains_counts, rule_hits, tag_posts_by_table
from moodlens.operators.rules import rules_frame, tag_posts
from moodlens.operators.strings import HeldOnce, Runs, Strings
from moodlens.plans import registry
from moodlens.schemas import POST, RULE
from tests.conftest import post


def words(n, letters="abé'", most=6, seed=1):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(1, most))).encode() for _ in range(n)})


def test_strings_are_found_as_a_whole_and_within_tokens(monkeypatch):
    known, parts = words(60), [b"", b"zz", *words(400, most=12, seed=2)]
    for base in (strings.BASE, np.uint64(1)):  # 1: a hash is the sum of its bytes, so many are equal
        monkeypatch.setattr(strings, "BASE", base)
        held = Strings(pa.array(known, pa.binary()), within=True)
        sizes, found = held.held(pa.array(parts, pa.binary()))
        ends = np.cumsum(sizes)
        for part, a, b in zip(parts, ends - sizes, ends):
            assert [known[i] for i in found[a:b]] == [w for w in known if w in part]
        assert [None if i < 0 else known[i] for i in held.find(pa.array(parts, pa.binary()))] == [p if p in known else None for p in parts]
    assert Strings(pa.array([], pa.binary()), within=True).held(pa.array(parts, pa.binary()))[0].sum() == 0


def test_texts_have_the_tokens_of_the_text_functions(spark):
    rng = random.Random(3)
    texts = ["", " ", ".", "a", "..a--B  c.", "it's 'Q'", "\x00x\x7f", *("".join(rng.choices("aB9'. -\n_", k=rng.randint(1, 12))) for _ in range(300))]
    rows, codes, parts = strings.tokens(pa.array([t.encode() for t in texts], pa.binary()))
    got = [[] for _ in texts]
    for row, code in zip(rows, codes):
        got[row].append(parts[int(code)].as_py().decode())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokens("t").alias("t"))
    assert got == [r.t for r in df.orderBy("i").collect()]


def test_runs_of_tokens_and_a_cache_that_is_full(monkeypatch):
    monkeypatch.setattr(strings, "AT_ONCE", 5)
    monkeypatch.setattr(strings, "PIECE", 40)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "ab", "c", "x"], k=rng.randint(1, 9))) for _ in range(200)]
    runs = ["a", "a b", "a b a", "b a b a", "ab c", "c", " a", "", "q", "a q"]
    batch = pa.record_batch([pa.array([t.encode() for t in texts], pa.binary()), pa.array(range(len(texts)))], names=["t", "i"])
    index, known = Runs(pa.array([r.encode() for r in runs], pa.binary())), words(20, "abcx", 2)
    once, met, held = HeldOnce(Strings(pa.array(known, pa.binary()), within=True), 2), set(), []
    pieces = list(strings.pieces(batch, "t"))
    assert len(pieces) > 5 and sum(map(len, pieces)) == len(texts)
    for piece in pieces:
        i = piece.column("i").to_pylist()
        met |= {(i[row], runs[run]) for rows, places in index.met(piece.column("t")) for row, run in zip(rows, places)}
        held += [(i[k // len(known)], known[k % len(known)].decode()) for keys in once.in_texts(piece.column("t")) for k in keys.tolist()]
        assert len(once.tokens) <= 5
    assert met == {(i, r) for i, t in enumerate(texts) for r in runs if r.strip() and f" {r} " in f" {t} "}
    assert sorted(held) == sorted((i, w.decode()) for i, t in enumerate(texts) for w in known if any(w.decode() in x for x in t.split()))


def test_a_lexicon_of_600_000_terms_reads_the_texts_once(spark):
    df = spark.createDataFrame([post(str(i), text=f"W{i} x123456 é.w{i * 7}") for i in range(40)] + [post("n", text=None)], POST)
    terms = spark.range(600_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    counts = contains_counts(df, terms)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = {}
    for i in range(40):
        texts = {f"w{i}"[:n] for n in range(2, 9)} | {f"w{i * 7}"[:n] for n in range(2, 9)}
        for t in texts:
            want[t] = want.get(t, 0) + 1
    assert {r.term: r.n_posts for r in counts.where("n_posts > 0").collect()} == want and counts.count() == 600_000


def test_labels_are_not_joined_where_no_rule_is_read(spark, tmp_path):
    spark.createDataFrame([(1, "Ab", "en", "s"), (2, "b ab", None, "s"), (2, "b", "en", "s"), (None, "ab", "en", "s")],
                          "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    posts = registry.posts_d(spark, str(tmp_path))
    plan = posts.select("data.text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "quality" not in plan
    key = lambda r: (r.id or "", r.text, [m.id for m in r.matching_rules])
    assert sorted(map(key, posts.select("data.*", "matching_rules").collect())) == [("", "ab", []), ("1", "Ab", ["1"]), ("2", "b", ["3"]), ("2", "b ab", ["3"])]


def test_rules_meet_the_texts_in_arrays(spark):
    """Texts become no rows of runs, and rules hold as the literal ones do."""
    rng = random.Random(5)
    pick = lambda n, items: " ".join(rng.choices(items, k=n))
    some = ["aa", "Bb", "cc", "it's", "dd-ee", "É", "ÉÉ", "😀", "😀😃", "♥️", "no"]
    rows = [post(str(i % 50), text=pick(rng.randint(0, 9), some), lang=rng.choice(["en", "de", None])) for i in range(150)]
    rules = RuleSet(tuple(
        Rule(f"{i:02}", "t", tuple(dict.fromkeys(pick(rng.randint(1, 3), ["aa", "bb", "cc", "it's", "é", "éé", "no"]) for _ in range(2))), "keyword",
             rng.choice(["en", "fr", None]), rng.choice(["cc", "NO", None])) for i in range(25)) + (Rule("90", "e", ("😀😃", "♥️"), "emoji", "de"), Rule("91", "e", ("😃", "😀"), "emoji")))
    df, table = spark.createDataFrame(rows, POST).persist(), rules_frame(spark, rules)
    key = lambda rows: sorted(((r.data.id, r.data.text, r.data.lang or "", [(m.id, m.tag) for m in r.matching_rules]) for r in rows))
    got = key(tag_posts_by_table(df, table).collect())
    assert got == key(tag_posts(df, rules).collect()) and max(len(r[3]) for r in got) > 3
    plan = rule_hits(df, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan.split("Aggregate", 1)[1] for x in ("Generate", "Join"))


def test_what_rules_hold_for_a_text_in_two_languages(spark):
    """A null language and an empty one share a hash; what holds for either row holds."""
    table = spark.createDataFrame([("1", "t", ["aa"], "", None), ("2", "t", ["aa"], None, "bb"), ("3", "t", ["\taa"], None, None), ("4", "t", ["aa  CC"], None, None)], RULE)
    df = spark.createDataFrame([post("1", text="aa", lang=None), post("1", text="aa", lang=""), post("2", text=" aa", lang=None), post("3", text="aa bb.cc", lang=None), post("4", text="Aa..cc", lang=None)], POST)
    assert sorted((r.post_id, [m.id for m in r.matching_rules]) for r in rule_hits(df, table).collect()) == [("1", ["1", "2"]), ("2", ["2", "3"]), ("4", ["2", "4"])]


def test_generated_rules_hash_each_word_once(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "Aa bb aa"), (1, 1, "user", ".x"), (2, 0, "user", None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rules = registry.rule_lexicon(spark, str(tmp_path))
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate explode" in x]
    assert sorted(t for r in rules.collect() for t in r.terms) == ["aa", "aa bb", "bb", "x"]
