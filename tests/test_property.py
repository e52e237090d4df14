"""Random posts/users against a plain-Python model of the questions."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from moodlens.plans import analyses as A
from moodlens.schemas import POST, USER

TAGS = ["positive keywords", "positive emojis", "negative keywords", "negative emojis", "not positive"]

post_st = st.tuples(
    st.sampled_from(["a", "b", "c", "d", None]),
    st.lists(st.sampled_from(TAGS), max_size=2),
    st.integers(0, 23),
)
user_st = st.tuples(st.sampled_from(["a", "b", "c", "e"]), st.booleans(), st.integers(-5, 1000),
                    st.sampled_from(["2018-06-01", "2019-01-01", "2020-02-02"]))


def _frames(spark, posts, users):
    prow = [((str(i), a, f"2021-01-01T{h:02d}:00:00.000Z", "t", "en"), [(str(j), t) for j, t in enumerate(tags)])
            for i, (a, tags, h) in enumerate(posts)]
    urow = [(u, c, v, (f,)) for u, v, f, c in users]
    return spark.createDataFrame(prow, POST), spark.createDataFrame(urow, USER)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(posts=st.lists(post_st, max_size=25), users=st.lists(user_st, max_size=6))
def test_verified_and_age_match_model(spark, posts, users):
    pdf, udf = _frames(spark, posts, users)
    # model: first user row per id after dedupe = max over (created, verified, followers)
    best = {}
    for u, v, f, c in users:
        key = (c, v, (f,))
        best[u] = max(best.get(u, key), key)
    first = [tags[0] if tags else None for _, tags, _ in posts]
    pos = [t is not None and "positive" in t for t in first]
    neg = [t is not None and "negative" in t for t in first]
    authors = [a for a, _, _ in posts]
    want_v = {"positive": sum(1 for a, p in zip(authors, pos) if p and a in best and best[a][1]),
              "negative": sum(1 for a, n in zip(authors, neg) if n and a in best and best[a][1])}
    got_v = {r.polarity: r.n_posts for r in A.verified_counts(pdf, udf).collect()}
    assert got_v == want_v
    ppos = [t is not None and t.startswith("positive") for t in first]
    old_pos = sum(1 for a, p in zip(authors, ppos) if p and a in best and best[a][0] < "2019-01-01")
    got_a = {r.description: r.n_posts for r in A.account_age_split(pdf, udf).collect()}
    assert got_a[A.OLDER_POSITIVE] == old_pos
    tot = {r.polarity: r.n_posts for r in A.polarity_totals(pdf).collect()}
    assert tot == {"positive": sum(pos), "negative": sum(neg)}


# ---- rule tagging against a plain-Python model ------------------------------
import regex as _re  # noqa: E402

from moodlens.functions.polarity import first_tag  # noqa: E402
from moodlens.lexicons import default_rules  # noqa: E402
from moodlens.operators.rules import tag_posts  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

WORDS = ["love", "Love", "lovely", "glove", "thank", "you", "no", "No", "nope", "hate", "stop", "stop's",
         "bad", "terrible", "fav", "favorite", "x", "42", "café", "😀", "😰", "♥️", "♥", "☹️"]
SEPS = [" ", "  ", ", ", "!", "'", "-", "\n"]


def _model(text: str, lang: str):
    toks = [t for t in _re.split(r"[^\p{L}\p{N}']+", text.lower()) if t]
    joined = " " + " ".join(toks) + " "
    hits = []
    for r in default_rules():
        if r.lang and lang != r.lang:
            continue
        if r.kind == "emoji":
            ok = any(t in text for t in r.terms)
        else:
            ok = any((" " + " ".join(t.lower().split()) + " ") in joined if " " in t else t.lower() in toks
                     for t in r.terms)
            ok = ok and not (r.exclude and r.exclude in toks)
        if ok:
            hits.append(r.tag)
    return len(hits), (hits[0] if hits else None)


text_st = st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SEPS)), max_size=8).map(
    lambda parts: "".join(w + s for w, s in parts))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(text_st, st.sampled_from(["en", "fr"])), min_size=1, max_size=20))
def test_rule_tagging_matches_model(spark, rows):
    data = [((str(i), "a", None, t, lang), []) for i, (t, lang) in enumerate(rows)]
    df = tag_posts(spark.createDataFrame(data, POST), default_rules())
    got = {r.pid: (r.n, r.tag) for r in df.select(F.col("data.id").alias("pid"), F.size("matching_rules").alias("n"),
                                                  first_tag().alias("tag")).collect()}
    want = {str(i): _model(t, lang) for i, (t, lang) in enumerate(rows)}
    assert got == want
