"""Independent DuckDB statements for the registered queries.

Written directly against the driver's tables (flat columns, CASE for the
first tag, FILTER clauses); of the Spark side they share only the lexicon lists.
"""

from __future__ import annotations

from moodlens.lexicons import NEGATIVE_EMOJIS, POSITIVE_EMOJIS, default_lexicon


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PE = """pe AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id,
         CAST(user_id AS VARCHAR) AS author_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at,
         concat_ws(' ', event_type, props) AS text,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive keywords'
              WHEN value >= 100 THEN 'positive emojis'
              WHEN event_type = 'error' THEN 'negative keywords'
              WHEN event_type = 'view' AND value < 20 THEN 'negative emojis' END AS tag
  FROM events)"""

UE = """ue AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS id,
         strftime(f.first_order, '%Y-%m-%d') AS created_at,
         c.c_mktsegment = 'BUILDING' AS verified,
         CAST(floor(c.c_acctbal) AS BIGINT) AS followers
  FROM customer c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
    ON c.c_custkey = f.o_custkey)"""

PO = """po AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS post_id,
         CAST(o_custkey AS VARCHAR) AS author_id,
         CASE WHEN o_orderpriority < '4' THEN 'positive keywords' ELSE 'negative keywords' END AS tag
  FROM orders)"""

PD = """pd AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS post_id, d.text, d.lang,
         CASE WHEN l.quality = 1 THEN 'positive keywords'
              WHEN l.toxic = 1 THEN 'negative keywords' END AS tag
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l
    ON d.doc_id = l.doc_id)"""

FIXTURE_LEX = """lex(position, indicator, polarity) AS (VALUES
  (0, 'love', 'positive'), (1, 'best', 'positive'), (2, 'great', 'positive'),
  (3, 'tion', 'positive'), (4, 'elated', 'positive'), (5, 'hate', 'negative'),
  (6, 'stupid', 'negative'), (7, 'bad', 'negative'), (8, 'ster', 'negative'),
  (9, 'ster', 'negative'))"""


def _pair(label_a: str, col_a: str, label_b: str, col_b: str, src: str) -> str:
    return (f"SELECT {_q(label_a)} AS description, {col_a} AS n_posts, "
            f"{col_a} / NULLIF({col_a} + {col_b}, 0) * 100 AS percentage FROM {src} UNION ALL "
            f"SELECT {_q(label_b)}, {col_b}, {col_b} / NULLIF({col_a} + {col_b}, 0) * 100 FROM {src}")


def _tokens() -> str:
    return "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}'']+'), lambda x: x <> '')"


def _emoji_cond(terms) -> str:
    return "(" + " OR ".join(f"contains(text, {_q(t)})" for t in terms) + ")"


def _kw_cond(words, exclude: str | None) -> str:
    arr = "[" + ", ".join(_q(w) for w in words) + "]"
    cond = f"list_has_any(tok, {arr})"
    if exclude:
        cond += f" AND NOT list_contains(tok, {_q(exclude)})"
    return f"(({cond}) AND lang = 'en')"


def _tag_sql(rules: list[tuple[str, str]]) -> str:
    """rules: [(tag, condition)] in rule order."""
    n_rules = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in rules)
    first = "CASE " + " ".join(f"WHEN {c} THEN {_q(t)}" for t, c in rules) + " END"
    return (f"WITH {PD}, tk AS (SELECT post_id, text, lang, {_tokens()} AS tok FROM pd), "
            f"r AS (SELECT post_id, CAST({n_rules} AS INTEGER) AS n_rules, {first} AS first_tag FROM tk) "
            f"SELECT post_id, n_rules, first_tag FROM r WHERE n_rules > 0")


def _branches(found: dict[str, tuple[int, str]]) -> str:
    """What the rules find in the texts that an event type stands for ('low': views under 20)."""
    kind = "CASE WHEN event_type = 'view' AND value < 20 THEN 'low' WHEN event_type <> 'view' THEN event_type END"
    values = ", ".join(f"('{k}', {n}, '{tag}')" for k, (n, tag) in found.items())
    return (f"WITH f(kind, n_rules, first_tag) AS (VALUES {values}), e AS (SELECT *, {kind} AS kind FROM events) "
            "SELECT CAST(event_id AS VARCHAR) AS post_id, n_rules, first_tag FROM e JOIN f USING (kind) WHERE user_id % 5 <> 0")


def oracle_sql() -> dict[str, str]:
    pos_c, neg_c = "tag LIKE '%positive%'", "tag LIKE '%negative%'"
    pos_p, neg_p = "tag LIKE 'positive%'", "tag LIKE 'negative%'"
    hourly = (f"WITH {PE}, h AS (SELECT substr(created_at, 12, 2) AS hour_utc, "
              f"count(*) FILTER (WHERE {pos_c}) AS count_pos, count(*) FILTER (WHERE {neg_c}) AS count_neg "
              f"FROM pe GROUP BY 1) "
              f"SELECT hour_utc, count_pos, count_neg, count_pos / (count_pos + count_neg) AS pct_pos, "
              f"count_neg / (count_pos + count_neg) AS pct_neg FROM h "
              f"WHERE hour_utc IS NOT NULL AND count_pos > 0 AND count_neg > 0 ORDER BY hour_utc")
    joined_e = f"WITH {PE}, {UE}, j AS (SELECT pe.*, ue.created_at AS user_created_at, ue.verified, ue.followers FROM pe JOIN ue ON ue.id = pe.author_id)"
    activity = (f"WITH {PO}, per AS (SELECT author_id, count(author_id) AS n_all, "
                f"count(author_id) FILTER (WHERE {pos_p}) AS n_pos, count(author_id) FILTER (WHERE {neg_p}) AS n_neg "
                f"FROM po GROUP BY author_id), m AS (SELECT avg(n_all) AS mean_posts FROM per)")
    lex_e = default_lexicon() + [(62, "purchase", "positive"), (63, "error", "negative"), (64, "view", "negative")]
    lex_e_values = ", ".join(f"({p}, {_q(i)}, {_q(pol)})" for p, i, pol in lex_e)
    fixture_pos = ["love", "best", "great", "tion", "elated"]
    fixture_neg = ["hate", "stupid", "bad", "ster"]
    rules_d = [("positive keywords", _kw_cond(fixture_pos, "no")),
               ("positive emojis", f"({_emoji_cond(POSITIVE_EMOJIS)} AND lang = 'en')"),
               ("negative keywords", _kw_cond(fixture_neg, "no")),
               ("negative emojis", f"({_emoji_cond(NEGATIVE_EMOJIS)} AND lang = 'en')")]
    rules_admin = [rules_d[0], rules_d[1], rules_d[3],
                   ("negative keywords", _kw_cond(["hate", "stupid", "bad", "ster", "terrible"], None))]
    return {
        "polarity_totals": (
            f"WITH {PE} SELECT 'positive' AS polarity, count(*) FILTER (WHERE {pos_c}) AS n_posts FROM pe "
            f"UNION ALL SELECT 'negative', count(*) FILTER (WHERE {neg_c}) FROM pe"),
        "hourly_polarity": hourly,
        "post_user_join": f"{joined_e} SELECT post_id, author_id, user_created_at, verified, followers FROM j",
        "account_age_split": (
            f"{joined_e}, c AS (SELECT "
            f"count(post_id) FILTER (WHERE {pos_p} AND user_created_at < '1995-07-01') AS old_pos, "
            f"count(post_id) FILTER (WHERE {neg_p} AND user_created_at < '1995-07-01') AS old_neg, "
            f"count(post_id) FILTER (WHERE {pos_p} AND user_created_at > '1995-07-01') AS new_pos, "
            f"count(post_id) FILTER (WHERE {neg_p} AND user_created_at > '1995-07-01') AS new_neg FROM j) "
            + _pair("older accounts, positive", "old_pos", "older accounts, negative", "old_neg", "c")
            + " UNION ALL "
            + _pair("newer accounts, positive", "new_pos", "newer accounts, negative", "new_neg", "c")),
        "verified_counts": (
            f"{joined_e} SELECT 'positive' AS polarity, count(*) FILTER (WHERE {pos_c} AND verified) AS n_posts FROM j "
            f"UNION ALL SELECT 'negative', count(*) FILTER (WHERE {neg_c} AND verified) FROM j"),
        "followers_mean": (
            f"{joined_e} SELECT 'positive' AS polarity, avg(followers) FILTER (WHERE {pos_c}) AS avg_followers FROM j "
            f"UNION ALL SELECT 'negative', avg(followers) FILTER (WHERE {neg_c}) FROM j"),
        "followers_mean_of_means": (
            f"{joined_e}, m AS (SELECT substr(created_at, 1, 10) AS batch, "
            f"avg(followers) FILTER (WHERE {pos_c}) AS m_pos, avg(followers) FILTER (WHERE {neg_c}) AS m_neg "
            f"FROM j GROUP BY 1) "
            f"SELECT 'positive' AS polarity, round(avg(m_pos), 6) AS avg_followers FROM m "
            f"UNION ALL SELECT 'negative', round(avg(m_neg), 6) FROM m"),
        "activity_split": (
            f"{activity}, w AS (SELECT "
            f"CAST(coalesce(sum(n_pos) FILTER (WHERE n_pos > mean_posts), 0) AS BIGINT) AS act_pos, "
            f"CAST(coalesce(sum(n_neg) FILTER (WHERE n_neg > mean_posts), 0) AS BIGINT) AS act_neg, "
            f"CAST(coalesce(sum(n_pos) FILTER (WHERE n_pos < mean_posts), 0) AS BIGINT) AS less_pos, "
            f"CAST(coalesce(sum(n_neg) FILTER (WHERE n_neg < mean_posts), 0) AS BIGINT) AS less_neg "
            f"FROM per, m) "
            + _pair("active authors, positive", "act_pos", "active authors, negative", "act_neg", "w")
            + " UNION ALL "
            + _pair("less active authors, positive", "less_pos", "less active authors, negative", "less_neg", "w")),
        "activity_groups": (
            f"{activity}, lg AS ("
            f"SELECT 'positive' AS polarity, n_pos AS n, mean_posts FROM per, m WHERE author_id IS NOT NULL "
            f"UNION ALL SELECT 'negative', n_neg, mean_posts FROM per, m WHERE author_id IS NOT NULL) "
            f"SELECT polarity, CASE WHEN n > mean_posts THEN 'active' WHEN n < mean_posts THEN 'less_active' "
            f"ELSE 'at_mean' END AS activity_group, count(*) AS n_authors, CAST(sum(n) AS BIGINT) AS n_posts "
            f"FROM lg WHERE n > 0 GROUP BY 1, 2"),
        "indicator_counts": (
            f"WITH {FIXTURE_LEX} SELECT l.polarity, l.position, l.indicator, count(d.doc_id) AS n_posts "
            f"FROM lex l LEFT JOIN documents d ON contains(lower(d.text), l.indicator) "
            f"GROUP BY l.polarity, l.position, l.indicator"),
        "indicator_counts_joined": (
            f"{joined_e}, lex(position, indicator, polarity) AS (VALUES {lex_e_values}) "
            f"SELECT l.polarity, l.position, l.indicator, count(j.post_id) AS n_posts "
            f"FROM lex l LEFT JOIN j ON contains(lower(j.text), l.indicator) "
            f"GROUP BY l.polarity, l.position, l.indicator"),
        "indicator_quality": (
            f"WITH {PD}, {FIXTURE_LEX}, li AS (SELECT DISTINCT indicator FROM lex) "
            f"SELECT li.indicator, count(d.post_id) AS hits, "
            f"count(d.post_id) FILTER (WHERE d.{pos_c}) / NULLIF(count(d.post_id), 0) AS share_pos, "
            f"count(d.post_id) FILTER (WHERE d.{neg_c}) / NULLIF(count(d.post_id), 0) AS share_neg "
            f"FROM li LEFT JOIN pd d ON contains(lower(d.text), li.indicator) GROUP BY li.indicator"),
        "sample_posts": (
            f"WITH {PD} (SELECT 'positive' AS polarity, post_id, text FROM pd WHERE {pos_c} ORDER BY post_id LIMIT 5) "
            f"UNION ALL (SELECT 'negative' AS polarity, post_id, text FROM pd WHERE {neg_c} ORDER BY post_id LIMIT 5)"),
        "rule_tagging": _tag_sql(rules_d),
        "rule_admin": _tag_sql(rules_admin),
        "rule_branches": _branches({"purchase": (2, "positive keywords"), "error": (2, "positive emojis"), "click": (1, "positive keywords"), "low": (1, "negative emojis")}),
        "rule_tables": _branches({"purchase": (1, "positive keywords"), "error": (1, "negative keywords"), "click": (1, "positive keywords"), "low": (2, "negative emojis")}),
        "rule_join": _branches({"purchase": (1, "positive keywords"), "error": (1, "negative keywords"), "click": (1, "positive keywords"), "low": (2, "negative emojis")}),
        "rule_lexicon": (
            f"WITH c AS (SELECT {_tokens()} AS tok, {_tokens().removeprefix('list_filter(').removesuffix(", lambda x: x <> '')")} AS raw FROM conversations), "
            "w AS (SELECT DISTINCT unnest(tok) AS term FROM c), "
            "ph AS (SELECT DISTINCT raw[1] || ' ' || raw[2] AS term FROM c WHERE raw[1] <> '' AND raw[2] <> ''), "
            "t AS (SELECT term, CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % 1000 AS r FROM (SELECT * FROM w UNION ALL SELECT * FROM ph)), "
            "x AS (SELECT CAST('0x' || substr(md5(term), 7, 6) AS BIGINT) % 1000 AS r, max(term) AS word FROM w GROUP BY 1), "
            f"d AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, lang, {_tokens()} AS tok FROM documents), "
            "dt AS (SELECT DISTINCT post_id, lang, unnest(tok) AS term FROM d), "
            "dp AS (SELECT DISTINCT post_id, lang, unnest(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) AS term FROM d), "
            "h AS (SELECT DISTINCT post_id, r FROM (SELECT * FROM dt UNION ALL SELECT * FROM dp) JOIN t USING (term) WHERE r % 3 <> 0 OR lang = 'en'), "
            "v AS (SELECT DISTINCT post_id, r FROM dt JOIN x ON dt.term = x.word WHERE r % 2 = 0), "
            "k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.post_id = h.post_id AND v.r = h.r)) "
            "SELECT post_id, CAST(count(*) AS INTEGER) AS n_rules, CASE WHEN min(r) % 4 < 2 THEN 'positive keywords' ELSE 'negative keywords' END AS first_tag "
            "FROM k GROUP BY post_id"),
        "large_lexicon": (
            f"WITH w AS (SELECT DISTINCT unnest({_tokens()}) AS term FROM conversations), d AS (SELECT lower(text) AS low FROM documents WHERE text IS NOT NULL) "
            "SELECT w.term, count(d.low) AS n_posts FROM w LEFT JOIN d ON contains(d.low, w.term) WHERE length(w.term) > 1 GROUP BY w.term"),
        "known_author_join": f"{joined_e} SELECT post_id, author_id, user_created_at, verified, followers FROM j WHERE CAST(author_id AS BIGINT) % 2 = 0",
        "unknown_authors": f"WITH {UE} SELECT DISTINCT CAST(user_id AS VARCHAR) AS author_id FROM events "
                           "WHERE user_id IS NOT NULL AND NOT (user_id % 2 = 0 AND CAST(user_id AS VARCHAR) IN (SELECT id FROM ue))",
        "users_roundtrip": f"WITH {UE} SELECT id, created_at, verified, followers FROM ue",
        "samples_text": (
            f"WITH {PE}, s AS ((SELECT 'positive' AS polarity, post_id, text FROM pe WHERE {pos_c} ORDER BY created_at, post_id LIMIT 5) "
            f"UNION ALL (SELECT 'negative', post_id, text FROM pe WHERE {neg_c} ORDER BY created_at, post_id LIMIT 5)) "
            "SELECT polarity, string_agg(text, chr(10) || 'TWEET:' ORDER BY post_id) AS texts FROM s GROUP BY polarity"),
        "quarantine_kinds": (
            "SELECT 'good' AS status, count(*) AS n FROM events UNION ALL SELECT 'malformed', 2 * count(*) FROM events "
            "UNION ALL SELECT 'no_post_id', count(*) FROM events"),  # a cut line and a null one don't parse
        "empty_batch": (
            f"WITH {PE} SELECT 'positive' AS polarity, count(*) FILTER (WHERE {pos_c}) AS n_posts FROM pe "
            f"UNION ALL SELECT 'negative', count(*) FILTER (WHERE {neg_c}) FROM pe"),
        "view_sql": f"{joined_e} SELECT verified, count(*) AS n_posts FROM j GROUP BY verified",
        "repeated_users": (
            f"WITH {PE}, {UE}, every AS (SELECT id, created_at, verified, followers FROM ue "
            "UNION ALL SELECT id, '1990-01-01', true, followers + 5000 FROM ue WHERE CAST(id AS BIGINT) % 3 = 0 "
            "UNION ALL SELECT id, created_at, verified, abs(followers) + 20000 FROM ue WHERE CAST(id AS BIGINT) % 3 = 1), "
            "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, "
            "verified DESC, followers DESC) AS n FROM every) WHERE n = 1), "
            "j AS (SELECT pe.*, one.created_at AS user_created_at, one.verified, one.followers FROM pe JOIN one ON one.id = pe.author_id) "
            + " UNION ALL ".join(
                [f"SELECT 'age' AS question, '{age} accounts, {tag}' AS label, CAST(count(post_id) FILTER (WHERE tag LIKE '{tag}%' "
                 f"AND user_created_at {op} '1995-07-01') AS DOUBLE) AS value FROM j"
                 for age, op in (("older", "<"), ("newer", ">")) for tag in ("positive", "negative")]
                + [f"SELECT 'verified', '{tag}', CAST(count(*) FILTER (WHERE tag LIKE '%{tag}%' AND verified) AS DOUBLE) FROM j "
                   f"UNION ALL SELECT 'followers', '{tag}', avg(followers) FILTER (WHERE tag LIKE '%{tag}%') FROM j"
                   for tag in ("positive", "negative")])),
        "post_user_as_of": (
            "WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS id, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') "
            "+ (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) // 80) AS since, strftime(o_orderdate, '%Y-%m-%d') AS user_created_at, "
            "o_orderpriority < '3' AS verified, CAST(floor(o_totalprice) AS BIGINT) AS followers FROM orders), "
            "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, since ORDER BY user_created_at DESC, verified DESC, followers DESC) AS n "
            "FROM s) WHERE n = 1), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY since) AS first FROM v) WHERE first = 1), "
            "p AS (SELECT CAST(event_id AS VARCHAR) AS post_id, CAST(user_id AS VARCHAR) AS author_id, ts FROM events) "
            "SELECT p.post_id, p.author_id, coalesce(v.user_created_at, f.user_created_at) AS user_created_at, coalesce(v.verified, f.verified) AS verified, "
            "coalesce(v.followers, f.followers) AS followers FROM p ASOF LEFT JOIN v ON p.author_id = v.id AND p.ts >= v.since JOIN f ON f.id = p.author_id"),
        "author_lookup": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS author_id FROM events WHERE user_id IS NOT NULL",
        "user_envelope": f"WITH {UE} SELECT id, created_at, verified, followers FROM ue",
        "corrupt_quarantine": (
            "SELECT 'good' AS status, count(*) AS n FROM events "
            "UNION ALL SELECT 'malformed', count(*) FROM events"),
        "displayed_rows": (
            f"WITH {PE}, lex(position, indicator, polarity) AS (VALUES {lex_e_values}), n AS (SELECT l.polarity, l.position, l.indicator, count(pe.post_id) AS n_posts "
            "FROM lex l LEFT JOIN pe ON contains(lower(pe.text), l.indicator) GROUP BY ALL), "
            f"s AS ((SELECT 'positive' AS polarity, post_id, text FROM pe WHERE {pos_c} ORDER BY created_at, post_id LIMIT 5) "
            f"UNION ALL (SELECT 'negative', post_id, text FROM pe WHERE {neg_c} ORDER BY created_at, post_id LIMIT 5)) "
            "SELECT 'indicator counts' AS title, polarity || ' | ' || position || ' | ' || indicator || ' | ' || n_posts AS line FROM n "
            "UNION ALL SELECT 'sample posts', polarity || ' | ' || post_id || ' | ' || text FROM s"),
        "sample_state": (
            f"WITH {PE} (SELECT 'positive' AS polarity, post_id, text FROM pe WHERE {pos_c} ORDER BY created_at, post_id LIMIT 5) "
            f"UNION ALL (SELECT 'negative', post_id, text FROM pe WHERE {neg_c} ORDER BY created_at, post_id LIMIT 5)"),
        "landing_compacted": f"WITH {PE} SELECT post_id, author_id, created_at, text, tag AS first_tag FROM pe",
        "landing_roundtrip": f"WITH {PE} SELECT post_id, author_id, created_at, text, tag AS first_tag FROM pe",
    }
