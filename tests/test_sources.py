import json
import os

from moodlens.sources.files import (
    authors_to_fetch, land_posts, quarantine_report, quarantine_split, read_posts,
    read_posts_with_quarantine, read_user_envelopes, read_users,
)
from moodlens.schemas import POST, USER
from tests.conftest import post, user


def _post_json(pid, author="a", tag="positive keywords"):
    return json.dumps({"data": {"id": pid, "author_id": author, "created_at": "2021-01-01T10:00:00.000Z",
                                "text": "hi"}, "matching_rules": [{"id": "1", "tag": tag}]})


def test_read_posts_json_with_schema(spark, tmp_path):
    p = tmp_path / "posts.json"
    p.write_text("\n".join([_post_json("1"), _post_json("2", tag="negative emojis")]) + "\n")
    df = read_posts(spark, str(p))
    assert df.schema == POST
    assert sorted(r.data.id for r in df.collect()) == ["1", "2"]


def test_empty_folder_is_empty_frame(spark, tmp_path):
    d = tmp_path / "empty"
    d.mkdir()
    (d / "part-0.json").write_text("")
    assert read_posts(spark, str(d)).count() == 0


def test_envelopes_to_users(spark, tmp_path):
    env = [{"data": [{"id": "1", "created_at": "2018-01-01", "verified": True, "public_metrics": {"followers_count": 5}},
                     {"id": "2", "created_at": "2020-01-01", "verified": False, "public_metrics": {"followers_count": 7}}]},
           {"data": []}]
    p = tmp_path / "users.json"
    p.write_text("\n".join(json.dumps(e) for e in env))
    users = read_user_envelopes(spark, str(p))
    assert users.schema == USER
    assert sorted((r.id, r.public_metrics.followers_count) for r in users.collect()) == [("1", 5), ("2", 7)]


def test_quarantine(spark, tmp_path):
    lines = [_post_json("1"), "", "null", _post_json("2")[:25], _post_json("3") + ",", json.dumps({"data": {}})]
    p = tmp_path / "batch.json"
    p.write_text("\n".join(lines) + "\n")
    raw = read_posts_with_quarantine(spark, str(p))
    good, bad = quarantine_split(raw)
    assert sorted(r.data.id for r in good.collect()) == ["1", "3"]
    report = {r.status: r.n for r in quarantine_report(raw).collect()}
    # blank line skipped; "null" and the cut line are malformed; a trailing
    # comma still parses; an object without data.id has no post id
    assert report == {"good": 2, "malformed": 2, "no_post_id": 1}
    assert bad.count() == 3


def test_landing_round_trip(spark, tmp_path):
    posts = spark.createDataFrame([post(str(i), created=f"2021-01-0{1 + i % 3}T00:00:00.000Z") for i in range(9)], POST)
    out = str(tmp_path / "landing")
    land_posts(posts, out, fmt="json", max_records_per_file=2)
    days = sorted(d for d in os.listdir(out) if d.startswith("ingest_date="))
    assert days == ["ingest_date=2021-01-01", "ingest_date=2021-01-02", "ingest_date=2021-01-03"]
    for day in days:
        for f in os.listdir(os.path.join(out, day)):
            if f.endswith(".json"):  # files are rolled at 2 records
                assert len(open(os.path.join(out, day, f)).read().splitlines()) <= 2
    back = read_posts(spark, out)
    assert sorted(r.data.id for r in back.collect()) == [str(i) for i in range(9)]
    land_posts(posts, str(tmp_path / "pq"), fmt="parquet")
    assert read_posts(spark, str(tmp_path / "pq"), fmt="parquet").count() == 9


def test_authors_to_fetch(spark, tmp_path):
    posts = spark.createDataFrame([post("1", "a"), post("2", "a"), post("3", "b"), post("4", None)], POST)
    assert sorted(r.author_id for r in authors_to_fetch(posts).collect()) == ["a", "b"]
    known = spark.createDataFrame([user("a")], USER)
    assert [r.author_id for r in authors_to_fetch(posts, known).collect()] == ["b"]
    p = tmp_path / "u.json"
    p.write_text(json.dumps({"id": "z", "verified": True}))
    assert read_users(spark, str(p)).first().verified is True


def test_register_views(spark):
    from moodlens.sources.files import register_views
    posts = spark.createDataFrame([post("1", tags=["positive keywords"])], POST)
    register_views(spark, posts_view=posts)
    assert spark.sql("SELECT count(*) AS n FROM posts_view WHERE matching_rules[0].tag LIKE 'positive%'").first().n == 1


def test_drop_malformed_mode(spark, tmp_path):
    p = tmp_path / "b.json"
    p.write_text("\n".join([_post_json("1"), _post_json("2")[:20], _post_json("3")]) + "\n")
    assert sorted(r.data.id for r in read_posts(spark, str(p), mode="DROPMALFORMED").collect()) == ["1", "3"]
