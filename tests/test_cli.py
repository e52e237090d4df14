from moodlens.__main__ import main
from moodlens.plans import analyses as A
from moodlens.plans.registry import posts_e, users_e
from moodlens.sources.files import land_posts
from moodlens.lexicons import default_lexicon
from moodlens.schemas import POST
from moodlens.streaming.sinks import latest_epoch
from tests.conftest import SF_SMALL, post


def test_archive_command(spark, tmp_path, capsys):
    posts_dir, users_dir = str(tmp_path / "posts"), str(tmp_path / "users")
    land_posts(posts_e(spark, SF_SMALL), posts_dir, fmt="json")
    users_e(spark, SF_SMALL).write.json(users_dir)
    tables = main(["archive", "--posts", posts_dir, "--users", users_dir, "--cutoff", "1995-07-01"], spark=spark)
    assert "== posts by UTC hour ==" in capsys.readouterr().out
    want = {r.description: r.n_posts for r in A.account_age_split(posts_e(spark, SF_SMALL), users_e(spark, SF_SMALL),
                                                                  cutoff="1995-07-01").collect()}
    got = {r.description: r.n_posts for r in tables["old vs new accounts"].collect()}
    assert got == want


def test_live_command_once(spark, tmp_path, capsys):
    landing, users_dir, out = str(tmp_path / "landing"), str(tmp_path / "users"), str(tmp_path / "out")
    land_posts(posts_e(spark, SF_SMALL), landing, fmt="parquet", max_records_per_file=100)
    users_e(spark, SF_SMALL).write.parquet(users_dir)
    tables = main(["live", "--landing", landing, "--users", users_dir, "--out", out, "--once", "--bytes-per-batch", "200000"], spark=spark)
    assert latest_epoch(spark, f"{out}/observed").first().n_posts == posts_e(spark, SF_SMALL).count()
    assert spark.read.parquet(f"{out}/samples").count() > 0
    assert tables["indicator counts"].count() == len(default_lexicon())
    shown = capsys.readouterr().out
    assert all(f"== {title} ==" in shown for title in tables)


def test_archive_prints_every_indicator_and_whole_texts(spark, tmp_path, capsys):
    posts_dir, long = str(tmp_path / "posts"), "a long text " * 20
    spark.createDataFrame([post("1", text=long, tags=["positive keywords"])], POST).write.json(posts_dir)
    main(["archive", "--posts", posts_dir], spark=spark)
    shown = capsys.readouterr().out
    assert long.strip() in shown and "only showing" not in shown
    assert all(indicator in shown for _, indicator, _ in default_lexicon())
