import json

import pytest
from changelens.operators import index
from changelens.sources import config, repository, reviews, sinks
from changelens.sources.embeddings import model_present
from pyspark.sql import functions as F


def test_config(tmp_path, spark):
    f = tmp_path / "c.toml"
    f.write_text('[gitlab]\nurl = "https://h/"\ntoken = "${T}x"\n')
    p = config.load("gitlab", str(f), env={"T": "abc", "GITLAB_TOKEN": "other"})
    assert (p.url, p.token) == ("https://h", "abcx") and "abcx" not in repr(p) and config.scrub("bad abcx", p) == "bad ***"
    spark.conf.set("changelens.github.token", "s")
    assert config.load("github", spark=spark, env={"GITHUB_TOKEN": "e"}).token == "s"
    spark.conf.unset("changelens.github.token")
    hub = config.load("github", env={"GITHUB_TOKEN": "e", "GITHUB_URL": "https://ghe"})
    assert config.api_base(hub) == "https://ghe/api/v3"
    with pytest.raises(ValueError):
        config.load("github", env={})
    assert config.auto_index({}) and not config.auto_index({"CHANGELENS_AUTO_INDEX": "0"})


def test_review_export(spark, tmp_path):
    data = {"review_id": "r1", "review": {"number": 3}, "files": [{"filename": "a.py", "status": "added", "patch": None, "previous_filename": None}]}
    (tmp_path / "r1.json").write_text(json.dumps(data))
    reviews.register(spark)
    raw = spark.read.format("review_export").load(str(tmp_path))
    files = reviews.github_files(reviews.records(raw, "files", "filename string, status string, patch string, previous_filename string")).collect()
    assert [(f.review_id, f.file_path, f.new_file, f.patch) for f in files] == [("r1", "a.py", True, "")]
    assert reviews.records(raw, "review", "number int").first().number == 3


def test_gitlab_files_fallback_and_versions(spark):
    schema = "review_id string, ord long, new_path string, old_path string, new_file boolean, deleted_file boolean, renamed_file boolean, diff string"
    a = spark.createDataFrame([("r", 0, "", "o.py", None, True, None, None)], schema)
    b = spark.createDataFrame([("r", 0, "x", "x", False, False, False, "d"), ("q", 0, None, None, False, False, False, "d")], schema)
    got = {f.review_id: f for f in reviews.gitlab_files(a, b).collect()}
    assert (got["r"].file_path, got["r"].patch, got["r"].deleted_file) == ("o.py", "", True) and got["q"].file_path == "unknown"
    v = spark.createDataFrame([("r", 1, "b1", "h1", "s1"), ("r", 9, "b9", None, "s9")], "review_id string, id long, base_commit_sha string, head_commit_sha string, start_commit_sha string")
    assert tuple(reviews.latest_versions(v).first())[1:] == (9, "b9", "", "s9")


def test_github_metadata(spark):
    row = ("r", 1, None, None, None, "main", None, "open", None, ["one\ntwo"], "b", "h")
    m = reviews.github_metadata(spark.createDataFrame([row], "review_id string, number int, title string, login string, head_ref string, base_ref string, body string, state string, mergeable_state string, commit_messages array<string>, base_sha string, head_sha string")).first()
    assert (m.title, m.author, m.commits, m.shas.start_sha) == ("", "unknown", ["one"], "b")


def test_index_files(spark, tmp_path):
    path = str(tmp_path / "i")
    sinks.replace_index(spark.createDataFrame([("a",)], "path string"), path)
    sinks.replace_index(spark.createDataFrame([], "path string"), path)
    assert spark.read.parquet(path).count() == 0
    assert sinks.drop_index(spark, path) and not sinks.drop_index(spark, path)


def test_live_keys_sizes_and_models(spark, tmp_path):
    (tmp_path / "x" / "sub").mkdir(parents=True)
    (tmp_path / "x" / "sub" / "f.bin").write_bytes(b"12345")
    assert repository.live_keys(spark, [str(tmp_path), "/none"]).count() == 1
    assert [tuple(r) for r in repository.folder_sizes(spark, str(tmp_path)).collect()] == [("x", 5)]
    got = spark.createDataFrame([("m:latest", "m"), ("m:1", "m:1"), ("n", "m")], "a string, b string").select(model_present(F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [True, True, False]


def test_next_step_and_gates(spark):
    got = index.next_step(index.auto_index(spark.createDataFrame([("fresh",), ("stale",)], "state string"))).collect()
    assert got[0].next is None and not got[0].auto_index and got[1].next and got[1].auto_index
    row = spark.range(1).select(index.is_incremental(F.lit(False), F.lit(True), F.lit("m"), F.lit("m"), F.lit("f")), index.is_incremental(F.lit(False), F.lit(True), F.lit(None).cast("string"), F.lit("m"), F.lit("f"))).first()
    assert tuple(row) == (True, False)


def test_a_killed_and_repeated_task_posts_once(spark, tmp_path):
    from changelens import api

    log, fuse = tmp_path / "posts", tmp_path / "fuse"
    fuse.write_text("x")

    def connect():
        def post(draft):
            import os

            if draft["body"] == "bad":
                raise ValueError("refused with a secret")
            with open(log, "a") as f:
                f.write(f"{draft['review_id']} {draft['ord']}\n")
            if draft["body"] == "kill" and fuse.exists():
                fuse.unlink()
            elif draft["body"] == "last" and not (tmp_path / "again").exists():
                os._exit(1)  # the worker dies before it posts the last of the review
        return post

    schema = "review_id string, ord int, file_path string, body string, new_line int, old_line int, old_path string"
    rows = [("r", 0, "f", "one", 1, None, None), ("r", 1, "f", "kill", 2, None, None), ("r", 2, "f", "bad", 3, None, None), ("r", 3, "f", "one", 1, None, None), ("q", 0, "f", "x", None, 4, None), ("q", 1, "", "none", 1, None, None)]
    last = ("r", 4, "f", "last", 9, None, None)
    drafts = spark.createDataFrame([*rows[:5], last], schema)
    ledger = str(tmp_path / "ledger")
    scrub = lambda m: m.replace("secret", "***")
    with pytest.raises(Exception):
        api.post_comments(drafts, connect, scrub=scrub, ledger=ledger)[0].collect()
    (tmp_path / "again").write_text("x")
    outcomes, summary = api.post_comments(drafts, connect, scrub=scrub, ledger=ledger)
    got = {(o.review_id, o.ord): (o.status, o.error) for o in outcomes.collect()}
    assert got == {("r", 0): ("posted", None), ("r", 1): ("posted", None), ("r", 2): ("failed", "refused with a ***"), ("r", 4): ("posted", None), ("q", 0): ("posted", None)}
    posts = log.read_text().split("\n")[:-1]
    assert sorted(set(posts)) == ["q 0", "r 0", "r 1", "r 4"] and posts.count("r 0") == posts.count("r 1") == posts.count("q 0") == 1
    assert posts.count("r 4") == 2  # died between the call and the ledger, the one gap that is stated
    api.post_comments(drafts, connect, scrub=scrub, ledger=ledger)
    assert log.read_text().split("\n")[:-1] == posts
    assert {s.review_id: (s.posted, s.failed) for s in summary.collect()} == {"r": (3, 1), "q": (1, 0)}
