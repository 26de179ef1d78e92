import random

from changelens import api
from changelens.operators import diff, review
from changelens.sources import reviews, sinks
from pyspark.sql import functions as F

from .test_diff import files

THREAD = "review_id string, disc_ord long, id string, resolved boolean, file_path string, line int, notes array<struct<author: string, body: string, created_at: string, system: boolean>>"
PATCH = "@@ -10,3 +10,4 @@\n a\n-b\n+c\n+d\n e"


def thread(n, line=11, path="src/a.py", body="why", resolved=False, notes=None):
    return ("r", n, str(n), resolved, path, line, notes or [("u", body, "", False)])


def verify(spark, rows, window=40, path="src/a.py"):
    t = spark.createDataFrame(rows, THREAD)
    return api.verify_review(t, files(spark, (path, PATCH, False)), window)


def test_distances_and_window(spark):
    _, near, summary = verify(spark, [thread(1)])
    assert [x.distance for x in near.orderBy("place").collect()] == [0, 0, 1]
    assert summary.first().threads_with_changes == 1
    assert [x.distance for x in verify(spark, [thread(1)], 0)[1].collect()] == [0, 0]
    assert verify(spark, [thread(1, line=500)])[2].first().threads_without_changes == 1


def test_dedup_replies_and_system_notes(spark):
    notes = [("bot", "s", "", True), ("u", "first", "", False), ("v", "reply", "", False)]
    got, _, summary = verify(spark, [thread(1, notes=notes, resolved=True), thread(2), thread(3), thread(4, path=None), thread(5, notes=[("b", "x", "", True)])])
    rows = {r.disc_ord: r for r in got.collect()}
    assert set(rows) == {1, 2, 4} and not rows[4].located
    assert rows[1].first_comment.body == "first" and [r.body for r in rows[1].replies] == ["reply"]
    s = summary.first()
    assert (s.total_threads, s.resolved, s.unresolved) == (2, 1, 1)


def test_path_suffixes(spark):
    assert verify(spark, [thread(1, path="a.py")])[1].count() == 3
    # a longer thread path is not part of any file's path, so nothing is loaded for it
    assert verify(spark, [thread(1, path="x/src/a.py")])[1].count() == 0
    assert verify(spark, [thread(1, path="x/src/a.py"), thread(2)])[1].where("disc_ord = 1").count() == 3


def test_status_preview(spark):
    rows = [thread(1, body="x" * 200), thread(2, resolved=True), thread(3, notes=[("b", "sys", "", True)])]
    s = review.status(spark.createDataFrame(rows, THREAD)).first()
    assert (s.total_discussions, s.resolved, s.unresolved) == (3, 1, 2)
    assert [len(d.first_comment_preview) for d in s.unresolved_details] == [150, 3]


def test_github_threads(spark):
    rows = [("r", 0, 10, None, "u", "a", "t", "f", 3, None), ("r", 1, 11, 10, "v", None, None, "f", None, 4), ("r", 2, 12, 99, None, "c", "t", "g", None, 4), ("r", 3, 13, 11, "w", "d", "t", "f", 0, 9)]
    raw = spark.createDataFrame(rows, "review_id string, ord long, id long, in_reply_to_id long, login string, body string, created_at string, path string, line int, original_line int")
    got = {t.id: t for t in reviews.github_threads(raw).collect()}
    assert set(got) == {"10", "12", "13"}
    assert [n.body for n in got["10"].notes] == ["a", ""] and got["12"].line == 4 and got["12"].notes[0].author == "unknown" and got["13"].line == 9


def test_gitlab_discussions(spark):
    schema = "review_id string, disc_ord long, id string, note_ord int, author string, body string, created_at string, system boolean, resolvable boolean, resolved boolean, new_path string, old_path string, new_line int, old_line int"
    place = ("", "old.py", None, 7)
    rows = [
        ("r", 0, "a", 0, "u", "x", "", True, False, False, *place), ("r", 1, "b", 0, "u", "hello", "", False, False, False, *place),
        ("r", 2, "c", 0, "s", "changed this line in v2", "", True, False, False, *place), ("r", 2, "c", 1, "u", "fix", "", False, True, True, *place), ("r", 2, "c", 2, "s", "other", "", True, False, False, *place),
    ]
    threads, general = review.split_threads(spark.createDataFrame(rows, schema))
    t = threads.collect()
    assert len(t) == 1 and t[0].file_path == "old.py" and t[0].line == 7 and t[0].resolved and [n.body for n in t[0].notes] == ["changed this line in v2", "fix"]
    assert [g.body for g in general.collect()] == ["hello"]


def test_platform_files_and_urls(spark):
    raw = spark.createDataFrame([("r", 0, "a.py", "added", None, None), ("r", 1, "b.py", "renamed", "@@", "old.py"), ("r", 2, "c", "removed", "", "")], "review_id string, ord long, filename string, status string, patch string, previous_filename string")
    got = reviews.github_files(raw).orderBy("file_ord").collect()
    assert [(g.old_path, g.new_file, g.deleted_file, g.renamed_file, g.patch) for g in got] == [("a.py", True, False, False, ""), ("old.py", False, False, True, "@@"), ("c", False, True, False, "")]
    urls = spark.createDataFrame([("https://h/g/p/-/merge_requests/5",), ("https://github.com/o/r/pull/7/files",), ("https://github.com/o/r/pull/x",), ("https://x",)], "url string")
    got = [(r.platform, r.repository, r.number) for r in review.platform_facts(urls, "https://h").collect()]
    assert got == [("gitlab", "g/p", 5), ("github", "o/r", 7), ("github", "o/r", None), (None, None, None)]


class Status(Exception):
    def __init__(self, status):
        super().__init__(f"status {status} token")
        self.status = status


def test_post_backoff_and_outcomes():
    script, slept = {0: [429, 503], 1: [422], 2: [500] * 9, 3: []}, []

    def post(d):
        if script[d["ord"]]:
            raise Status(script[d["ord"]].pop(0))

    drafts = [{"review_id": "r", "ord": k, "file_path": "f", "body": "b", "new_line": 1, "old_line": None} for k in range(4)]
    got = sinks.post_in_order(drafts, post, lambda m: m.replace("token", "***"), slept.append)
    assert [(o["status"], o["attempts"]) for o in got] == [("posted", 3), ("failed", 1), ("failed", 5), ("posted", 1)]
    assert slept == [0.5, 1.0, 0.25, 0.5, 1.0, 2.0, 4.0] and got[1]["error"] == "status 422 ***"
    assert sinks.is_transient(TimeoutError()) and not sinks.is_transient(ValueError())


def test_post_in_spark_and_validation(spark):
    schema = "review_id string, ord int, file_path string, body string, new_line int, old_line int, old_path string"
    rows = [("r", 1, "f", "b", 3, None, None), ("r", 0, "f", "a", None, 2, None), ("q", 0, "f", "", 1, None, None), ("p", 0, "f", "x", 0, 0, None)]
    outcomes, summary = api.post_comments(spark.createDataFrame(rows, schema), lambda: lambda d: None)
    assert [(o.ord, o.line, o.status) for o in outcomes.orderBy("ord").collect()] == [(0, 2, "posted"), (1, 3, "posted")]
    errors = {s.review_id: s.error for s in summary.collect()}
    assert errors == {"r": None, "q": "comment 0: body is missing", "p": "comment 0: new_line or old_line is needed"}
    many = spark.createDataFrame([("r", i, "f", "b", 1, None, None) for i in range(26)], schema)
    assert review.batch_error(many).first().error == "too many comments: 26"


def test_manifest(spark):
    body = lambda n: "@@ -0,0 +1 @@\n" + "\n".join(["+x"] * n)
    order, stats = api.changed_files(files(spark, ("yarn.lock", body(40), False), ("a.py", body(5), False), ("b.py", body(20), False)))
    assert [r.file_path for r in order.orderBy("place").collect()] == ["b.py", "a.py", "yarn.lock"]
    s = stats.first()
    assert (s.reviewable_files, s.skipped_files, s.total_additions, s.reviewable_additions) == (2, 1, 65, 25)


def test_diff_lines_pages(spark):
    body = "@@ -0,0 +1 @@\n" + "\n".join(["+xxxxxxxxxx"] * 120)
    many = files(spark, *[(f"f{i}.py", body, False) for i in range(10)])
    lines, page = api.diff_lines(many, max_chars=15000)
    status = [p.status for p in page.orderBy("file_ord").collect()]
    assert status[0] == "returned" and "omitted" in status and lines.select("file_path").distinct().count() == status.count("returned")
    lock = files(spark, ("yarn.lock", body, False), ("a.py", body, False))
    assert [p.status for p in api.diff_lines(lock, ["yarn"], max_chars=10)[1].collect()] == ["returned"]
    got = api.diff_lines(lock, None, {"a.py": [5, 500]})[0].collect()
    assert sorted((g.requested, g.new_line, g.exact) for g in got) == [(5, 5, True), (500, 120, False)]


def test_new_file_sections(spark):
    patch = "@@ -0,0 +1,7 @@\n+import os\n+def f():\n+    return 1\n+\n+def g():\n+    y = 2\n+    return y"
    found, _ = api.diff_sections(files(spark, ("a.py", patch, True), ("b.py", patch, False)))
    got = {(s.file_path, s.symbol, s.symbol_type, s.start_line, s.end_line, s.changed_lines) for s in found.where("file_path = 'a.py'").collect()}
    assert got == {("a.py", None, "preamble", 1, 1, 1), ("a.py", "f", "function", 2, 3, 2), ("a.py", "g", "function", 5, 7, 3)}
    assert diff.path_filter(files(spark, ("a.py", patch, True)), []).count() == 1


def test_reply_threads_by_brute_force(spark):
    rng, rows = random.Random(8), []
    for r in range(6):
        ids = list(range(100 * r, 100 * r + rng.randrange(1, 60)))
        for k, i in enumerate(ids):
            reply = rng.choice([None, ids[k - 1] if k else None, rng.choice(ids), 9999, i])
            rows.append((f"r{r}", k // 2, i, reply))  # two of each place in order
    rows += [("chain", k, k, k - 1 if k else None) for k in range(700)] + [("none", 1, None, 3), ("none", 2, 3, None), ("none", 3, 4, 3)]
    want, seen = {}, {}
    for review_id, _, own, reply in sorted(rows, key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2])):
        roots = seen.setdefault(review_id, set())
        joins = reply in roots
        want[(review_id, own)] = reply if joins else own
        if not joins and own is not None:
            roots.add(own)
    df = spark.createDataFrame(rows, "review_id string, ord int, id long, in_reply_to_id long").withColumn("root", F.lit("clash")).repartition(3)
    got = review.reply_threads(df)
    assert {(g.review_id, g.id): g.root for g in got.collect()} == want and "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert review.reply_threads(df.where("ord < 0")).collect() == []


def test_match_paths_by_brute_force(spark):
    rng, part = random.Random(9), ["a", "b", "src", "x.py", "y.py", "main", "lib/util.go", "p"]
    name = lambda: "/".join(rng.choice(part) for _ in range(rng.randrange(1, 5)))
    files = [("r", k, name(), "@@") for k in range(60)] + [("r", 99, "none.py", "")]
    threads = [("r", k, name(), True) for k in range(80)] + [("r", 500, "none.py", True), ("q", 1, "src", True)]
    want = {}
    for review_id, _, path, _ in threads:
        paths = [t[2] for t in threads if t[0] == review_id]
        own = [f for f in files if f[0] == review_id and f[3] and any(p in f[2] for p in paths)]
        like = [f for f in own if f[2] == path or f[2].endswith(path) or path.endswith(f[2])]
        if like:
            want[(review_id, path)] = min(like, key=lambda f: (f[2] != path, f[1]))[1]
    got = review.match_paths(spark.createDataFrame(threads, "review_id string, disc_ord int, file_path string, located boolean"), spark.createDataFrame(files, "review_id string, file_ord int, file_path string, patch string"))
    assert {(g.review_id, g.thread_path): g.file_ord for g in got.collect()} == want
