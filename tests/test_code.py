import subprocess

from changelens import api, schemas
from changelens.functions import text as T
from changelens.operators import code, index, registry, search, syntax
from changelens.sources import embeddings, repository
from changelens.streaming import index as stream
from pyspark.sql import functions as F

A = "import os\n\n\ndef helper(x):\n    return x\n\n\nclass K:\n    def run(self):\n        helper(1)\n        self.go(helper(2))\n        return run(3)\n"
B = "from a import helper\n\nz = helper(4)\nfoobar = 1\n"


def sources(spark):
    return spark.createDataFrame([("a.py", A), ("b.py", B)], "path string, content string")


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_impact(spark):
    got = api.dependency_impact(sources(spark), symbols(spark, "helper"))["references"].orderBy("rank").collect()
    assert [(g.path, g.line, g.usage_type, g.enclosing_symbol) for g in got] == [
        ("a.py", 4, "definition", "helper"), ("a.py", 10, "call", "run"), ("a.py", 11, "call", "run"), ("b.py", 1, "import", None), ("b.py", 3, "assignment", None),
    ]
    assert api.dependency_impact(sources(spark), symbols(spark, "foo"))["references"].count() == 0
    assert code.references(code.source_lines(sources(spark)), symbols(spark, "foo"), whole_word=False).count() == 1


def test_caps(spark):
    many = spark.createDataFrame([(f"f{i:02}.py", "x\n" * 9) for i in range(12)], "path string, content string")
    got = code.references(code.source_lines(many), symbols(spark, "x")).collect()
    assert len(got) == 50 and max(g.line for g in got) == 5


def test_trace(spark):
    got = api.trace_call_chain(sources(spark), symbols(spark, "run", "helper"))
    assert {(d.symbol, d.file_path, d.line, d.type) for d in got["definition"].collect()} == {("run", "a.py", 9, "function"), ("helper", "a.py", 4, "function")}
    assert {(c.symbol, c.name) for c in got["callees"].collect()} == {("run", "helper"), ("run", "go")}
    assert {(c.name, c.file_path, c.call_line) for c in got["callers"].where("symbol = 'helper'").collect()} == {("run", "a.py", 10), ("run", "a.py", 11), ("<module>", "b.py", 3)}


def test_chunks_split_and_fall_back(spark):
    big = "class C:\n    a = 1\n" + "".join(f"    def m{i}(self):\n" + "        x = 1\n" * 150 for i in range(3))
    got = syntax.chunk(big, "python")
    assert [(c[0], c[1]) for c in got] == [("C", "class"), ("m0", "function"), ("m1", "function"), ("m2", "function")]
    long = syntax.chunk("def f():\n" + "    y = 22222\n" * 900, "python")
    assert len(long) > 1 and all(len(c[4]) <= 4000 for c in long) and long[0][2] == 1 and long[-1][3] == 901
    assert syntax.chunk("def (", "python") == [(None, "file", 1, 1, "def (")]
    go = spark.createDataFrame([("x.go", "func A() {\n  b()\n}\n\nfunc B() int {\n}\n")], "path string, content string")
    assert [c.symbol for c in syntax.chunks(go).orderBy("start_line").collect()] == ["A", "B"]
    assert [(c[0], c[1]) for c in syntax.chunk("x = 1\n@d\ndef f():\n    pass\n", "python")] == [(None, "preamble"), ("f", "other")]


def test_table_function(spark):
    syntax.register(spark)
    sources(spark).createOrReplaceTempView("src")
    got = spark.sql("SELECT path, c.symbol FROM src, LATERAL chunk_source(content, 'python') c").collect()
    assert ("a.py", "helper") in {tuple(g) for g in got}


def test_languages_and_remotes(spark):
    got = spark.createDataFrame([("a.PY",), ("x/b.tsx",), (".py",), ("c.txt",), ("Makefile",)], "p string").select(T.language(F.col("p"))).collect()
    assert [g[0] for g in got] == ["python", "typescript", None, None, None]
    cases = {"git@Host:Org/R.git": "host/org/r", "https://u@h.com/x/": "h.com/x", "https://h/x.git/": "h/x.git", "ssh://git@h/x": "h/x"}
    df = spark.createDataFrame(list(cases.items()), "u string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", T.normal_remote(F.col("u"))).collect())


def test_repository_scan_and_git(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in (("src/a.py", "def f():\n    pass\n"), ("src/b.txt", "x"), ("node_modules/c.py", "x"), ("src/e.py", " \n"), ("d.go", "func A() {}\n")):
        (tmp_path / name).write_text(body)
    (tmp_path / "src/bad.py").write_bytes(b"x = '\xff'\n")
    assert {r.path: r.language for r in repository.scan(spark, str(tmp_path)).collect()} == {"src/a.py": "python", "d.go": "go", "src/bad.py": "python"}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    run("add", "d.go")
    run("commit", "-m", "x")
    facts = repository.git_facts(spark, str(tmp_path), "0" * 40).first()
    assert facts.is_git and facts.dirty and facts.main_sha == facts.root_sha and not facts.head_present and len(facts.key) == 16
    assert not repository.git_facts(spark, str(tmp_path / "src/none")).first().is_git


def test_delta_stream_equals_rebuild(spark, tmp_path):
    table = str(tmp_path / "t")
    one = spark.createDataFrame([("a.py", A), ("b.py", B), ("c.py", "k = 1\n")], "path string, content string")
    two = spark.createDataFrame([("a.py", A + "# more\n"), ("b.py", B), ("d.py", "def n():\n    pass\n")], "path string, content string")
    stream.refresh(spark, table, one, 0)
    got = stream.refresh(spark, table, two, 1)
    full = syntax.chunks(two)
    key = lambda df: sorted((r.path, r.symbol or "", r.start_line, r.text) for r in df.collect())
    assert key(got) == key(full)
    for n, df in ((1, one), (2, two)):
        closing = spark.createDataFrame([(None, str(df.count()))], "path string, content string")
        df.union(closing).select(F.lit(n).cast("long").alias("snapshot"), "path", "content").write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(stream.SNAPSHOT).parquet(str(tmp_path / "in"))
    stream.follow(src, str(tmp_path / "t2"), str(tmp_path / "cp")).awaitTermination()
    assert key(stream.latest(spark, str(tmp_path / "t2"))) == key(full)


def test_freshness(spark):
    schema = "k string, has_table boolean, has_meta boolean, meta_model string, model string, indexed_sha string, main_sha string, head_sha string, dirty boolean"
    rows = [
        ("absent", False, False, None, "m", None, None, None, False), ("unknown", True, False, None, "m", None, "a", "a", False), ("model_mismatch", True, True, "o", "m", "a", "a", "a", False),
        ("fresh", True, True, "m", "m", "a", "a", "b", True), ("stale", True, True, "m", "m", "a", None, "a", True), ("stale", True, True, "m", "m", "a", "c", "a", False), ("unknown", True, True, "m", "m", None, "a", "a", False),
    ]
    got = index.freshness(spark.createDataFrame(rows, schema)).collect()
    assert [g.state for g in got] == [g.k for g in got] and [g.needs_commits_behind for g in got] == [False, False, False, False, False, True, False]


def test_commits_behind(spark):
    rows = [("r", "d", "c"), ("r", "c", "b"), ("r", "b", "a"), ("r", "a", None), ("r", "x", "b"), ("q", "d", None)]
    commits = spark.createDataFrame(rows, "repository string, sha string, parent string")
    points = spark.createDataFrame([("r", "d", "b"), ("q", "d", "d")], "repository string, head string, since string")
    assert {r.repository: r.behind for r in index.commits_behind(commits, points).collect()} == {"r": 2, "q": 0}
    points = spark.createDataFrame([("r", "d", "x")], "repository string, head string, since string")
    assert index.commits_behind(commits, points).first().behind == 2


def test_search(spark):
    rows = [(1, "red fox runs", [0.0, 1.0]), (2, "red red hen", [1.0, 0.0]), (3, "blue sky", [0.9, 0.1])]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, vector array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0], ["red", "hen"])], "query_id long, query array<float>, terms array<string>")
    got = api.code_search(chunks, queries, 3).orderBy("rank").collect()
    assert [g.chunk_id for g in got] == [2, 1, 3]
    near = search.nearest(chunks, queries.select("query_id", "query"), 2).orderBy("rank").collect()
    assert [(n.chunk_id, round(n.distance, 3)) for n in near] == [(2, 0.0), (3, 0.02)]


def test_registry(spark):
    r = lambda n, root, remote, files, live, reach, at="": (n, root, remote, 1, at, files, 10, live, reach)
    rows = [
        r("a", "/a", None, ["x", "y", "z"], True, False), r("b", "/b", None, ["x", "y", "z", "w", "v"], True, True), r("c", "/gone", None, ["q"], False, False),
        r("d", "/d", "h/p", ["1"], True, False, "2"), r("e", "/e", "h/p", ["2"], True, False, "3"), r("f", None, None, [], False, False),
    ]
    df = spark.createDataFrame(rows, schemas.REGISTRY)
    assert [(p.a, p.b, round(p.similarity, 3)) for p in registry.similar_pairs(df).collect()] == [("a", "b", 0.6)]
    assert {(p.a, p.b) for p in registry.same_project(df).collect()} == {("a", "b"), ("d", "e")}
    pruned, freed = api.prune_indexes(df)
    assert {p.name: p.reason for p in pruned.collect()} == {"a": "duplicate of b", "b": None, "c": "orphan: checkout gone", "d": "duplicate of e", "e": None, "f": None}
    assert freed.first().reclaimed_bytes == 30
    assert {t.name for t in registry.dead_twins(df, "new", "h/p", ["x", "y", "z"]).collect()} == {"a", "d", "e"}


def test_sidecars(spark, tmp_path):
    (tmp_path / "k1.meta.json").write_text('{"root": "/r", "chunks": 3, "files": {"a.py": "h"}}')
    (tmp_path / "k2.meta.json").write_text('{"files": ["b.py", "c.py"]}')
    (tmp_path / "k3.meta.json").write_text("not json")
    got = {s.name: s for s in repository.sidecars(spark, str(tmp_path)).collect()}
    assert got["k1"].fileset == ["a.py"] and got["k1"].files == {"a.py": "h"} and got["k2"].fileset == ["b.py", "c.py"] and got["k3"].fileset == [] and got["k3"].indexed_at == ""


def test_embedding_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "i long, text string")
    got = embeddings.embed(df, lambda: lambda texts: [[float(len(t)), float(len(texts) <= 32)] for t in texts])
    assert all(r.vector == [float(r.i), 1.0] for r in got.collect())
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) == 1:
            raise KeyError(x)
        return x

    assert embeddings.with_pull(flaky, lambda: calls.append("pull"), lambda e: isinstance(e, KeyError))(3) == 3 and calls == [3, "pull", 3]


def test_root_states(spark):
    rows = [(True, "a", "a", True, "on_mr_head"), (True, "a", "b", True, "not_checked_out"), (True, "a", "b", False, "mr_head_absent"), (False, "a", "b", False, None), (True, "a", None, False, None)]
    got = index.root_state(spark.createDataFrame(rows, "is_git boolean, root_sha string, review_head string, head_present boolean, want string")).collect()
    assert all(g.root_state == g.want for g in got)


def test_similar_sets_of_long_members_by_brute_force(spark):
    import base64
    import hashlib

    long = [f"line {k} " + "x" * (30 + k) for k in range(12)]
    names = {f"n{i:02}": {long[(i * k) % 12] for k in range(1, 6)} | {f"short{i % 3}"} for i in range(20)}
    names["twin"] = {base64.b64encode(hashlib.sha256(x.encode()).digest()).decode() for x in names["n01"]}  # digests as members are other members
    df = spark.createDataFrame([(n, sorted(s)) for n, s in names.items()], "name string, fileset array<string>")
    want = sorted((a, b, round(len(s & t) / len(s | t), 6)) for a, s in names.items() for b, t in names.items() if a < b and len(s & t) / len(s | t) >= 0.6)
    pairs = registry.similar_pairs(df)
    assert sorted((p.a, p.b, round(p.similarity, 6)) for p in pairs.collect()) == want and want
    moved = pairs._jdf.queryExecution().executedPlan().toString().split("Exchange")[1:]
    assert all("sha2(" in m for m in moved if "fileset" in m)  # no exchange of members as they are
