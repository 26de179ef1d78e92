"""Indexing a checkout: gate, record, twins, status, pruning; usages by syntax; context of a review."""

import ast
import json
import subprocess

import pytest
from changelens import api
from changelens.functions import text as T
from changelens.operators import registry, syntax
from changelens.streaming import index as stream
from changelens.streaming.index import latest
from pyspark.sql import functions as F


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def alpha(x):\n    return beta(x)\n")
    (root / "b.py").write_text("def beta(x):\n    return x\n")
    (root / "notes.txt").write_text("no source\n")
    subprocess.run(["git", "init", "-q", "-b", "main", str(root)], check=True)
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    return root


def connect():
    return lambda texts: [[float(len(t)), float(t.count("beta"))] for t in texts]


def test_index_follows_a_checkout(spark, checkout, tmp_path):
    folder, root = str(tmp_path / "indexes"), str(checkout)
    assert api.index_status(spark, root, folder, "m").first().state == "absent"
    done = api.index_repo(spark, root, folder, connect, "m")
    assert (done["mode"], done["files"], done["changed_files"], done["indexed_chunks"], done["evicted"], done["skipped"]) == ("full", 2, 2, 2, 0, 1)
    name = next((tmp_path / "indexes").glob("*.meta.json")).name.split(".")[0]
    assert json.loads((tmp_path / "indexes" / f"{name}.meta.json").read_text())["n_files"] == 2
    assert {(r.name, r.path) for r in api.file_sets(spark, folder).collect()} == {(name, "a.py"), (name, "b.py")}
    status = api.index_status(spark, root, folder, "m").first()
    assert (status.state, status.chunks, status.auto_index, status.next) == ("fresh", 2, False, None)
    assert api.index_status(spark, root, folder, "other").first().state == "model_mismatch"
    assert api.index_repo(spark, root, folder, connect, "m")["changed_files"] == 0
    (checkout / "b.py").unlink()
    (checkout / "c.py").write_text("def gamma(x):\n    return alpha(x)\n")
    git(checkout, "add", "-A")
    git(checkout, "commit", "-qm", "two")
    status = api.index_status(spark, root, folder, "m").first()
    assert (status.state, status.commits_behind, status.auto_index) == ("stale", 1, True)
    done = api.index_repo(spark, root, folder, connect, "m")
    assert (done["mode"], done["changed_files"], done["deleted_files"], done["indexed_chunks"]) == ("incremental", 1, 1, 2)
    table = latest(spark, f"{folder}/{name}")
    assert {(r.path, r.symbol, len(r.vector)) for r in table.collect()} == {("a.py", "alpha", 2), ("c.py", "gamma", 2)}
    words = latest(spark, f"{folder}/{name}/postings")
    assert {(r.path, r.term) for r in words.where("term in ('alpha', 'beta', 'gamma')").collect()} == {("a.py", "alpha"), ("a.py", "beta"), ("c.py", "gamma"), ("c.py", "alpha")}
    assert api.index_repo(spark, root, folder, connect, "m", force=True)["mode"] == "full"


def test_dead_twins_go(spark, checkout, tmp_path):
    folder = tmp_path / "indexes"
    api.index_repo(spark, str(checkout), str(folder), connect, "m")
    twin = {"root": "/gone/clone", "remote": "", "files": {"a.py": "1", "b.py": "2"}, "chunks": 2, "model": "m", "git_sha": "x", "indexed_at": ""}
    (folder / "0123456789abcdef.meta.json").write_text(json.dumps(twin))
    (folder / "0123456789abcdef").mkdir()
    (folder / "0123456789abcdef" / "x").write_text("x")
    rows, freed = api.prune_folder(spark, str(folder))
    assert freed.first().prunable == 1 and (folder / "0123456789abcdef.meta.json").exists()
    assert api.index_repo(spark, str(checkout), str(folder), connect, "m")["evicted"] == 1
    assert not (folder / "0123456789abcdef.meta.json").exists() and not (folder / "0123456789abcdef").exists()


def test_review_context(spark, checkout, tmp_path):
    patch = "@@ -1,2 +1,2 @@ def alpha(x):\n def alpha(x):\n-    return x\n+    return beta(x)"
    files = spark.createDataFrame([("r", 0, "a.py", patch, False)], "review_id string, file_ord long, file_path string, patch string, new_file boolean")
    source = spark.createDataFrame([("a.py", "def alpha(x):\n    return beta(x)\n"), ("c.py", "from a import alpha\nalpha(1)\n")], "path string, content string")
    out = api.review_context(files, source, root=str(checkout), review_head="0" * 40, folder=str(tmp_path / "ix"), model="m", connect=connect)
    assert [r.symbol for r in out["symbols"].collect()] == ["alpha"]
    assert {(r.path, r.line, r.usage_type) for r in out["references"].collect()} == {("a.py", 1, "definition"), ("c.py", 1, "import"), ("c.py", 2, "call")}
    assert {(r.usage_type, r.n) for r in out["by_usage_type"].collect()} == {("definition", 1), ("import", 1), ("call", 1)} and out["total_references"].first().total_references == 3
    assert out["root_status"].first().root_state == "mr_head_absent" and "head" in out["root_status"].first().warning
    assert out["index_status"].first().state == "fresh" and {r.path for r in out["related"].collect()} == {"a.py", "b.py"}


def test_usages_by_syntax():
    text = "import os, helper\n\n\n@helper.deco(1)\ndef run(a):\n    x = helper(a)\n    helper(\n        a)\n    return [helper]\n\n\nclass helper:\n    def m(self): pass\n"
    tree = ast.parse(text)
    want = {1: "import", 4: "call", 6: "assignment", 7: "call", 8: "call", 9: "reference", 12: "definition", 13: "definition"}
    assert {n: syntax.python_usage(tree, n, "helper") for n in want} == want


def test_scan_stats_and_globs(spark):
    files = spark.createDataFrame([("x/a.py", "def f():\n    g()\n"), ("b.py", "def ("), ("c.go", "func h() {\n}\n"), ("d.txt", "f")], "path string, content string")
    symbols = spark.createDataFrame([("f",), ("g",)], "symbol string")
    stats = api.trace_call_chain(files, symbols)["stats"].first()
    assert (stats.files_scanned, stats.parse_errors) == (3, 1)
    assert api.trace_call_chain(files, symbols, max_files=1)["stats"].first().files_scanned == 1
    got = lambda g: {r.path for r in api.dependency_impact(files, symbols, file_glob=g)["references"].collect()}
    assert got("*.py") == {"x/a.py"} and got("d.*") == {"d.txt"} and got("x/*.go") == set()
    import re

    ok = lambda g, p: bool(re.search(T.glob_pattern(g), p))
    assert ok("*.java", "a/b/C.java") and ok("src/**/*.ts", "src/a/b.ts") and ok("src/**/*.ts", "src/b.ts") and not ok("src/*.ts", "src/a/b.ts")
    assert ok("*.{py,go}", "a/b.go") and not ok("*.{py,go}", "a/b.gox") and ok("[!a]b.c", "cb.c") and not ok("a.b", "axb") and ok("f?.py", "f1.py")


def test_prune_by_brute_force(spark):
    import random

    rng, rows = random.Random(3), []
    base = [[f"f{k}_{i}" for i in range(rng.randrange(3, 12))] for k in range(12)]
    for n in range(90):
        files = [f for f in rng.choice(base) if rng.random() < 0.9] + [f"x{rng.randrange(50)}"] * (rng.random() < 0.4)
        rows.append((f"n{n:03d}", f"/r{n}" if rng.random() < 0.9 else None, f"h/{rng.randrange(9)}" if rng.random() < 0.3 else None, n % 7, f"2026-{n % 12:02d}", sorted(set(files)), 10 * n, rng.random() < 0.7, rng.random() < 0.4))
    schema = "name string, root string, remote string, chunks long, indexed_at string, fileset array<string>, size_bytes long, root_exists boolean, reachable boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    records = [dict(zip(names, r)) for r in rows]
    orphan = lambda r: bool(r["root"]) and not r["root_exists"] and not r["reachable"]
    like = lambda a, b: bool(a["fileset"] and b["fileset"]) and len({*a["fileset"]} & {*b["fileset"]}) / len({*a["fileset"], *b["fileset"]}) >= 0.6
    groups: list[list[dict]] = []
    for r in sorted((r for r in records if not orphan(r)), key=lambda r: r["name"]):
        own = next((g for g in groups if like(g[0], r) or r["remote"] and g[0]["remote"] == r["remote"]), None)
        groups.append([r]) if own is None else own.append(r)
    want = {r["name"]: "orphan: checkout gone" for r in records if orphan(r)}
    for g in groups:
        best = min(g, key=lambda r: (not r["reachable"], not (r["root"] and r["root_exists"]), [-ord(c) for c in r["indexed_at"]], -r["chunks"], r["name"]))
        want |= {r["name"]: None if r is best else f"duplicate of {best['name'][:8]}" for r in g}
    got = {r.name: r.reason for r in registry.prune(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len({len(g) for g in groups}) > 2


def test_matching_of_paths_by_brute_force(spark):
    import random

    from changelens.operators import review

    rng = random.Random(4)
    part = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 18)))
    for _ in range(3):
        tails = [part() for _ in range(12)]
        files = [("r", k, rng.choice(["", "d/", "x"]) + rng.choice(tails), rng.choice(["p", "p", ""])) for k in range(60)]
        paths = sorted({rng.choice(["", "d/", "zz/"]) + rng.choice(tails) for _ in range(40)})
        threads = spark.createDataFrame([("r", p, True) for p in paths], "review_id string, file_path string, located boolean")
        df = spark.createDataFrame(files, "review_id string, file_ord long, file_path string, patch string")
        loaded = [(k, f) for _, k, f, patch in files if patch and any(p in f for p in paths)]
        want = {}
        for p in paths:
            own = [(f != p, k, f) for k, f in loaded if f.endswith(p) or p.endswith(f)]
            if own:
                want[p] = min(own)[1:]
        assert {r.thread_path: (r.file_ord, r.file_path) for r in review.match_paths(threads, df).collect()} == want and want


def test_commands(spark, checkout, tmp_path, capsys):
    from changelens.__main__ import main

    folder = str(tmp_path / "indexes")
    main(["index", str(checkout), "--folder", folder])
    main(["status", str(checkout), "--folder", folder])
    main(["prune", "--folder", folder])
    done, status, freed = map(json.loads, capsys.readouterr().out.strip().splitlines()[-3:])
    assert done["indexed_chunks"] == 2 and status["state"] == "fresh" and freed["prunable"] == 0


def sources(spark, n, change=()):
    body = F.concat(F.lit("def f"), F.col("id").cast("string"), F.lit("():\n    return g()"), F.when(F.col("id").isin(*change), "\n\n\ndef more():\n    pass\n").otherwise("\n"))
    return spark.range(n).select(F.concat(F.lit("d/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))


def key(df):
    return sorted((r.path, r.symbol or "", r.start_line, r.end_line, r.text, r.hash) for r in df.collect())


def test_refresh_writes_touched_buckets_only(spark, tmp_path):
    table, counts = str(tmp_path / "ix"), {}
    stream.refresh(spark, table, sources(spark, 300), 1, counts=counts)
    assert counts == {"files": 300, "changed": 300, "deleted": 0, "chunks": 300}
    files = lambda: {str(p.relative_to(table)) for p in (tmp_path / "ix").rglob("*.parquet")}
    before = files()
    stream.refresh(spark, table, sources(spark, 300, [7]), 2, counts=counts)
    new = files() - before
    assert counts == {"files": 300, "changed": 1, "deleted": 0, "chunks": 301}
    assert len(new) == 3 and len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1 and all("version=2" in f for f in new)
    stream.refresh(spark, table, sources(spark, 295, [7]), 3, counts=counts)
    assert counts == {"files": 295, "changed": 0, "deleted": 5, "chunks": 296} and len(files() - before - new) <= 15
    stream.refresh(spark, str(tmp_path / "all"), sources(spark, 295, [7]), 9)
    assert key(latest(spark, table)) == key(latest(spark, str(tmp_path / "all")))
    words = lambda t: sorted((r.path, r.term, r.tf, r.length, r.chunk_id) for r in latest(spark, t, part="postings").collect())
    assert words(table) == words(str(tmp_path / "all"))
    assert key(latest(spark, table, before=2)) == key(latest(spark, table, before=2)) and latest(spark, table, before=2).count() == 300
    assert [tuple(r) for r in stream.history(spark, table).select("version", "chunks").collect()] == [(1, 300), (2, 301), (3, 296)]
    kept = key(latest(spark, table))
    assert stream.vacuum(spark, table) > 0 and stream.versions(spark, table) == [3] and key(latest(spark, table)) == kept
    again = files()
    stream.refresh(spark, table, sources(spark, 295, [7]), 4, counts=counts)  # nothing changed, nothing written
    assert files() == again and counts == {"files": 295, "changed": 0, "deleted": 0, "chunks": 296}
    stream.refresh(spark, table, sources(spark, 0), 5, counts=counts)
    assert counts == {"files": 0, "changed": 0, "deleted": 295, "chunks": 0} and latest(spark, table) is None


def test_a_refresh_that_died_counts_for_nothing(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "ix")
    stream.refresh(spark, table, sources(spark, 20), 1)
    old = key(latest(spark, table))
    monkeypatch.setattr(stream, "put", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        stream.refresh(spark, table, sources(spark, 20, [3]), 2)
    monkeypatch.undo()
    assert stream.versions(spark, table) == [1] and key(latest(spark, table)) == old
    assert ("d/f3.py", "more") in {k[:2] for k in key(stream.refresh(spark, table, sources(spark, 20, [3]), 2))}


def test_snapshots_in_pieces_out_of_order_and_repeated(spark, tmp_path):
    place, table = tmp_path / "in", str(tmp_path / "ix")
    part = lambda n, rows: spark.createDataFrame([(n, *r) for r in rows], stream.SNAPSHOT).coalesce(1).write.mode("append").parquet(str(place))
    file = lambda k, more="": (f"{k}.py", f"def {k}():\n    pass\n{more}")

    def run():
        src = spark.readStream.schema(stream.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(str(place))
        stream.follow(src, table, str(tmp_path / "cp")).awaitTermination()
        found = latest(spark, table)
        return stream.versions(spark, table), set() if found is None else {r.path for r in found.collect()}

    part(1, [file("a"), file("b")])
    assert run() == ([], set())  # nothing counts before the snapshot is whole
    part(1, [(None, "3")])
    part(2, [file("c")])
    part(1, [file("a")])  # repeated
    assert run() == ([], set())
    part(1, [file("c")])
    assert run() == ([1], {"a.py", "b.py", "c.py"})
    part(3, [(None, "2"), file("x")])
    part(2, [(None, "2"), file("d", "# two\n")])
    assert run() == ([1, 2], {"c.py", "d.py"})
    part(3, [file("c", "# three\n")])
    part(2, [file("late")])  # of a snapshot that is passed
    assert run() == ([1, 2, 3], {"x.py", "c.py"})
    whole = spark.createDataFrame([file("x"), file("c", "# three\n")], "path string, content string")
    stream.refresh(spark, str(tmp_path / "all"), whole, 1)
    assert key(latest(spark, table)) == key(latest(spark, str(tmp_path / "all")))


def test_twins_among_many_files(spark):
    many = spark.range(200_000).select(F.concat(F.lit("src/dir/file_"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    sets = many.select(F.lit("near").alias("name"), "path").where("pmod(hash(path), 10) < 8").union(many.select(F.lit("far").alias("name"), "path").where("pmod(hash(path), 10) < 5"))
    sets = sets.union(spark.createDataFrame([("small", "src/dir/file_1.py")], "name string, path string")).union(many.select(F.lit("alive"), "path"))
    records = spark.createDataFrame([("near", "", False, False), ("far", "", False, False), ("small", "", False, False), ("alive", "", True, True), ("kin", "h/p", True, False)], "name string, remote string, root_exists boolean, reachable boolean")
    found = registry.dead_twins(records, "own", "h/p", many, sets=sets)
    assert {r.name for r in found.collect()} == {"near", "kin"}
    assert "file_1999" not in found._jdf.queryExecution().logical().toString()  # no path in the plan


def test_postings_of_a_refresh_move_as_texts_only(spark, monkeypatch):
    from changelens.operators import search

    monkeypatch.setattr(stream, "PART", 400)
    rows = stream.chunked(sources(spark, 120)).localCheckpoint()
    dealt = stream._dealt(rows, 4, 4000)
    got = stream._postings(dealt)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # no posting moves
    assert dealt.select("bucket", F.spark_partition_id()).distinct().count() > 4  # a bucket lies in several tasks
    assert dealt.select("path", F.spark_partition_id()).distinct().count() == 120
    words = lambda df: sorted((r.term, r.chunk_id, r.tf, r.length) for r in df.collect())
    assert words(got) == words(search.postings(rows))
