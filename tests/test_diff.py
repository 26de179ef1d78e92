import json
import random

from changelens import schemas
from changelens.functions import text as T
from changelens.operators import diff, sections
from pyspark.sql import functions as F

MIXED = "@@ -1,4 +1,5 @@\n a\n-b\n+c\n+d\n+e\n f"


def files(spark, *rows):
    full = [("r", i, p, p, new, False, False, patch) for i, (p, patch, new) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FILE_DIFF)


def lines(spark, patch, path="a.py"):
    return diff.hunk_lines(files(spark, (path, patch, False))).orderBy("pos").collect()


def test_mixed_hunk(spark):
    got = lines(spark, MIXED)
    assert [x.type for x in got] == ["context", "del", "add", "add", "add", "context"]
    assert [x.new_line for x in got] == [1, None, 2, 3, 4, 5]
    assert [x.old_line for x in got] == [1, 2, None, None, None, 3]
    assert [x.content for x in got] == list("abcdef")


def test_counts_and_headers(spark):
    f = files(spark, ("a.py", MIXED, False), ("b.py", "--- a\n+++ b\n+x\n-y", False), ("c.py", "", False))
    assert [(r.additions, r.deletions) for r in diff.measured(f).orderBy("file_ord").collect()] == [(3, 1), (1, 1), (0, 0)]


def test_lone_header_lengths_marker_and_preamble(spark):
    got = lines(spark, "diff --git a b\nindex 1\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file\n@@ -9,2 +10,2 @@ def f():\n x\n++++z")
    assert [(x.hunk_no, x.type, x.content) for x in got] == [(1, "del", "a"), (1, "add", "b"), (2, "context", "x"), (2, "context", "++++z")]
    assert (got[0].old_lines, got[0].new_lines, got[2].new_start, got[2].hint) == (1, 1, 10, "def f():")


def test_no_hunks(spark):
    assert lines(spark, "") == [] and lines(spark, "no header\n+x") == []


def test_unicode_line_ends(spark):
    got = spark.range(1).select(T.split_lines(F.lit("a\r\nb\u2028c\x0bd\n")).alias("x"), T.split_lines(F.lit("")).alias("y")).first()
    assert got.x == ["a", "b", "c", "d"] and got.y == []


def test_classification(spark):
    cases = [
        ("yarn.lock", 1, "lockfile"), ("a/go.sum", 1, "lockfile"), ("x.min.js", 1, "generated"), ("a_pb2.py", 1, "generated"), ("vendor/x.go", 1, "vendored/build artifact"),
        ("src/build/x.py", 1, "vendored/build artifact"), ("I.PNG", 1, "binary/asset"), ("t.snap", 1, "binary/asset"), ("a.py", 2000, None), ("a.py", 2001, "very large change (2001 lines, likely generated)"), ("builder.py", 5, None),
    ]
    df = spark.createDataFrame(cases, "p string, n int, want string")
    for r in df.withColumn("got", T.skip_reason(F.col("p"), F.col("n"))).collect():
        assert r.got == r.want, r


def test_budget_is_the_sequential_rule(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for review in range(200):
        used, cut = 0, False
        first = True
        for k in range(rng.randrange(1, 8)):
            ok, cost = rng.random() < 0.8, rng.randrange(1, 50)
            rows.append((f"r{review}", k, ok, cost))
            if not ok:
                want[f"r{review}", k] = "skipped"
            elif cut or not first and used + cost > 60:
                cut = True
                want[f"r{review}", k] = "omitted"
            else:
                used, first = used + cost, False
                want[f"r{review}", k] = "returned"
    df = spark.createDataFrame(rows, "review_id string, file_ord long, reviewable boolean, cost long")
    assert {(r.review_id, r.file_ord): r.status for r in diff.budget(df, 60).collect()} == want


def test_line_mappings(spark):
    f = files(spark, ("a.py", MIXED, False), ("b.py", "", False))
    wanted = f.select(*diff.FILE, F.expr("array(3, 99, 2, 2)").alias("requested"))
    got = {(r.file_path, r.requested): r for r in diff.line_mappings(diff.hunk_lines(f), wanted).collect()}
    assert len(got) == 6
    assert (got["a.py", 3].new_line, got["a.py", 3].exact) == (3, True)
    assert (got["a.py", 99].new_line, got["a.py", 99].exact) == (5, False)
    assert (got["b.py", 2].new_line, got["b.py", 2].exact) == (None, False)


def test_symbols_sections_and_ties(spark):
    patch = "@@ -1,3 +1,3 @@ def alpha():\n x\n+y\n@@ -9,2 +9,3 @@ def alpha():\n+z\n@@ -30,3 +30,3 @@\n def beta():\n+q\n@@ -50 +50 @@\n+w"
    f = files(spark, ("a.py", patch, False))
    got = sections.hunk_sections(diff.hunk_lines(f), with_changes=True).orderBy("section_no").collect()
    assert [(s.symbol, s.symbol_type, s.start_line, s.end_line, s.changed_lines) for s in got] == [("alpha", "function", 2, 9, 2), ("beta", "function", 31, 31, 1), (None, "unknown", 50, 50, 1)]
    assert [c.content for c in got[0].changes] == ["y", "z"]
    top = sections.top_symbols(sections.hunk_sections(diff.hunk_lines(f)), 1).collect()
    assert [(t.symbol, t.weight) for t in top] == [("alpha", 2)]


def test_identifiers_and_fallback(spark):
    f = files(spark, ("a.json", "@@ -1 +1,2 @@\n+apiEndpoint apiEndpoint if na\n old", False))
    lines_ = diff.hunk_lines(f)
    got = sections.review_symbols(sections.hunk_sections(lines_), lines_).collect()
    assert [(r.symbol, r.source) for r in got] == [("apiEndpoint", "identifier-fallback")]
    snippet = sections.first_context(lines_, spark.createDataFrame([("r", "Endpoint")], "review_id string, symbol string")).first()
    assert snippet.snippet == "apiEndpoint apiEndpoint if na"


def test_one_exchange_and_no_python(spark):
    plan = diff.hunk_lines(files(spark, ("a.py", MIXED, False)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_costs_are_the_length_of_the_entry(spark):
    """Characters of ``json.dumps`` of the entry that a reader of the tool gets."""
    odd = "@@ -1,2 +1,3 @@ def f():\n a\"b\\\\c\t\u00e9\n+\U0001f600 \x7f\x01\n-\n@@ -90 +95 @@\n@@ -100,2 +110 @@\n x"
    rows = [("r", 0, "d/a.py", "d/\u00e4.py", True, False, False, odd), ("r", 1, "b", "b", False, True, False, ""), ("r", 2, "c.go", None, False, False, True, MIXED)]
    f = spark.createDataFrame(rows, "review_id string, file_ord long, file_path string, old_path string, new_file boolean, deleted_file boolean, renamed_file boolean, patch string")
    lines = diff.hunk_lines(f)
    measured = {r.file_ord: r for r in diff.measured(f).collect()}
    heads = {(r.file_ord, r.hunk_no): r for r in diff.hunk_heads(f).collect()}
    line = lambda r: {"type": r.type, "old_line": r.old_line, "new_line": r.new_line, "content": r.content}
    own = {k: [line(r) for r in sorted(lines.collect(), key=lambda r: r.pos) if (r.file_ord, r.hunk_no) == k] for k in heads}
    got = {r.file_ord: r.cost for r in diff.entry_costs(diff.measured(f), lines).collect()}
    for k, r in measured.items():
        hunks = [{**{c: h[c] for c in ("old_start", "old_lines", "new_start", "new_lines")}, "lines": own[o, n]} for (o, n), h in sorted(heads.items()) if o == k]
        entry = {c: r[c] for c in ("file_path", "old_path", "new_file", "deleted_file", "renamed_file", "additions", "deletions")} | {"hunks": hunks}
        assert got[k] == len(json.dumps(entry))
    found = sections.hunk_sections(lines, True, with_changes=True)
    got = {r.file_ord: r.cost for r in diff.section_costs(diff.measured(f), found).collect()}
    language = {0: "python", 1: None, 2: "go"}
    for k, r in measured.items():
        some = [{c: x[c] for c in ("symbol", "symbol_type", "start_line", "end_line")} | {"changes": [line(y) for y in x.changes]} for x in sorted(found.collect(), key=lambda x: x.section_no) if x.file_ord == k]
        entry = {"file_path": r.file_path, "language": language[k]} | {c: r[c] for c in ("new_file", "deleted_file", "additions", "deletions")} | {"sections": some}
        assert got[k] == len(json.dumps(entry))


def test_budget_and_order_of_a_huge_review(spark):
    import numpy as np
    from changelens.operators import review
    from pyspark.sql import functions as F

    n = 200_000
    k = F.col("id")
    rows = spark.range(n, numPartitions=8).select(
        F.when(k < n - 10, "r").alias("review_id"), k.alias("file_ord"), F.concat(F.lit("f"), k.cast("string")).alias("file_path"), (k % 7 != 0).alias("reviewable"),
        F.when(k % 5 == 0, 1).otherwise((k * 7919) % 9001).cast("int").alias("additions"), (k % 3).cast("int").alias("deletions"), (k % 11 + 1).alias("cost"),
    )
    got = diff.budget(rows, 500_000).select("review_id", "file_ord", "used_chars", "status").toPandas().sort_values("file_ord")
    ids = np.arange(n)
    cost = np.where(ids % 7 != 0, ids % 11 + 1, 0)
    used = np.concatenate((np.cumsum(cost[: n - 10]), np.cumsum(cost[n - 10 :])))  # the rest is a review without id
    assert (got["used_chars"].to_numpy() == used).all()
    want = np.where(ids % 7 == 0, "skipped", np.where(used <= 500_000, "returned", "omitted"))
    assert (got["status"].to_numpy() == want).all()
    out = review.manifest_order(rows)
    placed = out.select("review_id", "file_ord", "place").toPandas().sort_values("file_ord")["place"].to_numpy()
    changed = np.where(ids % 5 == 0, 1, (ids * 7919) % 9001) + ids % 3
    for part in (slice(0, n - 10), slice(n - 10, n)):
        order = sorted(ids[part].tolist(), key=lambda i: (i % 7 == 0, -changed[i], i))
        want = np.empty(len(order), int)
        want[np.array(order) - ids[part][0]] = np.arange(1, len(order) + 1)
        assert (placed[part] == want).all()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = out.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.6 * n  # one review in several tasks


def test_costs_read_patches_twice_and_count_characters_by_runs(spark):
    texts = ["", None, "plain", 'a"b\\c\n\r\t\b\f', "\x00\x01\x1f\x7f ~", "äöü €", "\U0001f600x\U0001f601퟿", "  a \x0b", '""""', "\x7f" * 3, "é\U00010000é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", diff.json_string(F.col("t")).alias("n")).collect()}
    assert got == {i: len(json.dumps(t)) for i, t in enumerate(texts)}
    patch = "@@ -1,2 +3,4 @@ x\n+a\n b\n@@ -bad\n-c\n@@ -9 +9 @@\n@@ -20,0 +21,1 @@\n+ é"
    rows = [(f"r{i % 2}", i, f"d/f{i}.py", p) for i, p in enumerate([patch, "", "no header", None, patch + "\n"])]
    f = spark.createDataFrame(rows, "review_id string, file_ord long, file_path string, patch string")
    f = f.select("*", F.col("file_path").alias("old_path"), *[F.lit(False).alias(c) for c in ("new_file", "deleted_file", "renamed_file")])
    lines = diff.hunk_lines(f)
    want = sorted(map(tuple, diff.entry_costs(diff.measured(f), lines).collect()))
    both = diff.priced(diff.measured(f, heads=True), lines)
    assert sorted(map(tuple, both.select(*diff.FILE, "cost").collect())) == want and len(want) == 5
    assert "patch" not in both.columns and "heads" not in both.columns and {"additions", "reviewable"} <= set(both.columns)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LogicalRDD") == 2  # the files once for measures and heads, once for lines
