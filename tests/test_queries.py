"""Registered queries: shape, parity with their SQL on a small table, and plans."""

import os

import pytest
from changelens.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["changed_files_manifest", "hunk_lines", "sections_merge", "verify_range_join", "impact_by_usage", "hybrid_rrf", "index_delta", "jaccard_pairs", "diff_budget_page", "vector_topk", "comment_position", "verify_path_match", "thread_grouping"])
def test_parity(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.SQL[name]})").fetchall()
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_plans_have_no_python_and_no_nested_loops(spark):
    for name in ("changed_files_manifest", "hunk_lines", "sections_merge", "changed_symbols_topk", "verify_range_join", "line_mapping_nearest", "index_delta", "jaccard_pairs"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_plans_filter_and_aggregate_early(spark):
    plan = lambda n: Q.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" in plan("impact_references") and "Join" not in plan("impact_references")
    assert plan("sections_merge").count("Exchange hashpartitioning") == 1 and "Join" not in plan("sections_merge")
    match = plan("verify_path_match")
    assert "NestedLoop" not in match and "Cartesian" not in match
    assert "NestedLoop" not in plan("hybrid_rrf").replace("BroadcastNestedLoopJoin BuildRight, Cross", "")  # one row of totals


def test_manifest_reads_two_columns(spark):
    if os.path.isdir(SF):
        plan = Q.QUERIES["changed_files_manifest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan and plan.count("Exchange hashpartitioning") == 1


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture
def long_documents(spark, tmp_path):
    """Documents whose files are packed, do not parse, or are empty."""
    line = "alpha beta gamma " * 6
    rows = [(0, "not python (("), (1, "\n".join(f"{k} {line}" for k in range(130))), (2, None), (3, "x" * 5000), (4, "a\n\nb"), (19, "y"), (5, "one\n" * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_chunks_of_whole_texts_by_brute_force(spark, long_documents):
    sf, rows = long_documents
    files = {r.path: r.content for r in Q._python_files(spark, sf).collect()}
    assert all((t or "") in c if i % 19 == 0 else all(x in c for x in (t or "").split("\n")) for i, t in rows for c in [files[f"d/f{i}.py"]])
    got: dict = {}
    for r in Q.QUERIES["chunk_python"](spark, sf).collect():
        got.setdefault(r.path, []).append((r.symbol, r.symbol_type, r.start_line, r.end_line, r.text))
    assert set(got) == set(files)
    for i, t in rows:
        path, lines = f"d/f{i}.py", files[f"d/f{i}.py"].split("\n")
        if i % 19 == 0:
            assert got[path] == [(None, "file", 1, len(lines), files[path])]
            continue
        n = len((t or "").split("\n"))
        last = 4 + n + 1
        body = "\n".join(lines[3:last])
        own, at, pack = [], 4, []
        if len(body) > 4000:  # pieces of whole lines, each line end counted
            size = 0
            for k in range(4, last + 1):
                if size + len(lines[k - 1]) + 1 > 4000 and k > at:
                    pack.append((at, k - 1))
                    at, size = k, 0
                size += len(lines[k - 1]) + 1
            pack.append((at, last))
        else:
            pack.append((4, last))
        own += [(f"f_{i}", "function", a, b, "\n".join(lines[a - 1 : b])) for a, b in pack]
        own.append((f"C_{i}", "class", last + 3, last + 5, "\n".join(lines[last + 2 : last + 5])))
        own.append((None, "preamble", 1, last + 8, f"import os\nf_{i}(2)"))
        assert sorted(got[path], key=str) == sorted(own, key=str)


def test_calls_of_whole_texts_by_brute_force(spark, long_documents):
    sf, rows = long_documents
    got = {(r.caller_path, r.caller, r.callee, r.call_line) for r in Q.QUERIES["call_edges_python"](spark, sf).collect()}
    want = set()
    for i, t in rows:
        if i % 19:
            path, end = f"d/f{i}.py", 4 + len((t or "").split("\n")) + 1
            want |= {(path, f"f_{i}", f"g_{i}", end), (path, f"f_{i}", "h", end), (path, "m", f"f_{i}", end + 5), (path, "<module>", f"f_{i}", end + 8)}
    assert got == want
