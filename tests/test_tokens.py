"""Brace languages by tokens: the places where patterns go wrong, and what each language declares, calls and uses."""

import re

import pytest
from changelens import api
from changelens.operators import syntax, tokens
from changelens.plans import braces
from pyspark.sql import functions as F

JAVA = """package p;
import a.b.C;

@Ann(x)
public class K<T> extends Q {
  private int f = go(1);
  K(int a) { super(a); }
  public static List<String> m(int a) throws E {
    if (a > 0) { call(a); } else { other(); }
    char c = '{';
    return """ + '"""\n { "quoted" {\n"""' + """;
  }
  enum E { A(1), B(2); }
  abstract void n();
}
interface I { void q(); }
"""
RUST = "use a::{b, c};\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nimpl<'a> Tr for S<'a> {\n    fn go(&self) -> u8 { let c = '{'; let r = r#\"{ \" {\"#; b(1) }\n}\npub(crate) async fn z() {}\n"
KOTLIN = "import a.b\n\n@Foo(1)\nclass X(val a: Int) : Y() {\n  override fun r(): Int = 1\n  fun String.ext(x: Int) {\n    println(\"${x}\")\n  }\n}\nfun top(a: Int) {\n}\n"
GO = "package m\n\nfunc A() string {\n\treturn `raw { \" \n { `\n}\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) B(x int) error {\n\tA()\n\treturn nil\n}\n"
TS = "import { q } from 'm';\nexport class A {\n  m(x: number): Foo { let s = `a {\n b ${x}`; }\n  get v() { return 1 }\n}\nclass C {}\nconst f = (a) => {\n  return g(a)\n}\nfoo(/[{\"]/, 'it\\'s')\n"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def chunked(spark, name, content):
    return [(c.symbol, c.symbol_type, c.start_line, c.end_line) for c in syntax.chunks(frame(spark, (name, content))).orderBy("start_line").collect()]


def test_brackets_in_comments_strings_and_templates(spark):
    assert chunked(spark, "a.js", "function a() { /* { */ }\nfunction b() {}\n") == [("a", "function", 1, 1), ("b", "function", 2, 2)]
    assert chunked(spark, "a.js", "function a() { return `x {\n y`; }\nclass C {\n}\n") == [("a", "function", 1, 2), ("C", "class", 3, 4)]
    assert [c[:1] + c[2:] for c in chunked(spark, "a.go", GO)] == [(None, 1, 1), ("A", 3, 6), ("T", 8, 10), ("B", 12, 15)]
    many = "".join(f"function f{i}() {{\n" for i in range(3000))  # three thousand that are never closed
    got = tokens.declared(tokens.items(tokens.statements(tokens.tokens(frame(spark, ("a.js", many)))))).where("name is not null")
    assert got.count() == 3000 and got.agg(F.min("end_line")).first()[0] == 3000


def test_chunks_of_each_language(spark):
    assert chunked(spark, "K.java", JAVA) == [(None, "preamble", 1, 1), (None, "other", 2, 2), ("K", "class", 4, 17), ("I", "interface", 18, 18)]
    assert chunked(spark, "s.rs", RUST) == [(None, "preamble", 1, 2), ("S", "other", 3, 3), ("Tr", "trait", 4, 6), ("z", "function", 7, 7)]
    assert chunked(spark, "x.kt", KOTLIN) == [(None, "preamble", 1, 1), ("X", "class", 3, 9), ("top", "function", 10, 11)]
    assert chunked(spark, "a.ts", TS) == [(None, "preamble", 1, 1), ("A", "other", 2, 6), ("C", "class", 7, 7), ("f", "other", 8, 10), (None, "other", 11, 11)]


def test_large_declarations_are_divided(spark):
    body = "    call(1);\n" * 150
    content = "class C {\n  x = 1;\n" + "".join(f"  m{i}() {{\n{body}  }}\n" for i in range(3)) + "  big() {\n" + body * 4 + "  }\n}\n"
    got = syntax.chunks(frame(spark, ("a.js", content))).orderBy("start_line").collect()
    lines = content.split("\n")
    assert [(c.symbol, c.symbol_type) for c in got[:4]] == [("C", "class"), ("m0", "method"), ("m1", "method"), ("m2", "method")] and (got[0].start_line, got[0].end_line) == (1, 2)
    assert {c.symbol for c in got[4:]} == {"big"} and len(got) == 4 + 2 and all(len(c.text) <= 4000 and c.text == "\n".join(lines[c.start_line - 1 : c.end_line]) for c in got)
    flat = "function f() {\n" + "x" * 5000 + "\n" + "  y();\n" * 900 + "}\n"
    assert [(c.start_line, c.end_line) for c in syntax.chunks(frame(spark, ("a.js", flat))).orderBy("start_line").collect()] == [(a, b) for a, b in syntax.pack(flat.split("\n"), 1, 903)]


def test_calls_and_callers(spark):
    got = api.trace_call_chain(frame(spark, ("K.java", JAVA), ("s.rs", RUST), ("a.ts", TS), ("b.py", "def p():\n    foo()\n")), spark.createDataFrame([("m",), ("b",), ("foo",)], "symbol string"))
    assert {(c.symbol, c.name) for c in got["callees"].collect()} == {("m", "call"), ("m", "other")}
    assert {(c.symbol, c.name, c.file_path, c.call_line) for c in got["callers"].collect()} == {("b", "go", "s.rs", 5), ("foo", "<module>", "a.ts", 11), ("foo", "p", "b.py", 2)}
    assert [(d.symbol, d.file_path, d.line, d.type) for d in got["definition"].where("symbol = 'm'").collect()] == [("m", "K.java", 8, "method")]
    assert tuple(got["stats"].first()) == (4, 0)
    st, dc = syntax.parsed(frame(spark, ("a.js", "a.b(1); x.y.z(2); new W(3); if (q) w(4)\n")))
    assert {e.callee for e in tokens.call_edges(st, dc).collect()} == {"b", "z", "W", "w"}
    assert {e.callee for e in tokens.call_edges(st, dc, call_name="first").collect()} == {"a", "z", "W", "w"}


def test_usages_outermost_first(spark):
    content = "import { x } from 'm';\nconst r = x(1);\nfoo(x);\nfoo(() => {\n  const y = x;\n});\nclass x { }\nlet v: x;\nreturn x;\nx(2);\nfunction f(p: x) {}\n"
    st, dc = syntax.parsed(frame(spark, ("a.ts", content)))
    got = {u.line: (u.usage, u.enclosing_symbol) for u in tokens.usages(st, dc, spark.createDataFrame([("x",)], "symbol string")).collect()}
    assert got == {1: ("import", None), 2: ("assignment", "r"), 3: ("call", None), 5: ("call", "y"), 7: ("definition", "x"), 8: ("type_reference", "v"), 9: ("reference", None), 10: ("call", None), 11: ("type_reference", "f")}
    hits = api.dependency_impact(frame(spark, ("a.ts", content)), spark.createDataFrame([("x",)], "symbol string"))["references"]
    assert {h.line: h.usage_type for h in hits.where("line <= 5").collect()} == {1: "import", 2: "assignment", 3: "call", 5: "call"}


def test_odd_files(spark):
    rows = [("a.js", ""), ("b.js", " \n\t"), ("c.js", None), ("d.js", "} } ) open { ( x"), ("e.js", "'unclosed\n`never { closed"), ("f.rs", '"open\n{'), ("g.java", "/* open {"), ("h.go", " é日本 ( { [ ] \x00"), ("i.kt", "a" * 300_000 + "\n" + '"\\"' * 50_000), ("j.py", "x"), ("k.txt", "{")]
    files = frame(spark, *rows).withColumns({"language": F.lit("clash"), "pos": F.lit(1)})
    got = {c.path for c in tokens.chunks(files).collect()}
    assert got == {"d.js", "e.js", "f.rs", "g.java", "h.go", "i.kt"}
    assert tokens.chunks(files.where("path = 'none'")).collect() == []


def test_tokens_cover_every_text():
    text = "a\"b\\\"c\" 'x' `t` /re/ (/r{/ // c\n /* d */ #![] <'a> r#\"q\"# 1.5 é日 \x85  => \\"
    for language in tokens.LANGUAGES:
        assert "".join(m.group() for m in re.finditer(tokens.pattern(language).replace("\\z", "\\Z"), text)) == text


@pytest.mark.parametrize("name", ["chunk_braces", "call_edges_braces", "usage_by_tokens"])
def test_plans_hold_no_python(spark, name, tmp_path):
    rows = [(i, f"some (text {i}\nof 'two lines" if i % 3 else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from changelens.plans import queries as Q

    df = Q.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want)) and want
    assert braces.EXTENSIONS


def test_partitions_follow_the_size_of_the_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 1000)
    files = frame(spark, *[(f"f{i}.java", JAVA) for i in range(40)])
    own = tokens.by_path(files)
    assert own.rdd.getNumPartitions() == -(-40 * len(JAVA) // 1000)  # nor are they joined by the bytes that move
    assert tokens.by_path(own.select("path", "content"), dealt=True)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_calls_and_usages_from_the_tokens_kept(spark):
    files = frame(spark, ("K.java", JAVA), ("s.rs", RUST), ("x.kt", KOTLIN), ("a.go", GO), ("a.ts", TS))
    every = tokens.statements(tokens.tokens(files))
    want = tokens.declared(tokens.items(every))
    found = tokens.declared(tokens.items(every, tokens.asked("x", "a")))
    some, own = tokens.kept(found), found.drop("kept")
    assert some.count() < every.count() / 2
    symbols = spark.createDataFrame([("x",), ("a",)], "symbol string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(tokens.call_edges(some, own)) == rows(tokens.call_edges(every, want)) != []
    assert rows(tokens.usages(some, own, symbols)) == rows(tokens.usages(every, want, symbols)) != []


def test_runs_of_words_give_what_single_tokens_give(spark):
    import random

    pick = random.Random(4)
    pieces = [" ", " ", " ", " ", "  ", "\n", "\t", "word", "x", "a", "é日", "B1", "$v", "_", "12", "3.5", "7.", "r", "br", 'r"', 'b"', 'r#"', "'", '"', "`", ",", ".", "%", "*", "#", "!", "!=", "/", "//", "/*", "*/", "(", ")", "[", "]", "{", "}", ";", "=", "=>", ":", "@", "&&", "|", "<", ">", "class C", "function f", "def", "else", "import", "fn g", "fun k", "func m", "impl T", "const y"]
    rows = [(f"f{i}.{ext}", "".join(pick.choice(pieces[: 30 if i % 2 else None]) for _ in range(300))) for i in range(25) for ext in braces.EXTENSIONS]
    rows += [(f"p.{ext}", "the x, and a. x (a b x (c " * 40 + "\n" + "@ word\nx y) z\n#[a] b\n#![a] b. c! [x] / x, /re/ a! /re x/ b " * 9) for ext in braces.EXTENSIONS]
    files = frame(spark, *rows)
    single, runs = tokens.statements(tokens.tokens(files)), tokens.statements(tokens.tokens(files, runs=True))
    every = lambda df: sorted(map(repr, df.select(*sorted(set(df.columns) - {"kept"})).collect()))
    held = lambda df: sorted(map(repr, tokens.kept(df).select("path", "level", "scope", "pos", "text", "line", "next", "next_pos", "b1", "b2", "b3", "b4").collect()))
    want = tokens.declared(tokens.items(single, tokens.asked("x", "a", "B1")))
    got = tokens.declared(tokens.items(tokens.in_runs(runs, "x", "a", "B1")))
    assert every(got) == every(want) != [] and held(got) == held(want) != []
    assert held(tokens.items(tokens.in_runs(runs))) == held(tokens.items(single, tokens.asked()))
    assert runs.where("path like 'p.%'").count() < 0.6 * single.where("path like 'p.%'").count()
