"""Syntax of source files: chunks, declaration spans and call edges, one parse of each file.

Python is parsed by the standard library, brace languages as tables of tokens (``tokens``); a file of neither kind, or
that does not parse, is one chunk.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import ship, written
from . import tokens
from .code import MAX_BYTES, MODULE

MAX_CHUNK = 4000
CHUNK = "path string, symbol string, symbol_type string, start_line int, end_line int, text string"
SYNTAX = "path string, kind string, name string, symbol_type string, start_line int, end_line int, caller string, pos int"

Span = tuple[str | None, str, int, int, list]  # name, kind, first and last line, spans of members


def _python_spans(content: str) -> list[Span] | None:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None

    def of(body, depth=0) -> list[Span]:
        out = []
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                kind = "other" if n.decorator_list and not depth else kind  # a decorated definition is a wrapper
                first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                out.append((n.name, kind, first, n.end_lineno or n.lineno, of(n.body, depth + 1)))
        return out

    return of(tree.body)


def pack(lines: list[str], first: int, last: int, most: int = MAX_CHUNK) -> Iterator[tuple[int, int]]:
    """Line ranges of at most ``most`` characters, line ends counted, but of one line at least."""
    start, size = first, 0
    for i in range(first, last + 1):
        n = len(lines[i - 1]) + 1
        if size + n > most and i > start:
            yield start, i - 1
            start, size = i, 0
        size += n
    yield start, last


def chunk(content: str, language: str | None) -> list[tuple[str | None, str, int, int, str]]:
    """(symbol, symbol_type, start_line, end_line, text) of a Python file, or one of no known syntax, by start line.

    A declaration is one chunk if it is small enough; else its head and its members; else pieces.  Lines outside all
    declarations that are not blank make one preamble, unless it is too long.
    """
    lines = content.split("\n")
    found = _python_spans(content) if language == "python" else None
    text = lambda a, b: "\n".join(lines[a - 1 : b])
    out: list[tuple[str | None, str, int, int, str]] = []

    def add(s: Span, member: bool) -> None:
        name, kind, a, b, members = s
        if len(text(a, b)) <= MAX_CHUNK:
            out.append((name, kind, a, b, text(a, b)))
        elif members and not member:
            head = text(a, members[0][2] - 1)
            if members[0][2] > a and head.strip() and len(head) <= MAX_CHUNK:
                out.append((name, kind, a, members[0][2] - 1, head))
            for m in members:
                add(m, True)
        else:
            out.extend((name, kind, x, y, text(x, y)) for x, y in pack(lines, a, b))

    for s in found or []:
        add(s, False)
    if found:
        inside = {i for s in found for i in range(s[2], s[3] + 1)}
        rest = [i for i in range(1, len(lines) + 1) if i not in inside and lines[i - 1].strip()]
        body = "\n".join(lines[i - 1] for i in rest)
        if rest and len(body) <= MAX_CHUNK:
            out.append((None, "preamble", rest[0], rest[-1], body))
    if not out:
        return [(None, "file", 1, len(lines), content)]
    return sorted(out, key=lambda c: c[2])


def calls(content: str, call_name: str = "last") -> list[tuple[str, str, int, int]]:
    """(caller, callee, line, pos) of a Python file's calls in order; ``call_name`` first or last picks a.b()'s name."""
    out: list[tuple[str, str, int, int]] = []
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def name_of(f) -> str | None:
        if isinstance(f, ast.Name):
            return f.id
        if isinstance(f, ast.Attribute):
            if call_name == "last":
                return f.attr
            return f.value.id if isinstance(f.value, ast.Name) else f.attr
        return None

    def walk(node, caller: str) -> None:
        for n in ast.iter_child_nodes(node):
            own = n.name if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else caller
            if isinstance(n, ast.Call) and (name := name_of(n.func)):
                out.append((caller, name, n.lineno, len(out)))
            walk(n, own)

    walk(tree, MODULE)
    return out


def python_usage(tree: ast.AST, line: int, symbol: str) -> str:
    """How a line of a parsed Python file uses a symbol: by the outermost node around the line that tells."""

    def visit(node) -> str | None:
        first = getattr(node, "lineno", None)
        if first is not None:
            top = min([first, *[d.lineno for d in getattr(node, "decorator_list", [])]])
            if not top <= line <= (node.end_lineno or first):
                return None
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                return "import"
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.name == symbol and first <= line:
                return "definition"
            if isinstance(node, ast.Call):
                return "call"
            if isinstance(node, (ast.Assign, ast.AnnAssign)):
                return "assignment"
        return next((found for n in ast.iter_child_nodes(node) if (found := visit(n))), None)

    return visit(tree) or "reference"


def _languages(files: DataFrame) -> set[str]:
    """The languages of files, from their paths alone; those that are not there need no plan."""
    return {r[0] for r in files.select(T.language(F.col("path"))).distinct().collect()}


def usages(files: DataFrame, hits: DataFrame) -> DataFrame:
    """(path, line, symbol, usage): how lines of Python files that parse, and of brace languages, use symbols, by syntax.

    ``files`` (path, content) and ``hits`` (path, line, symbol); a file is parsed once for all of its hits.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for p, text, wanted in zip(b["path"], b["content"], b["wanted"]):
                try:
                    tree = ast.parse(text)
                    rows += [(p, w["line"], w["symbol"], python_usage(tree, w["line"], w["symbol"])) for w in wanted]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "line", "symbol", "usage"])

    ship(files.sparkSession)
    per = hits.groupBy("path").agg(F.collect_list(F.struct("line", "symbol")).alias("wanted"))
    own = files.where(T.language(F.col("path")) == "python").select("path", "content").join(per, "path")
    by_tree = own.mapInPandas(run, "path string, line int, symbol string, usage string")
    if not _languages(files) & set(tokens.LANGUAGES):
        return by_tree
    found, declared = parsed(files)
    by_token = tokens.usages(found, declared, hits.select("symbol")).drop("enclosing_symbol")
    return by_tree.unionByName(by_token.join(hits.select("path", "line", "symbol"), ["path", "line", "symbol"], "left_semi"))


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens in statements, and the declarations, of files in brace languages; both written once."""
    found = written(tokens.statements(tokens.tokens(files)))
    return found, written(tokens.declared(tokens.items(found)))


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content): brace languages by their tokens, others a batch of files at a time."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(p, *c) for p, lang, text in zip(b["path"], b["language"], b["content"]) for c in chunk(text, lang)]
            yield pd.DataFrame(rows, columns=["path", "symbol", "symbol_type", "start_line", "end_line", "text"])

    ship(files.sparkSession)
    own = files.select("path", T.language(F.col("path")).alias("language"), "content").where(T.strip(F.col("content")) != "")
    others, known = own.where(~F.coalesce(F.col("language").isin(*tokens.LANGUAGES), F.lit(False))).mapInPandas(run, CHUNK), _languages(files)
    if not known & set(tokens.LANGUAGES):
        return others
    return others.unionByName(tokens.chunks(files)) if known - set(tokens.LANGUAGES) else tokens.chunks(files)


def syntax(files: DataFrame, call_name: str = "last", most: int | None = MAX_BYTES) -> DataFrame:
    """Spans and calls of files (path, content) in one parse of each; ``pos`` is their order in the file.

    Each file also has a row of kind ``file``, or ``error`` where it does not parse.  Files of more than ``most`` bytes
    are left out.
    """
    import pandas as pd

    def flat(found, depth=0):
        for s in found:
            yield s
            yield from flat(s[4], depth + 1)

    def run(batches):
        for b in batches:
            rows = []
            for p, text in zip(b["path"], b["content"]):
                found = _python_spans(text)
                rows.append((p, "file" if found is not None else "error", None, None, 0, 0, None, 0))
                rows += [(p, "span", s[0], s[1], s[2], s[3], None, i) for i, s in enumerate(flat(found or []))]
                rows += [(p, "call", callee, None, line, line, caller, pos) for caller, callee, line, pos in calls(text, call_name)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "symbol_type", "start_line", "end_line", "caller", "pos"])

    ship(files.sparkSession)
    own = (files if most is None else files.where(F.octet_length("content") <= most)).select("path", T.language(F.col("path")).alias("language"), "content").where("language is not null")
    by_tree = own.where("language = 'python'").select("path", "content").mapInPandas(run, SYNTAX)
    if not _languages(own) & set(tokens.LANGUAGES):
        return by_tree
    braces = own.where("language <> 'python'").select("path", "content")
    found, declared = parsed(braces)
    no = lambda kind="string": F.lit(None).cast(kind)
    row = lambda df, kind, name, type_, a, b, caller, pos: df.select("path", F.lit(kind).alias("kind"), name.alias("name"), type_.alias("symbol_type"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), caller.alias("caller"), pos.cast("int").alias("pos"))
    zero, c = F.lit(0), F.col
    calls_ = tokens.call_edges(found, declared, MODULE, call_name).withColumnRenamed("caller_path", "path")
    return (
        by_tree.unionByName(row(braces, "file", no(), no(), zero, zero, no(), zero)).unionByName(row(tokens.spans(declared), "span", c("name"), c("symbol_type"), c("start_line"), c("end_line"), no(), c("pos")))
        .unionByName(row(calls_, "call", c("callee"), no(), c("call_line"), c("call_line"), c("caller"), c("pos")))
    )


def edges(syntax: DataFrame) -> DataFrame:
    return syntax.where("kind = 'call'").select("caller", F.col("path").alias("caller_path"), F.col("name").alias("callee"), F.col("start_line").alias("call_line"), "pos")


def declarations(syntax: DataFrame) -> DataFrame:
    return syntax.where("kind = 'span'").select("path", "name", "symbol_type", "start_line", "end_line", "pos")


def scan_stats(syntax: DataFrame) -> DataFrame:
    """One row: files_scanned, and how many of them did not parse (parse_errors)."""
    return syntax.agg(F.count_if(F.col("kind").isin("file", "error")).alias("files_scanned"), F.count_if(F.col("kind") == "error").alias("parse_errors"))


def new_file_sections(lines: DataFrame, files: DataFrame, include_context: bool = False, with_changes: bool = False) -> DataFrame:
    """Sections of new files by syntax: the file is rebuilt from added lines, chunked, and lines fall into chunks.

    The lines come as ``changes`` if asked for.  A line may fall into several chunks; missing numbers are empty lines.  Files without chunks give no row.
    """
    key = ["review_id", "file_ord", "file_path"]
    new = files.where("new_file").select(*key)
    own = lines.join(new, key, "left_semi")
    added = own.where("type = 'add'").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("new_line", "content"))).alias("m"), F.max("new_line").alias("last"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), "\n")
    name = F.to_json(F.struct(*key))
    built = added.where(T.language(F.col("file_path")).isNotNull()).select(F.concat(name, F.lit("\x00"), F.col("file_path")).alias("path"), body.alias("content"))
    found = chunks(built).where("symbol_type <> 'file'").select(F.from_json(F.split_part("path", F.lit("\x00"), F.lit(1)), "review_id string, file_ord long, file_path string").alias("k"), "symbol", "symbol_type", "start_line", "end_line")
    found = found.select("k.*", "symbol", "symbol_type", "start_line", "end_line")
    kept = own if include_context else own.where("type <> 'context'")
    ref = F.coalesce(F.when(F.col("new_line") > 0, F.col("new_line")), "old_line")
    hit = found.join(kept.withColumn("ref", ref), key).where("ref between start_line and end_line")
    row = F.struct("hunk_no", "pos", "type", "old_line", "new_line", "content")
    extra = [F.array_sort(F.collect_list(row)).alias("changes")] if with_changes else []
    return hit.groupBy(*key, "symbol", "symbol_type", "start_line", "end_line").agg(F.count(F.when(F.col("type") != "context", 1)).alias("changed_lines"), *extra)


def register(spark: SparkSession) -> None:
    """Register ``chunk_source(content, language)`` as a table function for SQL's LATERAL; brace languages: ``chunks``."""
    from pyspark.sql.functions import udtf

    ship(spark)

    @udtf(returnType="symbol string, symbol_type string, start_line int, end_line int, text string")
    class ChunkSource:
        def eval(self, content: str, language: str):
            yield from chunk(content or "", language)

    spark.udtf.register("chunk_source", ChunkSource)
