"""Hunks to symbols: enclosing declarations, merged sections, changed symbols, identifiers, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .diff import FILE

MAX_SYMBOLS, MIN_IDENTIFIER = 8, 3
#: Words that are never taken for identifiers.
STOPWORDS = (
    "if", "else", "elif", "for", "while", "do", "switch", "case", "break", "continue", "return", "yield", "try",
    "catch", "finally", "throw", "raises", "with", "as", "in", "not", "and", "or", "is", "new", "delete", "typeof",
    "instanceof", "await", "async", "def", "class", "function", "const", "let", "var", "val", "fun", "fn", "pub",
    "priv", "private", "public", "protected", "static", "final", "abstract", "override", "open", "sealed", "data",
    "enum", "interface", "struct", "impl", "trait", "mod", "use", "import", "from", "export", "package", "void",
    "int", "long", "float", "double", "bool", "boolean", "str", "string", "true", "false", "null", "None", "nil",
    "undefined", "NaN", "Infinity", "this", "self", "super", "it", "to", "of", "at", "be", "by", "on",
)
#: Fixed value: what an identifier is; the second form is its ASCII part.
IDENTIFIER, ASCII_IDENTIFIER = r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\b", r"([A-Za-z_][A-Za-z0-9_]*)"


def _hunks(lines: DataFrame, *extra) -> DataFrame:
    """Per hunk: symbol, symbol_type and ``extra`` aggregates, in one aggregate that shares the lines' exchange by file."""
    hunk = Window.partitionBy(*FILE, "hunk_no")
    first = F.min(F.when(F.col("type") != "context", F.col("pos"))).over(hunk)
    name = F.when(F.col("type") == "context", T.declared_name(F.col("content"), T.language(F.col("file_path"))))
    rows = lines.withColumns({"first_change": first, "name": name})
    found = F.struct("name", "content")
    lead = F.col("name").isNotNull() & (F.col("first_change").isNull() | (F.col("pos") < F.col("first_change")))
    per = rows.groupBy(*FILE, "hunk_no").agg(
        F.first("hint").alias("hint"),
        F.max_by(found, F.when(lead, F.col("pos"))).alias("lead"),
        F.min_by(found, F.when(F.col("name").isNotNull(), F.col("pos"))).alias("any"),
        *extra,
    )
    hint = T.hint_name(F.col("hint"))
    symbol = F.coalesce(hint, "lead.name", "any.name")
    source = F.when(hint.isNotNull(), F.col("hint")).otherwise(F.coalesce("lead.content", "any.content"))
    kind = F.when(symbol.isNull(), "unknown").otherwise(T.symbol_type(source))
    return per.withColumns({"symbol": symbol, "symbol_type": kind}).drop("hint", "lead", "any")


def hunk_symbols(lines: DataFrame) -> DataFrame:
    """Per hunk: symbol and symbol_type, or null and 'unknown'.

    A name in the header's hint wins; else the nearest declaration in the context before the first change; else the
    first declaration in any context line.
    """
    return _hunks(lines)


def hunk_sections(lines: DataFrame, include_context: bool = False, with_changes: bool = False) -> DataFrame:
    """Sections of files by hunk context: neighbouring hunks of one symbol merged.

    Columns: the FILE columns, section_no, symbol, symbol_type, start_line, end_line, changed_lines (added and
    deleted) and, if asked for, the lines themselves as ``changes``.
    """
    kept = F.lit(True) if include_context else F.col("type") != "context"
    number = lambda c: F.when(kept & (F.col(c) > 0), F.col(c))
    row = F.struct("hunk_no", "pos", "type", "old_line", "new_line", "content")
    per = _hunks(
        lines,
        F.coalesce(F.min(number("new_line")), F.min(number("old_line")), F.first("new_start")).alias("start_line"),
        F.coalesce(F.max(number("new_line")), F.max(number("old_line")), F.first("new_start")).alias("end_line"),
        F.count_if(F.col("type") != "context").alias("changed_lines"),
        F.count_if(kept).alias("kept"),
        *([F.collect_list(F.when(kept, row)).alias("changes")] if with_changes else []),
    )
    per = per.where("kept > 0")
    order = Window.partitionBy(*FILE).orderBy("hunk_no")
    fresh = ~F.coalesce(F.col("symbol") == F.lag("symbol").over(order), F.lit(False))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("fresh", fresh.cast("int")).withColumn("section_no", F.sum("fresh").over(upto).cast("int"))
    extra = [F.array_sort(F.flatten(F.collect_list("changes"))).alias("changes")] if with_changes else []
    return per.groupBy(*FILE, "section_no").agg(
        F.first("symbol").alias("symbol"),
        F.min_by("symbol_type", "hunk_no").alias("symbol_type"),
        F.min_by("start_line", "hunk_no").alias("start_line"),
        F.max_by("end_line", "hunk_no").alias("end_line"),
        F.sum("changed_lines").alias("changed_lines"),
        *extra,
    )


def changed_symbols(sections: DataFrame) -> DataFrame:
    """Per file and symbol: changed_lines, symbol_type as first seen, and the place in the file's order."""
    per = sections.where("symbol is not null").groupBy(*FILE, "symbol").agg(
        F.sum("changed_lines").alias("changed_lines"), F.min_by("symbol_type", "section_no").alias("symbol_type"), F.min("section_no").alias("first_section")
    )
    return per.where("changed_lines > 0")


def top_symbols(sections: DataFrame, n: int = MAX_SYMBOLS) -> DataFrame:
    """Per review: the n symbols with most changed lines, ties as first seen."""
    seen = F.struct("file_ord", (-F.col("changed_lines")).alias("less"), "first_section")
    per = changed_symbols(sections).groupBy("review_id", "symbol").agg(F.sum("changed_lines").alias("weight"), F.min_by("symbol_type", seen).alias("symbol_type"), F.min(seen).alias("seen"))
    order = Window.partitionBy("review_id").orderBy(F.desc("weight"), "seen")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("review_id", "rank", "symbol", "symbol_type", "weight")


def top_identifiers(lines: DataFrame, n: int = MAX_SYMBOLS, pattern: str = IDENTIFIER) -> DataFrame:
    """Per review: the n identifiers most frequent in added lines, ties as first seen."""
    words = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    rows = lines.where("type = 'add'").select("review_id", "file_ord", "hunk_no", "pos", F.posexplode(words).alias("at", "symbol"))
    rows = rows.where((F.length("symbol") >= MIN_IDENTIFIER) & ~F.col("symbol").isin(*STOPWORDS))
    per = rows.groupBy("review_id", "symbol").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("file_ord", "hunk_no", "pos", "at")).alias("seen"))
    order = Window.partitionBy("review_id").orderBy(F.desc("weight"), "seen")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("review_id", "rank", "symbol", "weight")


def review_symbols(sections: DataFrame, lines: DataFrame, n: int = MAX_SYMBOLS) -> DataFrame:
    """Changed declarations of reviews that have any; identifiers of the others; ``source`` tells which."""
    declared = top_symbols(sections, n).withColumn("source", F.lit("ast"))
    rest = lines.join(declared.select("review_id").distinct(), "review_id", "left_anti")
    found = top_identifiers(rest, n).select("review_id", "rank", "symbol", F.lit(None).cast("string").alias("symbol_type"), "weight", F.lit("identifier-fallback").alias("source"))
    return declared.unionByName(found)


def first_context(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per (review_id, symbol) of ``symbols``: the first line, not deleted, that contains the symbol."""
    place = F.struct("file_ord", "hunk_no", "pos")
    both = lines.where("type <> 'del'").join(symbols.select("review_id", "symbol"), "review_id")
    both = both.where(F.contains("content", "symbol"))
    snippet = F.substring(T.strip(F.min_by("content", place)), 1, 200)
    return both.groupBy("review_id", "symbol").agg(snippet.alias("snippet"))
