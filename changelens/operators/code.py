"""References to symbols in source lines, enclosing declarations, call edges and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PER_FILE, MAX_RESULTS = 5, 50
MAX_FILES, MAX_BYTES = 500, 200_000
MODULE = "<module>"
#: Most symbols that are looked for in one pass.
MAX_PARTS = 1000


def source_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text): the lines of files, numbered from 1."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n", -1)).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def references(lines: DataFrame, symbols: DataFrame, whole_word: bool = True, per_file: int = PER_FILE, most: int = MAX_RESULTS) -> DataFrame:
    """Lines that use each of ``symbols`` (symbol), at most ``per_file`` of a file and ``most`` in all, by path and line.

    One pass over the lines for up to MAX_PARTS symbols: a line is reduced to those of its words that are asked for
    before anything is exploded.  More symbols than that join the lines' words; parts of words, which have nothing to
    join on, are looked for in as many passes as there are blocks of MAX_PARTS.
    The over-fetch of twice ``most`` before the cut changes nothing once the order is fixed.
    """
    wanted = symbols.select("symbol").where("symbol is not null").distinct()
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    some = [r[0] for r in wanted.limit(MAX_PARTS + 1).collect()]
    if len(some) <= MAX_PARTS:
        asked = F.array(*map(F.lit, some)).cast("array<string>")
        own = F.array_intersect(words, asked) if whole_word else F.filter(asked, lambda x: F.contains("text", x))
        hits = lines.withColumn("symbol", F.explode(own))
    elif whole_word:
        hits = lines.withColumn("symbol", F.explode(F.array_distinct(words))).join(wanted, "symbol")
    else:
        hits, part = None, []
        for r in wanted.orderBy("symbol").toLocalIterator():
            part.append(r[0])
            if len(part) == MAX_PARTS:
                hits, part = _holding(lines, part, hits), []
        hits = _holding(lines, part, hits)
    near = Window.partitionBy("symbol", "path").orderBy("line")
    hits = hits.withColumn("n", F.row_number().over(near)).where(F.col("n") <= per_file)
    order = Window.partitionBy("symbol").orderBy("path", "line")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return hits.select("symbol", "rank", "path", "line", T.strip(F.col("text")).alias("context"), T.usage_type(F.col("text"), F.col("symbol")).alias("usage_type"))


def _holding(lines: DataFrame, part: list[str], others: DataFrame | None) -> DataFrame:
    asked = F.array(*map(F.lit, part)).cast("array<string>")
    own = lines.withColumn("symbol", F.explode(F.filter(asked, lambda x: F.contains("text", x))))
    return own if others is None else others.unionByName(own)


def counts(references: DataFrame, by: str) -> DataFrame:
    """Per symbol: references by ``path`` or ``usage_type``, most first, ties as first seen."""
    per = references.groupBy("symbol", by).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("seen"))
    order = Window.partitionBy("symbol").orderBy(F.desc("n"), "seen")
    return per.select("symbol", by, "n", F.row_number().over(order).alias("place"))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points`` (path, line) with the name of the smallest of ``spans`` (path, start_line, end_line, name, pos) around each.

    Of equally small spans the outermost, which has the least pos, wins.  The join is on the path.
    """
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "pos")
    both = points.select("path", "line").distinct().join(spans, "path").where("line between start_line and end_line")
    best = both.groupBy("path", "line").agg(F.min_by("name", size).alias("enclosing_symbol"))
    return points.join(best, ["path", "line"], "left")


def callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of each symbol: caller (or <module>), path, call line; once per path and line."""
    hits = edges.join(symbols.select(F.col("symbol").alias("callee")).distinct(), "callee")
    once = Window.partitionBy("callee", "caller_path", "call_line").orderBy("pos")
    hits = hits.withColumn("n", F.row_number().over(once)).where("n = 1")
    return hits.select(F.col("callee").alias("symbol"), F.coalesce("caller", F.lit(MODULE)).alias("name"), F.col("caller_path").alias("file_path"), "call_line")


def callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """What each symbol calls, itself left out, once per name, the first call staying."""
    hits = edges.join(symbols.select(F.col("symbol").alias("caller")).distinct(), "caller").where("callee <> caller")
    first = F.struct("pos", "caller_path", "call_line")
    per = hits.groupBy("caller", "callee").agg(F.min(first).alias("f"))
    return per.select(F.col("caller").alias("symbol"), F.col("callee").alias("name"), F.col("f.caller_path").alias("file_path"), F.col("f.call_line").alias("line"))


def definitions(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """The first span of each symbol in scan order: path, then position."""
    hits = spans.join(symbols.select(F.col("symbol").alias("name")).distinct(), "name")
    per = hits.groupBy("name").agg(F.min_by(F.struct("path", "start_line", "symbol_type"), F.struct("path", "pos")).alias("d"))
    return per.select(F.col("name").alias("symbol"), F.col("d.path").alias("file_path"), F.col("d.start_line").alias("line"), F.col("d.symbol_type").alias("type"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(symbol, name, depth): what each symbol reaches in at most ``depth`` calls, by the least number of them."""
    step = edges.select(F.col("caller").alias("name"), "callee").distinct()
    front = starts.select("symbol", F.col("symbol").alias("name"), F.lit(0).alias("depth")).distinct()
    out = front
    for d in range(1, depth + 1):
        new = front.join(step, "name").select("symbol", F.col("callee").alias("name")).distinct()
        front = new.join(out, ["symbol", "name"], "left_anti").withColumn("depth", F.lit(d))
        out = out.unionByName(front)
    return out.where("depth > 0")
