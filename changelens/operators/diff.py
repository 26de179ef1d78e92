"""Patches to relations: files, hunks, lines; the size budget; nearest-line mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .prefix import running

FILE = ["review_id", "file_ord", "file_path"]
#: The headers of hunks in the unified diff format, and what stands after them.
HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HINT = r"^@@ [^@]+ @@ ?(.+)$"
MAX_CHARS = 80_000
#: Files of a review that are summed up together.
BLOCK = 4096


def measured(files: DataFrame, heads: bool = False) -> DataFrame:
    """``files`` with additions, deletions, skip_reason and reviewable, and the ``heads`` of hunks if asked for; no shuffle, and ``patch`` can be pruned."""
    out = files.withColumn("__lines", T.split_lines(F.col("patch")))  # once for both counts
    own = {"additions": T.count_lines(F.col("__lines"), "+"), "deletions": T.count_lines(F.col("__lines"), "-")} | ({"heads": _heads(F.col("__lines"))} if heads else {})
    out = out.withColumns(own).drop("__lines")
    out = out.withColumn("skip_reason", T.skip_reason(F.col("file_path"), F.col("additions") + F.col("deletions")))
    return out.withColumn("reviewable", F.col("skip_reason").isNull())


def _heads(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.startswith("@@ -") & x.rlike(HEADER))


def hunk_lines(files: DataFrame) -> DataFrame:
    """One row per diff line with exact old and new numbers; one exchange, by file.

    Lines before the first header and markers of a missing last newline give no row; a hunk without lines gives none.
    """
    rows = files.select(*FILE, F.posexplode(T.split_lines(F.col("patch"))).alias("pos", "raw"))
    raw = F.col("raw")
    part = lambda k: F.regexp_extract(raw, HEADER, k).try_cast("int")
    start = F.when(
        raw.startswith("@@ -") & raw.rlike(HEADER),
        F.struct(
            part(1).alias("old_start"),
            F.coalesce(part(2), F.lit(1)).alias("old_lines"),
            part(3).alias("new_start"),
            F.coalesce(part(4), F.lit(1)).alias("new_lines"),
            F.nullif(T.strip(F.regexp_extract(raw, HINT, 1)), F.lit("")).alias("hint"),
        ),
    )
    upto = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", start)
    rows = rows.withColumns({"hunk_no": F.count("start").over(upto), "head": F.last("start", ignorenulls=True).over(upto)})
    rows = rows.where("start is null and hunk_no > 0 and not startswith(raw, '\\\\')")
    kind = F.when(raw.startswith("+") & ~raw.startswith("+++"), "add").when(raw.startswith("-") & ~raw.startswith("---"), "del").otherwise("context")
    rows = rows.withColumn("type", kind)
    before = Window.partitionBy(*FILE, "hunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda side: F.coalesce(F.count(F.when(F.col("type") != side, 1)).over(before), F.lit(0)).cast("int")
    rows = rows.withColumns({"old_seen": count("add"), "new_seen": count("del")})
    return rows.select(
        *FILE,
        F.col("hunk_no").cast("int").alias("hunk_no"),
        "pos",
        "type",
        F.when(F.col("type") != "add", F.col("head.old_start") + F.col("old_seen")).alias("old_line"),
        F.when(F.col("type") != "del", F.col("head.new_start") + F.col("new_seen")).alias("new_line"),
        F.when((F.col("type") == "context") & ~raw.startswith(" "), raw).otherwise(F.expr("substring(raw, 2)")).alias("content"),
        "head.old_start",
        "head.old_lines",
        "head.new_start",
        "head.new_lines",
        "head.hint",
    )


def path_filter(files: DataFrame, fragments: list[str] | None) -> DataFrame:
    """Files whose path contains any fragment; an empty filter keeps all.  It is pushed below any parsing."""
    if not fragments:
        return files
    return files.where(F.greatest(*[F.col("file_path").contains(f) for f in fragments], F.lit(False)))


def budget(files: DataFrame, max_chars: int = MAX_CHARS, skip_noise: bool = True, cost: str = "cost") -> DataFrame:
    """``files`` (measured, with a cost) plus used_chars and status: returned, omitted or skipped.

    The first candidate of a review is always returned, the rest until the sum of costs passes the budget; noise is
    skipped even after that point.
    """
    noise = (~F.col("reviewable")) & F.lit(skip_noise)
    sums = {"used_chars": F.when(~noise, F.col(cost)).otherwise(0), "rank": F.when(~noise, 1).otherwise(0)}
    out = running(files, "review_id", F.floor(F.col("file_ord") / BLOCK), ["file_ord"], sums)
    status = F.when(noise, "skipped").when((F.col("rank") == 1) | (F.col("used_chars") <= max_chars), "returned").otherwise("omitted")
    return out.withColumn("status", status).drop("rank")


def json_string(c: Column) -> Column:
    """Characters of a string in JSON that is pure ASCII: quotes, escapes of two, six or (beyond 16 bits) twelve."""
    count = lambda others: F.length(F.regexp_replace(c, f"{others}+", ""))  # noqa: E731  # by runs of the others, not by characters
    short, other = count(r'[^"\\\n\r\t\x08\x0C]'), count(r"[ -~\x08\x09\x0A\x0C\x0D]")
    plain = F.octet_length(c) == F.length(c)
    far = F.when(plain, 0).otherwise(count(r"[^\x{10000}-\x{10FFFF}]"))
    return F.when(c.isNull(), 4).otherwise(2 + F.length(c) + short + 5 * other + 6 * far)


def json_plain(c: Column) -> Column:
    """Characters of a number, a truth value or null in JSON."""
    return F.coalesce(F.length(c.cast("string")), F.lit(4))


def json_object(*keys: str) -> int:
    """Characters of an object of such keys without its values, with ", " and ": " between."""
    return 2 + sum(len(k) + 4 for k in keys) + 2 * (len(keys) - 1)


def json_array(n: Column, total: Column) -> Column:
    """Characters of an array of ``n`` values of ``total`` characters."""
    return 2 + total + F.when(n > 0, 2 * (n - 1)).otherwise(0)


def line_cost(x: Column | None = None) -> Column:
    """Characters of a diff line's JSON: of a row, or of a struct."""
    f = F.col if x is None else x.__getitem__
    return json_object("type", "old_line", "new_line", "content") + json_string(f("type")) + json_plain(f("old_line")) + json_plain(f("new_line")) + json_string(f("content"))


def hunk_heads(files: DataFrame) -> DataFrame:
    """One row per hunk, also of those without lines: hunk_no and the four numbers of its header."""
    heads = F.filter(T.split_lines(F.col("patch")), lambda x: x.rlike(HEADER))
    rows = files.select(*FILE, F.posexplode(heads).alias("at", "raw"))
    part = lambda k: F.regexp_extract("raw", HEADER, k).try_cast("int")
    numbers = [part(1), F.coalesce(part(2), F.lit(1)), part(3), F.coalesce(part(4), F.lit(1))]
    return rows.select(*FILE, (F.col("at") + 1).alias("hunk_no"), *[n.alias(k) for n, k in zip(numbers, ("old_start", "old_lines", "new_start", "new_lines"))])


def entry_costs(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(FILE columns, cost): characters of each measured file's entry as JSON, its hunks and their lines included."""
    return priced(files, lines).select(*FILE, "cost")


def priced(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Measured ``files`` without their patches and with their ``cost``, as ``entry_costs`` has it; patches are read once for both, and split once if they come with ``heads``."""
    per_line = lines.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), F.sum(line_cost()).alias("chars"), F.count_distinct("hunk_no").alias("full"))

    def head_cost(raw):
        """Characters of a hunk's entry without its lines, from its header."""
        part = lambda k: F.regexp_extract(raw, HEADER, k).try_cast("int")
        numbers = [part(1), F.coalesce(part(2), F.lit(1)), part(3), F.coalesce(part(4), F.lit(1))]
        return json_object("old_start", "old_lines", "new_start", "new_lines", "lines") + 2 + sum(map(json_plain, numbers[1:]), json_plain(numbers[0]))

    heads = F.coalesce("heads", F.array().cast("array<string>")) if "heads" in files.columns else _heads(T.split_lines(F.coalesce("patch", F.lit(""))))
    own = files.withColumn("costs", F.transform(heads, head_cost)).drop("patch", "heads")
    own = own.withColumns({"hunks": F.size("costs"), "heads": F.aggregate("costs", F.lit(0), lambda a, x: a + x)})
    both = own.join(per_line, FILE, "left").fillna(0, ["n", "chars", "full"])
    hunks = json_array(F.col("hunks"), F.col("heads") + F.col("chars") + 2 * (F.col("n") - F.col("full")))
    flags = ["new_file", "deleted_file", "renamed_file", "additions", "deletions"]
    entry = json_object("file_path", "old_path", *flags, "hunks") + json_string(F.col("file_path")) + json_string(F.col("old_path")) + sum((json_plain(F.col(c)) for c in flags), F.lit(0))
    return both.select(*[c for c in files.columns if c not in ("patch", "heads")], (entry + hunks).cast("long").alias("cost"))


def section_costs(files: DataFrame, sections: DataFrame) -> DataFrame:
    """(FILE columns, cost): characters of each measured file's entry as JSON, from sections with their ``changes``."""
    values = json_string(F.col("symbol")) + json_string(F.col("symbol_type")) + json_plain(F.col("start_line")) + json_plain(F.col("end_line"))
    lines = F.aggregate(F.transform("changes", line_cost), F.lit(0), lambda a, x: a + x)
    one = json_object("symbol", "symbol_type", "start_line", "end_line", "changes") + values + json_array(F.size("changes"), lines)
    per = sections.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("chars"))
    both = files.join(per, FILE, "left").fillna(0, ["n", "chars"])
    flags = ["new_file", "deleted_file", "additions", "deletions"]
    own = json_object("file_path", "language", *flags, "sections") + json_string(F.col("file_path")) + json_string(T.language(F.col("file_path"))) + sum((json_plain(F.col(c)) for c in flags), F.lit(0))
    return both.select(*FILE, (own + json_array(F.col("n"), F.col("chars"))).cast("long").alias("cost"))


def line_mappings(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """For each wanted new-side line of a file, the same or the nearest line of the diff.

    ``targets``: the FILE columns and ``requested`` (array).  Ties go to the line that comes first in the diff; a
    file without new-side lines gives nulls.  Lines join on the file, so the plan is a hash or merge join.
    """
    wanted = targets.select(*FILE, F.explode(F.array_sort(F.array_distinct("requested"))).alias("requested"))
    side = lines.where("new_line is not null").select(*FILE, "hunk_no", "pos", "new_line", "old_line", "type", "content")
    near = F.struct(F.abs(F.col("new_line") - F.col("requested")).alias("d"), "hunk_no", "pos")
    row = F.struct("new_line", "old_line", "type", "content")
    best = wanted.join(side, FILE, "left").groupBy(*FILE, "requested").agg(F.min_by(row, F.when(F.col("new_line").isNotNull(), near)).alias("best"))
    exact = F.coalesce(F.col("best.new_line") == F.col("requested"), F.lit(False))
    return best.select(*FILE, "requested", "best.new_line", "best.old_line", "best.type", "best.content", exact.alias("exact"))
