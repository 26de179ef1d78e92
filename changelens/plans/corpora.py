"""Virtual corpora: review-shaped views over the driver's tables, defined alike for Spark and in SQL.

Everything is arithmetic on keys; Spark builds patches and parses them back, SQL computes lines directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table

PATH = """CASE WHEN doc_id % 23 = 0 THEN concat('d', doc_id % 5, '/f', doc_id, '/yarn.lock')
 WHEN doc_id % 10 = 7 THEN concat('d', doc_id % 5, '/vendor/f', doc_id, '.py') WHEN doc_id % 10 = 8 THEN concat('d', doc_id % 5, '/f', doc_id, '.min.js')
 WHEN doc_id % 10 = 9 THEN concat('d', doc_id % 5, '/f', doc_id, '.PNG') WHEN doc_id % 10 IN (0, 1, 2, 3) THEN concat('d', doc_id % 5, '/f', doc_id, '.py')
 WHEN doc_id % 10 = 4 THEN concat('d', doc_id % 5, '/f', doc_id, '.go') WHEN doc_id % 10 = 5 THEN concat('d', doc_id % 5, '/f', doc_id, '.ts')
 ELSE concat('d', doc_id % 5, '/f', doc_id, '.kt') END"""

#: The lines of the virtual diffs: documents' lines in hunks of eight, signs and declarations by arithmetic.
LINES_SQL = f"""
fd AS (SELECT doc_id, source AS review_id, doc_id AS file_ord, {PATH} AS file_path, doc_id % 11 = 0 AS new_file, coalesce(text, '') AS text FROM documents),
r0 AS (SELECT doc_id, review_id, file_ord, file_path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM fd),
r1 AS (SELECT *, i // 8 AS h, CASE (i + doc_id) % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS sign,
  CASE WHEN (i + doc_id) % 4 >= 2 AND i % 5 = 0 THEN concat('def fn_', (doc_id + i) % 7, '(x):') ELSE line END AS body FROM r0),
r2 AS (SELECT *, CASE WHEN sign = '+' AND NOT starts_with(body, '++') THEN 'add' WHEN sign = '-' AND NOT starts_with(body, '--') THEN 'del' ELSE 'context' END AS type FROM r1),
l AS (SELECT review_id, file_ord, file_path, doc_id, CAST(h + 1 AS INTEGER) AS hunk_no, i, type,
  CASE WHEN type <> 'add' THEN CAST(1 + 20 * h + count(*) FILTER (type <> 'add') OVER b AS INTEGER) END AS old_line,
  CASE WHEN type <> 'del' THEN CAST(1 + 25 * h + count(*) FILTER (type <> 'del') OVER b AS INTEGER) END AS new_line,
  CASE WHEN type = 'context' AND sign <> ' ' THEN sign || body ELSE body END AS content,
  CASE WHEN h % 3 <> 2 THEN concat('def sym_', (doc_id + h // 2) % 37, '():') END AS hint, 1 + 25 * h AS new_start
  FROM r2 WINDOW b AS (PARTITION BY doc_id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

REASON_SQL = """CASE WHEN lower(file_path) LIKE '%/yarn.lock' THEN 'lockfile' WHEN lower(file_path) LIKE '%.min.js' THEN 'generated'
 WHEN lower(file_path) LIKE '%/vendor/%' THEN 'vendored/build artifact' WHEN lower(file_path) LIKE '%.png' THEN 'binary/asset'
 WHEN additions + deletions > 2000 THEN concat('very large change (', additions + deletions, ' lines, likely generated)') END"""
FILES_SQL = f"""
m0 AS (SELECT review_id, file_ord, file_path, CAST(count(*) FILTER (type = 'add') AS INTEGER) AS additions, CAST(count(*) FILTER (type = 'del') AS INTEGER) AS deletions FROM l GROUP BY ALL),
m AS (SELECT *, {REASON_SQL} AS skip_reason, {REASON_SQL} IS NULL AS reviewable FROM m0)"""

SYMBOLS_SQL = """
n0 AS (SELECT *, CASE WHEN type = 'context' AND (file_path LIKE '%.py') THEN nullif(regexp_extract(content, '^\\s*(?:async\\s+)?def\\s+([A-Za-z0-9_]+)', 1), '') END AS name,
  min(CASE WHEN type <> 'context' THEN i END) OVER (PARTITION BY doc_id, hunk_no) AS first_change FROM l),
hs AS (SELECT review_id, file_ord, file_path, hunk_no,
  coalesce(regexp_extract(any_value(hint), 'def\\s+([A-Za-z0-9_]+)', 1), arg_max(name, i) FILTER (name IS NOT NULL AND (first_change IS NULL OR i < first_change)), arg_min(name, i) FILTER (name IS NOT NULL)) AS symbol
  FROM n0 GROUP BY ALL)"""

SECTIONS_SQL = """
p0 AS (SELECT review_id, file_ord, file_path, hunk_no, coalesce(min(new_line), min(old_line), any_value(new_start)) AS start_line,
  coalesce(max(new_line), max(old_line), any_value(new_start)) AS end_line, count(*) AS changed_lines FROM l WHERE type <> 'context' GROUP BY ALL),
p1 AS (SELECT p0.*, symbol, CASE WHEN symbol IS NULL THEN 'unknown' ELSE 'function' END AS symbol_type FROM p0 JOIN hs USING (review_id, file_ord, file_path, hunk_no)),
p2 AS (SELECT *, CASE WHEN coalesce(symbol = lag(symbol) OVER (PARTITION BY file_ord ORDER BY hunk_no), false) THEN 0 ELSE 1 END AS fresh FROM p1),
p3 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_ord ORDER BY hunk_no) AS INTEGER) AS section_no FROM p2),
sec AS (SELECT review_id, file_ord, file_path, section_no, any_value(symbol) AS symbol, arg_min(symbol_type, hunk_no) AS symbol_type,
  CAST(arg_min(start_line, hunk_no) AS INTEGER) AS start_line, CAST(arg_max(end_line, hunk_no) AS INTEGER) AS end_line, CAST(sum(changed_lines) AS BIGINT) AS changed_lines FROM p3 GROUP BY ALL)"""

THREADS_SQL = f"""
docs AS (SELECT doc_id, source AS review_id, {PATH} AS file_path FROM documents),
nt AS (SELECT d.review_id, c.conv_id, CAST(c.turn AS INTEGER) AS note_ord, c.role AS author, c.text AS body, c.role = 'system' AS system,
  CASE WHEN c.conv_id % 7 <> 0 THEN CASE WHEN c.conv_id % 5 = 1 THEN regexp_extract(d.file_path, '[^/]+$') ELSE d.file_path END END AS file_path,
  CASE WHEN c.conv_id % 6 <> 0 THEN CAST(1 + c.conv_id % 45 AS INTEGER) END AS line, c.conv_id % 3 = 0 AS resolved
  FROM conversations c JOIN docs d ON d.doc_id = c.conv_id // 2),
th AS (SELECT review_id, conv_id, any_value(file_path) AS file_path, any_value(line) AS line, any_value(resolved) AS resolved,
  arg_min(body, note_ord) AS first_any, arg_min(body, note_ord) FILTER (NOT system) AS first_body, count(*) FILTER (NOT system) AS people FROM nt GROUP BY review_id, conv_id),
dt AS (SELECT *, line IS NOT NULL AND coalesce(file_path, '') <> '' AS located FROM th WHERE people > 0
  QUALIFY row_number() OVER (PARTITION BY review_id, file_path, line, substr(first_body, 1, 200) ORDER BY conv_id) = 1)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = documents(spark, sf_dir).select("doc_id", "source", F.expr(PATH).alias("path"), lines.alias("lines"))
    d = F.col("doc_id")

    def signed(h):
        def line(x, j):
            i = h * 8 + j
            k = (i + d) % 4
            body = F.when((k >= 2) & (i % 5 == 0), F.concat(F.lit("def fn_"), ((d + i) % 7).cast("string"), F.lit("(x):"))).otherwise(x)
            return F.concat(F.when(k == 0, "+").when(k == 1, "-").otherwise(" "), body)

        return line

    def hunk(h):
        hint = F.when(h % 3 != 2, F.concat(F.lit(" def sym_"), ((d + F.floor(h / 2)) % 37).cast("string"), F.lit("():"))).otherwise("")
        head = F.concat(F.lit("@@ -"), (h * 20 + 1).cast("string"), F.lit(",8 +"), (h * 25 + 1).cast("string"), F.lit(",8 @@"), hint)
        return F.concat(F.array(head), F.transform(F.slice("lines", h * 8 + 1, 8), signed(h)))

    hunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 8).cast("int")), hunk)
    return docs.select(
        F.col("source").alias("review_id"), d.alias("file_ord"), F.col("path").alias("file_path"), F.col("path").alias("old_path"), (d % 11 == 0).alias("new_file"), (d % 13 == 0).alias("deleted_file"),
        (d % 17 == 0).alias("renamed_file"), F.array_join(F.flatten(hunks), "\n").alias("patch"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, disc_ord, id, resolved, file_path, line, notes)."""
    c = table(spark, sf_dir, "conversations")
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("review_id"), F.expr(PATH).alias("p"))
    rows = c.join(d, F.floor(c["conv_id"] / 2) == d["doc_id"])
    k = F.col("conv_id")
    path = F.when(k % 7 != 0, F.when(k % 5 == 1, F.element_at(F.split("p", "/"), -1)).otherwise(F.col("p")))
    note = F.struct("turn", F.col("role").alias("author"), F.col("text").alias("body"), F.lit("").alias("created_at"), (F.col("role") == "system").alias("system"))
    per = rows.groupBy("review_id", "conv_id", path.alias("file_path"), F.when(k % 6 != 0, (1 + k % 45).cast("int")).alias("line"), (k % 3 == 0).alias("resolved")).agg(F.array_sort(F.collect_list(note)).alias("n"))
    notes = F.transform("n", lambda n: F.struct(n["author"].alias("author"), n["body"].alias("body"), n["created_at"].alias("created_at"), n["system"].alias("system")))
    return per.select("review_id", k.alias("disc_ord"), k.cast("string").alias("id"), "resolved", "file_path", "line", notes.alias("notes"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review comments: turn 0 is a root, most reply to it, each fourth to the comment before."""
    c = table(spark, sf_dir, "conversations")
    own = F.col("conv_id") * 100 + F.col("turn")
    reply = F.when(F.col("turn") == 0, None).when(F.col("turn") % 4 == 3, own - 1).otherwise(F.col("conv_id") * 100)
    return c.select(F.concat(F.lit("r"), (F.col("conv_id") % 10).cast("string")).alias("review_id"), own.alias("ord"), own.alias("id"), reply.alias("in_reply_to_id"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # hashed where it is read
    old = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    before = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.sha2(old, 256).alias("hash"))
    return before, d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text): every document."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, vector): every embedding, of a chunk of that id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = lambda c: c.cast("string")
    lines = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != ""))
    return documents(spark, sf_dir).select(
        F.substring(F.sha2(F.concat(F.lit("/repo/"), text(d)), 256), 1, 16).alias("name"), F.when(d % 9 != 0, F.concat(F.lit("/repo/"), text(d))).alias("root"), F.when(d % 4 == 0, F.concat(F.lit("host/p"), text(d % 40))).alias("remote"),
        (d % 50).alias("chunks"), F.concat(F.lit("2026-01-"), F.lpad(text(d % 28 + 1), 2, "0")).alias("indexed_at"), lines.alias("fileset"), F.length("text").cast("long").alias("size_bytes"), (d % 3 != 0).alias("root_exists"), (d % 5 == 0).alias("reachable"),
    )


REGISTRY_SQL = """
reg AS (SELECT substr(sha256(concat('/repo/', doc_id)), 1, 16) AS name, CASE WHEN doc_id % 9 <> 0 THEN concat('/repo/', doc_id) END AS root,
  CASE WHEN doc_id % 4 = 0 THEN concat('host/p', doc_id % 40) END AS remote, doc_id % 50 AS chunks, concat('2026-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS indexed_at,
  list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS fileset, CAST(length(text) AS BIGINT) AS size_bytes, doc_id % 3 <> 0 AS root_exists, doc_id % 5 = 0 AS reachable FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges from pages' links: names by arithmetic on page, place and length."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    callee = (F.col("page_id") * 7 + F.col("pos") * 13 + F.length("href")) % 97
    return rows.select(name(F.col("page_id") % 97).alias("caller"), F.col("page_id").alias("caller_path"), name(callee).alias("callee"), (F.floor(F.col("pos") / 2) + 1).cast("int").alias("call_line"), "pos")


EDGES_SQL = """
e0 AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages),
e AS (SELECT concat('p', page_id % 97) AS caller, page_id AS caller_path, concat('p', (page_id * 7 + pos * 13 + length(href)) % 97) AS callee, CAST(pos // 2 + 1 AS INTEGER) AS call_line, CAST(pos AS INTEGER) AS pos FROM e0)"""

#: Review URLs and remotes in several forms from the host and the path of each page's own URL; alike in both languages.
HOST, PLACE = "split_part(url, '/', 3)", "substr(url, length(split_part(url, '/', 1)) + length(split_part(url, '/', 3)) + 4)"
URL = f"""CASE page_id % 3 WHEN 0 THEN concat('https://git.example.com/', {HOST}, '/', split_part({PLACE}, '/', 1), '/-/merge_requests/', page_id, '/diffs?from=', {PLACE})
 WHEN 1 THEN concat('https://github.com/', {HOST}, '/', split_part({PLACE}, '/', 1), '/pull/', page_id, '/files') ELSE url END"""
REMOTE = f"""CASE page_id % 6 WHEN 0 THEN concat('git@', upper({HOST}), ':', {PLACE}, '.git') WHEN 1 THEN concat(' https://user@', {HOST}, '/', {PLACE}, '.git')
 WHEN 2 THEN concat('ssh://git@', {HOST}, '/', {PLACE}, '/') WHEN 3 THEN concat('HTTP://', {HOST}, '/', upper({PLACE}), '.git') WHEN 4 THEN concat('git://', {HOST}, '/a@', {PLACE}) ELSE url END"""
