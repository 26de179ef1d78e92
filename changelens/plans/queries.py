"""The registered queries over the virtual corpora, each with the DuckDB statement of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, diff, index, registry, review, search, sections, syntax, tokens, topk
from ..runtime import shared, table, written
from ..streaming import index as follow
from . import braces
from . import corpora as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(s, d):
    return diff.measured(C.file_diff(s, d))


def _lines(s, d):
    return diff.hunk_lines(C.file_diff(s, d))


def _sections(s, d):
    return sections.hunk_sections(_lines(s, d))


LINES, FILES, SYMBOLS, SECTIONS, THREADS = f"WITH {C.LINES_SQL}", f"WITH {C.LINES_SQL}, {C.FILES_SQL}", f"WITH {C.LINES_SQL}, {C.SYMBOLS_SQL}", f"WITH {C.LINES_SQL}, {C.SYMBOLS_SQL}, {C.SECTIONS_SQL}", f"WITH {C.THREADS_SQL}"


@query(f"{FILES} SELECT file_ord, file_path, reviewable, skip_reason FROM m")
def file_classify(s, d):
    return _files(s, d).select("file_ord", "file_path", "reviewable", "skip_reason")


@query(f"{FILES} SELECT file_ord, additions, deletions FROM m")
def line_counts(s, d):
    return _files(s, d).select("file_ord", "additions", "deletions")


@query(f"""{FILES} SELECT review_id, count(*) AS total_files, count(*) FILTER (reviewable) AS reviewable_files, count(*) FILTER (NOT reviewable) AS skipped_files,
 CAST(sum(additions) AS BIGINT) AS total_additions, CAST(sum(deletions) AS BIGINT) AS total_deletions,
 CAST(sum(CASE WHEN reviewable THEN additions ELSE 0 END) AS BIGINT) AS reviewable_additions, CAST(sum(CASE WHEN reviewable THEN deletions ELSE 0 END) AS BIGINT) AS reviewable_deletions
 FROM m GROUP BY review_id""")
def changed_files_manifest(s, d):
    return review.manifest_stats(_files(s, d))


@query(f"{FILES} SELECT review_id, file_path, additions, deletions, CAST(row_number() OVER (PARTITION BY review_id ORDER BY reviewable DESC, additions + deletions DESC, file_ord) AS INTEGER) AS place FROM m")
def manifest_order(s, d):
    return review.manifest_order(_files(s, d)).select("review_id", "file_path", "additions", "deletions", "place")


@query(f"{LINES} SELECT review_id, file_ord, hunk_no, type, old_line, new_line, content FROM l")
def hunk_lines(s, d):
    return _lines(s, d).select("review_id", "file_ord", "hunk_no", "type", "old_line", "new_line", "content")


def _json(c):
    """SQL for the characters of a string in pure ASCII JSON."""
    return f"""(CASE WHEN {c} IS NULL THEN 4 ELSE 2 + 2 * length({c}) - length(translate({c}, concat(chr(34), chr(92), chr(10), chr(13), chr(9), chr(8), chr(12)), ''))
 + 5 * length(regexp_replace({c}, '[ -~\\x08\\x09\\x0A\\x0C\\x0D]', '', 'g')) + 6 * length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) END)"""


def _plain(c):
    return f"coalesce(length(CAST({c} AS VARCHAR)), 4)"


#: Costs of file entries: a line's, a hunk's and a file's JSON, of which 51, 71 and 120 characters are keys and marks.
_COST = f"""lc AS (SELECT file_ord, count(*) AS n, sum(51 + {_json('type')} + {_plain('old_line')} + {_plain('new_line')} + {_json('content')}) AS chars FROM l GROUP BY file_ord),
hc AS (SELECT file_ord, count(*) AS hunks, sum(75 + length(CAST(1 + 20 * (hunk_no - 1) AS VARCHAR)) + length(CAST(1 + 25 * (hunk_no - 1) AS VARCHAR))) AS heads FROM (SELECT DISTINCT file_ord, hunk_no FROM l) GROUP BY file_ord),
c AS (SELECT m.*, CAST(120 + 2 * {_json('file_path')} + CASE WHEN file_ord % 11 = 0 THEN 4 ELSE 5 END + CASE WHEN file_ord % 13 = 0 THEN 4 ELSE 5 END + CASE WHEN file_ord % 17 = 0 THEN 4 ELSE 5 END
 + {_plain('additions')} + {_plain('deletions')} + 2 + 2 * (hunks - 1) + heads + chars + 2 * (n - hunks) AS BIGINT) AS cost FROM m JOIN lc USING (file_ord) JOIN hc USING (file_ord)),
u AS (SELECT *, sum(CASE WHEN reviewable THEN cost ELSE 0 END) OVER w AS used, count(*) FILTER (reviewable) OVER w AS rank FROM c WINDOW w AS (PARTITION BY review_id ORDER BY file_ord ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN NOT reviewable THEN 'skipped' WHEN rank = 1 OR used <= 80000 THEN 'returned' ELSE 'omitted' END AS status FROM u)"""


def _budget(s, d):
    files = diff.measured(C.file_diff(s, d), heads=True)
    return diff.budget(diff.priced(files, diff.hunk_lines(files)))


@query(f"{FILES}, {_COST} SELECT review_id, file_path, cost, CAST(used AS BIGINT) AS used_chars, status FROM v")
def diff_budget_page(s, d):
    return _budget(s, d).select("review_id", "file_path", "cost", "used_chars", "status")


@query(f"""{FILES}, {_COST} SELECT review_id, count(*) FILTER (status = 'returned') AS returned, count(*) FILTER (status = 'omitted') AS omitted, count(*) FILTER (status = 'skipped') AS skipped,
 CAST(sum(additions) AS BIGINT) AS additions FROM v GROUP BY review_id""")
def diff_stats(s, d):
    n = lambda v: F.count_if(F.col("status") == v).alias(v)
    return _budget(s, d).groupBy("review_id").agg(n("returned"), n("omitted"), n("skipped"), F.sum("additions").alias("additions"))


@query(f"{LINES} SELECT file_ord, hunk_no, type, new_line, content FROM l WHERE contains(file_path, 'd1/') OR contains(file_path, '.go')")
def diff_targeted(s, d):
    return diff.hunk_lines(diff.path_filter(C.file_diff(s, d), ["d1/", ".go"])).select("file_ord", "hunk_no", "type", "new_line", "content")


@query(f"""{LINES}, t AS (SELECT DISTINCT file_ord, file_path, review_id, unnest([CAST(1 + 25 * (doc_id % 3) AS INTEGER), CAST(doc_id % 40 AS INTEGER), 99999]) AS requested FROM l),
 j AS (SELECT t.file_ord, t.requested, l.new_line, l.old_line, l.type, l.content, row_number() OVER (PARTITION BY t.file_ord, t.requested ORDER BY abs(l.new_line - t.requested), l.hunk_no, l.i) AS n
 FROM t LEFT JOIN l ON l.file_ord = t.file_ord AND l.new_line IS NOT NULL)
 SELECT file_ord, requested, new_line, old_line, type, content, coalesce(new_line = requested, false) AS exact FROM j WHERE n = 1""")
def line_mapping_nearest(s, d):
    f = C.file_diff(s, d)
    k = F.col("file_ord")
    wanted = f.select(*diff.FILE, F.array((1 + 25 * (k % 3)).cast("int"), (k % 40).cast("int"), F.lit(99999)).alias("requested"))
    return diff.line_mappings(diff.hunk_lines(f), wanted).select("file_ord", "requested", "new_line", "old_line", "type", "content", "exact")


@query(f"{SYMBOLS} SELECT file_ord, hunk_no, symbol, CASE WHEN symbol IS NULL THEN 'unknown' ELSE 'function' END AS symbol_type FROM hs")
def hunk_symbols(s, d):
    return sections.hunk_symbols(_lines(s, d)).select("file_ord", "hunk_no", "symbol", "symbol_type")


@query(f"{SECTIONS} SELECT file_ord, section_no, symbol, symbol_type, start_line, end_line, changed_lines FROM sec")
def sections_merge(s, d):
    return _sections(s, d).select("file_ord", "section_no", "symbol", "symbol_type", "start_line", "end_line", "changed_lines")


@query(f"""{SECTIONS}, fs AS (SELECT review_id, file_ord, symbol, sum(changed_lines) AS n, min(section_no) AS first FROM sec WHERE symbol IS NOT NULL GROUP BY ALL),
 g AS (SELECT review_id, symbol, CAST(sum(n) AS BIGINT) AS weight, min(struct_pack(a := file_ord, b := -n, c := first)) AS seen FROM fs GROUP BY ALL)
 SELECT review_id, symbol, 'function' AS symbol_type, weight, CAST(row_number() OVER (PARTITION BY review_id ORDER BY weight DESC, seen) AS INTEGER) AS rank FROM g
 QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY weight DESC, seen) <= 8""")
def changed_symbols_topk(s, d):
    return sections.top_symbols(_sections(s, d)).select("review_id", "symbol", "symbol_type", "weight", "rank")


@query(f"""{LINES}, w0 AS (SELECT review_id, file_ord, hunk_no, i, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS symbol, unnest(range(len(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)', 1)))) AS k FROM l WHERE type = 'add'),
 g AS (SELECT review_id, symbol, count(*) AS weight, min(struct_pack(a := file_ord, b := hunk_no, c := i, d := k)) AS seen FROM w0
 WHERE length(symbol) >= 3 AND symbol NOT IN ({', '.join(f"'{w}'" for w in sections.STOPWORDS)}) GROUP BY ALL)
 SELECT review_id, symbol, weight, CAST(row_number() OVER (PARTITION BY review_id ORDER BY weight DESC, seen) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY weight DESC, seen) <= 8""")
def identifier_fallback_topk(s, d):
    return sections.top_identifiers(_lines(s, d), pattern=sections.ASCII_IDENTIFIER).select("review_id", "symbol", "weight", "rank")


@query(f"""{LINES} SELECT review_id, symbol, substr(trim(arg_min(content, struct_pack(a := file_ord, b := hunk_no, c := i)), ' '), 1, 200) AS snippet
 FROM l, (VALUES ('the'), ('fn_3'), ('ion')) AS t(symbol) WHERE type <> 'del' AND contains(content, symbol) GROUP BY ALL""")
def first_context(s, d):
    lines = _lines(s, d)
    wanted = C.documents(s, d).select(F.col("source").alias("review_id")).distinct().withColumn("symbol", F.explode(F.array(*map(F.lit, ("the", "fn_3", "ion")))))
    return sections.first_context(lines, wanted)


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, concat('r', conv_id % 10) AS review_id FROM conversations)
 SELECT review_id, id, CASE WHEN turn = 0 OR turn % 4 = 3 THEN id ELSE conv_id * 100 END AS root FROM c""")
def thread_grouping(s, d):
    return review.reply_threads(C.comments(s, d))


@query(f"""{THREADS} SELECT review_id, count(*) AS total_discussions, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS unresolved,
 string_agg(substr(first_any, 1, 150), '|' ORDER BY conv_id) FILTER (NOT resolved) AS previews FROM th GROUP BY review_id""")
def review_status_summary(s, d):
    out = review.status(C.threads(s, d))
    previews = F.array_join(F.transform("unresolved_details", lambda x: x["first_comment_preview"]), "|")
    return out.select("review_id", "total_discussions", "resolved", "unresolved", F.when(F.col("unresolved") > 0, previews).alias("previews"))


@query(f"{THREADS} SELECT review_id, conv_id AS disc_ord, file_path, line, located, first_body, CAST(people - 1 AS INTEGER) AS replies FROM dt")
def thread_dedup(s, d):
    rows = review.distinct_threads(C.threads(s, d))
    return rows.select("review_id", "disc_ord", "file_path", "line", "located", F.col("first_comment.body").alias("first_body"), F.size("replies").alias("replies"))


_MATCH = """tp AS (SELECT DISTINCT review_id, file_path AS thread_path FROM dt WHERE located),
fp AS (SELECT doc_id AS file_ord, review_id, file_path FROM docs),
ld AS (SELECT DISTINCT fp.* FROM fp JOIN tp ON tp.review_id = fp.review_id AND contains(fp.file_path, tp.thread_path)),
mp AS (SELECT tp.review_id, tp.thread_path, ld.file_ord, ld.file_path FROM tp JOIN ld ON ld.review_id = tp.review_id AND (ld.file_path = tp.thread_path OR ends_with(ld.file_path, tp.thread_path) OR ends_with(tp.thread_path, ld.file_path))
 QUALIFY row_number() OVER (PARTITION BY tp.review_id, tp.thread_path ORDER BY ld.file_path <> tp.thread_path, ld.file_ord) = 1)"""


@query(f"{THREADS}, {_MATCH} SELECT review_id, thread_path, file_ord, file_path FROM mp")
def verify_path_match(s, d):
    return review.match_paths(review.distinct_threads(C.threads(s, d)), C.file_diff(s, d))


_NEAR = """nr AS (SELECT dt.review_id, dt.conv_id AS disc_ord, l.type, l.old_line, l.new_line, l.content, l.hunk_no, l.i, abs(coalesce(l.new_line, l.old_line) - dt.line) AS distance
 FROM dt JOIN mp ON mp.review_id = dt.review_id AND mp.thread_path = dt.file_path JOIN l ON l.file_path = mp.file_path AND l.review_id = dt.review_id
 WHERE dt.located AND l.type <> 'context' AND abs(coalesce(l.new_line, l.old_line) - dt.line) <= 40)"""
VERIFY = f"WITH {C.LINES_SQL}, {C.THREADS_SQL}, {_MATCH}, {_NEAR}"


def _nearby(s, d):
    files = C.file_diff(s, d)
    threads = review.distinct_threads(C.threads(s, d))
    matched = review.match_paths(threads, files)
    wanted = files.join(matched.select("review_id", "file_ord").distinct(), ["review_id", "file_ord"], "left_semi")
    return threads, review.nearby_changes(threads, matched, diff.hunk_lines(wanted))


@query(f"{VERIFY} SELECT review_id, disc_ord, type, old_line, new_line, content, CAST(distance AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY review_id, disc_ord ORDER BY distance, hunk_no, i) AS INTEGER) AS place FROM nr")
def verify_range_join(s, d):
    return _nearby(s, d)[1].select("review_id", "disc_ord", "type", "old_line", "new_line", "content", "distance", "place")


@query(f"""{VERIFY}, ch AS (SELECT DISTINCT review_id, disc_ord FROM nr) SELECT dt.review_id, count(*) AS total_threads, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS unresolved,
 count(ch.disc_ord) AS threads_with_changes, count(*) - count(ch.disc_ord) AS threads_without_changes FROM dt LEFT JOIN ch ON ch.review_id = dt.review_id AND ch.disc_ord = dt.conv_id WHERE located GROUP BY dt.review_id""")
def verify_summary(s, d):
    return review.verify_summary(*_nearby(s, d))


_WORDS = ("the", "erth", "ouon", "reed")
_REFS = f"""sl0 AS (SELECT doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents),
rf0 AS (SELECT symbol, path, line, text, row_number() OVER (PARTITION BY symbol, path ORDER BY line) AS n FROM sl0, (VALUES {', '.join(f"('{w}')" for w in _WORDS)}) AS t(symbol) WHERE list_contains(regexp_extract_all(text, '([A-Za-z0-9_]+)', 1), symbol)),
rf1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS rank FROM rf0 WHERE n <= 5),
rf AS (SELECT symbol, path, line, trim(text, ' ') AS context, rank, CASE WHEN regexp_matches(text, '^\\s*(?:import|from|use|require|include)\\b') THEN 'import'
 WHEN regexp_matches(text, '(?:def|class|fun|func|function|fn|interface|struct|trait|enum|object)\\s+' || symbol || '(?:[^A-Za-z0-9_]|$)') THEN 'definition'
 WHEN regexp_matches(text, '^\\s*(?:(?:const|let|var|val|final)\\s+)?[A-Za-z_][A-Za-z0-9_.]*\\s*=[^=]') THEN 'assignment'
 WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])' || symbol || '\\s*\\(') THEN 'call' WHEN regexp_matches(text, '[:<]\\s*' || symbol || '(?:[^A-Za-z0-9_]|$)') THEN 'type_reference' ELSE 'reference' END AS usage_type FROM rf1 WHERE rank <= 50)"""


def _references(s, d, words=_WORDS):
    wanted = s.createDataFrame([(w,) for w in words], "symbol string")
    return code.references(code.source_lines(C.source_files(s, d)), wanted)


@query(f"WITH {_REFS} SELECT symbol, CAST(rank AS INTEGER) AS rank, path, CAST(line AS INTEGER) AS line, context, usage_type FROM rf WHERE symbol = 'the'")
def impact_references(s, d):
    return _references(s, d, ["the"])


@query(f"WITH {_REFS} SELECT symbol, CAST(rank AS INTEGER) AS rank, path, CAST(line AS INTEGER) AS line, context, usage_type FROM rf")
def impact_multi_symbol(s, d):
    return _references(s, d)


@query(f"WITH {_REFS}, g AS (SELECT symbol, path, count(*) AS n, min(rank) AS seen FROM rf GROUP BY ALL) SELECT symbol, path, n, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n DESC, seen) AS INTEGER) AS place FROM g")
def impact_by_file(s, d):
    return code.counts(_references(s, d), "path")


@query(f"WITH {_REFS}, g AS (SELECT symbol, usage_type, count(*) AS n, min(rank) AS seen FROM rf GROUP BY ALL) SELECT symbol, usage_type, n, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n DESC, seen) AS INTEGER) AS place FROM g")
def impact_by_usage(s, d):
    return code.counts(_references(s, d), "usage_type")


#: Spans of a text: all of it, named by its source; each run of lines that are not empty, named by its first word.
_SPANS = """pl AS (SELECT path, line, text, text = '' AS gap, sum(CASE WHEN text = '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS part FROM sl0),
sp AS (SELECT path, part + 1 AS pos, split_part(arg_min(text, line), ' ', 1) AS name, min(line) AS start_line, max(line) AS end_line FROM pl WHERE NOT gap GROUP BY path, part
 UNION ALL SELECT doc_id, 0, source, 1, len(string_split(coalesce(text, ''), chr(10))) FROM documents)"""


@query(f"""WITH {_REFS}, {_SPANS} SELECT rf.symbol, rf.path, CAST(rf.line AS INTEGER) AS line, (SELECT arg_min(name, struct_pack(a := end_line - start_line, b := pos)) FROM sp WHERE sp.path = rf.path AND rf.line BETWEEN start_line AND end_line) AS enclosing_symbol FROM rf""")
def enclosing_symbol(s, d):
    lines = code.source_lines(C.source_files(s, d))
    gap = F.col("text") == ""
    parts = lines.withColumn("pos", F.sum(F.when(gap, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("line")) + 1).where(~gap)
    parts = parts.groupBy("path", "pos").agg(F.split_part(F.min_by("text", "line"), F.lit(" "), F.lit(1)).alias("name"), F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    whole = C.documents(s, d).select(F.col("doc_id").alias("path"), F.lit(0).cast("long").alias("pos"), F.col("source").alias("name"), F.lit(1).alias("start_line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("end_line"))
    return code.enclosing(_references(s, d), parts.select(whole.columns).union(whole)).select("symbol", "path", "line", "enclosing_symbol")


def _wanted(s, names=("p3", "p10", "p42")):
    return s.createDataFrame([(n,) for n in names], "symbol string")


@query(f"WITH {C.EDGES_SQL} SELECT callee AS symbol, caller AS name, caller_path AS file_path, call_line FROM e WHERE callee IN ('p3', 'p10', 'p42') QUALIFY row_number() OVER (PARTITION BY callee, caller_path, call_line ORDER BY pos) = 1")
def call_callers(s, d):
    return code.callers(C.edges(s, d), _wanted(s))


@query(f"WITH {C.EDGES_SQL} SELECT caller AS symbol, callee AS name, caller_path AS file_path, call_line AS line FROM e WHERE caller IN ('p3', 'p10', 'p42') AND caller <> callee QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY pos, caller_path, call_line) = 1")
def call_callees(s, d):
    return code.callees(C.edges(s, d), _wanted(s))


@query(f"""WITH RECURSIVE {C.EDGES_SQL}, r AS (SELECT n AS symbol, n AS name, 0 AS depth FROM (VALUES ('p3'), ('p10'), ('p42')) AS t(n) UNION SELECT r.symbol, e.callee, r.depth + 1 FROM r JOIN e ON e.caller = r.name WHERE r.depth < 2)
 SELECT symbol, name, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0""")
def call_chain_depth2(s, d):
    return code.reach(C.edges(s, d), _wanted(s), 2)


_SNAP = """a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END) AS hash FROM documents WHERE doc_id % 10 <> 0),
b AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 13 <> 0),
dl AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'added' WHEN a.hash <> b.hash THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path)"""


@query(f"WITH {_SNAP} SELECT path, change FROM dl WHERE change IS NOT NULL")
def index_delta(s, d):
    return index.delta(*C.snapshots(s, d))


@query(f"WITH {_SNAP} SELECT * FROM b")
def index_apply_delta(s, d):
    old, new = C.snapshots(s, d)
    return index.apply_delta(old, new, index.delta(old, new))


@query(f"""WITH {_SNAP} SELECT (SELECT count(*) FROM b) AS files, (SELECT count(*) FROM documents) - (SELECT count(*) FROM b) AS skipped,
 (SELECT count(*) FROM documents WHERE doc_id % 13 <> 0 AND regexp_matches(text, '[^\\s\\p{{Z}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]')) AS chunks,
 count(*) FILTER (change <> 'deleted') AS changed_files, count(*) FILTER (change = 'deleted') AS deleted_files FROM dl""")
def index_delta_counts(s, d):
    seen, counts = Observation(), {}
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    files = C.documents(s, d).observe(seen, F.count(F.lit(1)).alias("met"))
    files = files.select(k, F.concat(F.lit("d/f"), k.cast("string"), F.lit(".txt")).alias("path"), text.alias("content"))
    old = files.where(k % 10 != 0).select("path", F.when(k % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    place = f"{shared(s)}/{uuid.uuid4().hex}"
    follow.refresh(s, place, old, 1)
    follow.refresh(s, place, files.where(k % 13 != 0).select("path", "content"), 2, counts=counts)
    row = (counts["files"], seen.get["met"] - counts["files"], counts["chunks"], counts["changed"], counts["deleted"])
    return s.createDataFrame([row], "files long, skipped long, chunks long, changed_files long, deleted_files long")


#: What a checkout and its index say of themselves, from a digest of each text, its language, source and length.
_DIGEST = "sha256(coalesce(text, ''))"
_FACTS = {
    "has_table": "n_chars % 9 <> 0", "has_meta": "n_chars % 8 <> 0", "meta_model": "coalesce(lang, 'none')", "model": "CASE WHEN n_chars % 4 = 0 THEN 'en' ELSE coalesce(lang, 'none') END",
    "indexed_sha": "translate(substr({d}, 1, 1), '0123456789abcdef', 'aaaabbbbccccddd')", "main_sha": "CASE WHEN substr({d}, 2, 1) < '6' THEN translate(substr({d}, 3, 1), '0123456789abcdef', 'aaaaaabbbbbbccc') END",
    "head_sha": "CASE WHEN substr({d}, 4, 1) <> '0' THEN translate(substr({d}, 1, 1), '0123456789abcdef', 'aaaabbbbcccceee') END", "dirty": "substr({d}, 5, 1) < '8'",
}
_FACTS_SQL = ", ".join(f"{v.replace('{d}', _DIGEST)} AS {k}" for k, v in _FACTS.items())


def _facts(s, d):
    return C.documents(s, d).select("doc_id", *[F.expr(v.replace("{d}", "sha2(coalesce(text, ''), 256)")).alias(k) for k, v in _FACTS.items()])


@query(f"""WITH f AS (SELECT doc_id, {_FACTS_SQL} FROM documents),
 g AS (SELECT *, coalesce(main_sha, head_sha) AS now FROM f), h AS (SELECT *, CASE WHEN NOT has_table THEN 'absent' WHEN NOT has_meta THEN 'unknown' WHEN meta_model <> model THEN 'model_mismatch' WHEN coalesce(now, '') = '' OR indexed_sha = '' THEN 'unknown'
 WHEN now = indexed_sha AND main_sha IS NULL AND dirty THEN 'stale' WHEN now = indexed_sha THEN 'fresh' ELSE 'stale' END AS state FROM g)
 SELECT doc_id, state, state = 'stale' AND NOT coalesce(now = indexed_sha, false) AS needs_commits_behind FROM h""")
def index_freshness(s, d):
    return index.freshness(_facts(s, d)).select("doc_id", "state", "needs_commits_behind")


@query(f"""WITH f AS (SELECT doc_id, {_FACTS_SQL} FROM documents) SELECT doc_id, CASE WHEN coalesce(main_sha, '') = '' OR NOT has_table THEN NULL WHEN NOT has_meta THEN 'mr_head_absent' WHEN coalesce(head_sha, '') <> main_sha THEN 'not_checked_out' ELSE 'on_mr_head' END AS root_state FROM f""")
def root_status(s, d):
    facts = _facts(s, d).select("doc_id", F.col("has_table").alias("is_git"), F.coalesce("head_sha", F.lit("")).alias("root_sha"), F.col("main_sha").alias("review_head"), F.col("has_meta").alias("head_present"))
    return index.root_state(facts).select("doc_id", "root_state")


_CHUNKS = """ve AS (SELECT vec_id AS chunk_id, embedding AS vector FROM embeddings), ck AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text FROM documents),
vq AS (SELECT chunk_id AS query_id, vector AS query FROM ve WHERE chunk_id % 50 = 0),
v0 AS (SELECT query_id, chunk_id, round(list_sum(list_transform(range(1, len(vector) + 1), lambda i: (CAST(vector[i] AS DOUBLE) - CAST(query[i] AS DOUBLE)) * (CAST(vector[i] AS DOUBLE) - CAST(query[i] AS DOUBLE)))), 6) AS distance FROM ve, vq),
v AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM v0 QUALIFY rank <= 20),
w0 AS MATERIALIZED (SELECT chunk_id, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS words FROM ck), w1 AS (SELECT chunk_id, words, len(words) AS length FROM w0),
w AS (SELECT chunk_id, length, unnest(words) AS term FROM w1),
po AS (SELECT term, chunk_id, count(*) AS tf, any_value(length) AS length FROM w GROUP BY ALL),
tt AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM w0),
qt AS (SELECT DISTINCT chunk_id AS query_id, unnest(words) AS term FROM w0 WHERE chunk_id % 50 = 0), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
b0 AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term), tt GROUP BY ALL),
b AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b0 QUALIFY rank <= 20)"""


def _asking(vectors):
    return vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))


def _arms(s, d):
    vectors, chunks = C.vectors(s, d), C.chunks(s, d)
    postings = written(search.postings(chunks))  # as an index build does
    terms = postings.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "term")
    return search.nearest(vectors, _asking(vectors)), search.bm25(postings, terms, search.totals(chunks, postings))


@query(f"WITH {_CHUNKS} SELECT query_id, chunk_id, distance, CAST(rank AS INTEGER) AS rank FROM v")
def vector_topk(s, d):
    vectors = C.vectors(s, d)
    return search.nearest(vectors, _asking(vectors))


@query(f"WITH {_CHUNKS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM b")
def fts_bm25_topk(s, d):
    return _arms(s, d)[1]


@query(f"WITH {_CHUNKS} SELECT query_id, chunk_id, distance, CAST(rank AS INTEGER) AS rank FROM v")
def vector_topk_cells(s, d):
    vectors = C.vectors(s, d)
    return topk.nearest_in_cells(topk.cells(vectors), _asking(vectors))


@query(f"WITH {_CHUNKS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM b")
def fts_blocks_topk(s, d):
    chunks = C.chunks(s, d)
    postings = written(search.postings(chunks))
    terms = postings.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "term")
    return topk.bm25_in_blocks(topk.blocks(postings, search.totals(chunks, postings)), terms)


@query(f"""WITH {_CHUNKS}, f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score
 FROM v FULL JOIN b ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 8""")
def hybrid_rrf(s, d):
    return search.fuse(*_arms(s, d), k=8)


@query(f"""WITH {C.REGISTRY_SQL}, m AS (SELECT name, unnest(fileset) AS x FROM reg), n AS (SELECT name, len(fileset) AS n FROM reg),
 k AS (SELECT p.name AS a, q.name AS b, count(*) AS k FROM m p JOIN m q ON p.x = q.x AND p.name < q.name GROUP BY ALL)
 SELECT a, b, k / (p.n + q.n - k) AS similarity FROM k JOIN n p ON p.name = a JOIN n q ON q.name = b WHERE k / (p.n + q.n - k) >= 0.6""")
def jaccard_pairs(s, d):
    return registry.similar_pairs(C.registry(s, d))


@query(f"WITH {C.REGISTRY_SQL} SELECT name, root IS NOT NULL AND NOT root_exists AND NOT reachable AS orphan FROM reg")
def registry_orphans(s, d):
    return registry.orphans(C.registry(s, d)).select("name", "orphan")


@query(f"""WITH {C.REGISTRY_SQL} SELECT name, row_number() OVER (PARTITION BY coalesce(remote, name) ORDER BY reachable DESC, root IS NOT NULL AND root_exists DESC, indexed_at DESC, chunks DESC, name) = 1 AS keep FROM reg""")
def registry_keeper(s, d):
    return registry.keepers(C.registry(s, d).withColumn("group_id", F.coalesce("remote", "name"))).select("name", "keep")


#: Leaders in order of name, one record a step: the list of them grows where no smaller neighbour is among them.
_PRUNE = f"""WITH RECURSIVE {C.REGISTRY_SQL}, ro AS (SELECT *, root IS NOT NULL AND NOT root_exists AND NOT reachable AS orphan FROM reg), rn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY name) AS i FROM ro WHERE NOT orphan),
 m AS (SELECT name, unnest(fileset) AS x FROM rn), n AS (SELECT name, len(fileset) AS n FROM rn), k AS (SELECT p.name AS a, q.name AS b, count(*) AS k FROM m p JOIN m q ON p.x = q.x AND p.name < q.name GROUP BY ALL),
 ln AS (SELECT a, b FROM k JOIN n p ON p.name = a JOIN n q ON q.name = b WHERE k / (p.n + q.n - k) >= 0.6 UNION SELECT p.name, q.name FROM rn p JOIN rn q ON p.remote = q.remote AND p.name < q.name),
 nb AS MATERIALIZED (SELECT rn.i, rn.name, coalesce(list(ln.a) FILTER (ln.a IS NOT NULL), []) AS near FROM rn LEFT JOIN ln ON ln.b = rn.name GROUP BY ALL),
 wk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS firsts UNION ALL SELECT nb.i, CASE WHEN list_has_any(wk.firsts, nb.near) THEN wk.firsts ELSE list_append(wk.firsts, nb.name) END FROM wk JOIN nb ON nb.i = wk.i + 1),
 ld AS (SELECT firsts FROM wk ORDER BY i DESC LIMIT 1), gr AS (SELECT rn.*, coalesce(list_min(list_intersect(near, firsts)), rn.name) AS group_id FROM rn JOIN nb USING (name), ld),
 kp AS (SELECT *, row_number() OVER w AS r, first_value(name) OVER w AS winner FROM gr WINDOW w AS (PARTITION BY group_id ORDER BY reachable DESC, root IS NOT NULL AND root_exists DESC, indexed_at DESC, chunks DESC, name)),
 pr AS (SELECT name, CASE WHEN r > 1 THEN concat('duplicate of ', substr(winner, 1, 8)) END AS reason, size_bytes FROM kp UNION ALL SELECT name, 'orphan: checkout gone', size_bytes FROM ro WHERE orphan)"""


@query(f"{_PRUNE} SELECT name, reason, size_bytes FROM pr")
def registry_prune(s, d):
    return registry.prune(C.registry(s, d)).select("name", "reason", "size_bytes")


@query(f"{_PRUNE} SELECT CAST(coalesce(sum(size_bytes) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS reclaimed_bytes, count(reason) AS prunable FROM pr")
def registry_reclaimed(s, d):
    return registry.reclaimed(registry.prune(C.registry(s, d)))


@query(f"""WITH u AS (SELECT page_id, {C.URL} AS url FROM pages), p AS (SELECT *, CASE WHEN contains(url, 'merge_requests/') THEN 'gitlab' WHEN contains(url, '/pull/') THEN 'github' END AS platform FROM u)
 SELECT page_id, platform, CASE platform WHEN 'gitlab' THEN regexp_extract(url, 'https://git.example.com/(.*)/-/', 1) WHEN 'github' THEN regexp_extract(url, 'https://github.com/([^/]+/[^/]+)/', 1) END AS repository,
 CASE platform WHEN 'gitlab' THEN CAST(regexp_extract(url, 'merge_requests/([0-9]+)', 1) AS INTEGER) WHEN 'github' THEN CAST(regexp_extract(url, '/pull/([0-9]+)', 1) AS INTEGER) END AS number FROM p""")
def url_route(s, d):
    urls = table(s, d, "pages").select("page_id", F.expr(C.URL).alias("url"))
    return review.platform_facts(urls, "https://git.example.com").select("page_id", "platform", "repository", "number")


@query(f"""WITH u AS (SELECT page_id, lower(trim({C.REMOTE})) AS u FROM pages), a AS (SELECT page_id, CASE WHEN starts_with(u, 'git@') AND contains(u, ':') THEN regexp_replace(substr(u, 5), ':', '/') ELSE u END AS u FROM u),
 b AS (SELECT page_id, regexp_replace(regexp_replace(u, '^(https://|http://|ssh://|git://)', ''), '^[^/@]*@', '') AS u FROM a) SELECT page_id, CASE WHEN ends_with(u, '.git') THEN left(u, length(u) - 4) ELSE rtrim(u, '/') END AS remote FROM b""")
def remote_normalise(s, d):
    return table(s, d, "pages").select("page_id", T.normal_remote(F.expr(C.REMOTE)).alias("remote"))


def _drafts(s, d):
    k = F.col("conv_id")
    c = table(s, d, "conversations")
    return c.select(
        F.concat(F.lit("r"), (k % 10).cast("string")).alias("review_id"), (k * 1000 + F.col("turn")).alias("ord"), F.when(k % 6 != 0, F.concat(F.lit("f"), k.cast("string"))).alias("file_path"), F.when(k % 7 == 0, "").otherwise(F.col("text")).alias("body"),
        F.when(k % 4 != 0, (k % 3).cast("int")).alias("new_line"), F.when(k % 5 != 0, (k % 2).cast("int")).alias("old_line"), F.when(k % 3 == 0, "old").alias("old_path"),
        F.when(k % 9 != 0, "b").alias("base_sha"), F.lit("h").alias("head_sha"), F.lit("s").alias("start_sha"),
    )


_DRAFTS = """dr AS (SELECT concat('r', conv_id % 10) AS review_id, conv_id * 1000 + turn AS ord, conv_id, CASE WHEN conv_id % 6 <> 0 THEN concat('f', conv_id) END AS file_path, CASE WHEN conv_id % 7 = 0 THEN '' ELSE text END AS body,
 CASE WHEN conv_id % 4 <> 0 THEN CAST(conv_id % 3 AS INTEGER) END AS new_line, CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id % 2 AS INTEGER) END AS old_line, CASE WHEN conv_id % 3 = 0 THEN 'old' END AS old_path FROM conversations)"""


@query(f"""WITH {_DRAFTS} SELECT review_id, ord, CASE WHEN file_path IS NULL THEN concat('comment ', ord, ': file_path is missing') WHEN coalesce(body, '') = '' THEN concat('comment ', ord, ': body is missing')
 WHEN coalesce(new_line, 0) = 0 AND coalesce(old_line, 0) = 0 THEN concat('comment ', ord, ': new_line or old_line is needed') END AS error FROM dr""")
def comment_validate(s, d):
    return review.comment_errors(_drafts(s, d)).select("review_id", "ord", "error")


@query(f"""WITH {_DRAFTS} SELECT review_id, ord, CASE WHEN new_line IS NOT NULL THEN 'RIGHT' ELSE 'LEFT' END AS side, CASE WHEN new_line IS NOT NULL THEN new_line ELSE old_line END AS line,
 CASE WHEN conv_id % 9 <> 0 THEN coalesce(old_path, file_path) END AS old_path FROM dr""")
def comment_position(s, d):
    rows = review.positions(_drafts(s, d))
    return rows.select("review_id", "ord", "side", "line", F.get_json_object("gitlab", "$.old_path").alias("old_path"))


def _python_files(s, d):
    """A Python file of each document: its lines as comments of a function between others; each 19th holds bare text."""
    k = F.col("doc_id").cast("string")
    text = F.coalesce("text", F.lit(""))
    lines = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("    # "), x)), "\n")
    body = F.concat(F.lit("import os\n\n\ndef f_"), k, F.lit("(x):\n"), lines, F.lit("\n    return a.g_"), k, F.lit("(h(x))\n\n\nclass C_"), k, F.lit(":\n    def m(self):\n        return f_"), k, F.lit("(1)\n\n\nf_"), k, F.lit("(2)\n"))
    content = F.when(F.col("doc_id") % 19 == 0, F.concat(F.lit("def f("), text)).otherwise(body)
    return C.documents(s, d).select(F.concat(F.lit("d/f"), k, F.lit(".py")).alias("path"), content.alias("content"))


@query()
def chunk_python(s, d):
    return syntax.chunks(_python_files(s, d))


@query()
def call_edges_python(s, d):
    return syntax.edges(syntax.syntax(_python_files(s, d), most=None))


def _statements(s, d, *symbols):
    """The tokens that calls and usages of symbols are found by, and the declarations; no other token is written."""
    found = written(tokens.declared(tokens.items(tokens.in_runs(tokens.statements(tokens.tokens(braces.files(s, d), dealt=True, runs=True)), *symbols))))
    return tokens.kept(found), found.drop("kept")


@query(braces.CHUNKS)
def chunk_braces(s, d):
    return tokens.chunks(braces.files(s, d), dealt=True)


@query(braces.CALLS)
def call_edges_braces(s, d):
    return tokens.call_edges(*_statements(s, d))


@query(braces.USAGES)
def usage_by_tokens(s, d):
    wanted = s.createDataFrame([(w,) for w in braces.SYMBOLS], "symbol string")
    return tokens.usages(*_statements(s, d, *braces.SYMBOLS), wanted)
