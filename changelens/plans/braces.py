"""Source files in brace languages made of the documents' texts, and the rules of ``operators.tokens`` in SQL over them.

The SQL states the rules over again with DuckDB's windows and list functions; it shares the tables of words, token
patterns and declaration patterns, the former in their form without looking around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as K
from . import corpora as C

EXTENSIONS = ("java", "kt", "js", "ts", "go", "rs")
_LANGUAGE = dict(zip(EXTENSIONS, ("java", "kotlin", "javascript", "typescript", "go", "rust")))
#: By extension: head of a file, declarations of a function and a type, and of a member; @ stands for the document's id.
HEAD = {"java": "package p;\nimport a.B;\n", "kt": "package p\nimport a.B\n", "js": 'import { b } from "m";\n', "ts": 'import { b } from "m";\n', "go": 'package p\n\nimport "m"\n', "rs": "use a::b;\n"}
FUNCTION = {"java": "class F_@ { void f_@(int x)", "kt": "fun f_@(x: Int)", "js": "function f_@(x)", "ts": "export function f_@(x: number)", "go": "func f_@(x int)", "rs": "pub fn f_@<'a>(x: &'a str)"}
FUNCTION_END = {"java": "}\n}\n", "kt": "}\n", "js": "}\n", "ts": "}\n", "go": "}\n", "rs": "}\n"}
TYPE = {"java": "public class C_@ extends B", "kt": "class C_@(val a: Int) : B()", "js": "class C_@", "ts": "interface I_@ { x: C_@ }\nclass C_@", "go": "type C_@ struct", "rs": "impl C_@"}
MEMBER = {"java": "public int run(int x)", "kt": "override fun run(x: Int): Int", "js": "run(x)", "ts": "async run(x: number)", "go": "run func(x int)", "rs": "fn run(&self, x: u8) -> u8"}
SYMBOLS = ("x", "h", "run", "the", "B", "erth", "value", "a")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): of each document a file that holds its text three times: commented, as code, and in a block comment; dealt by path.

    Brackets and quotes stand in comments and strings, each 17th file leaves a brace open.
    """
    k, ext = F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    by = lambda table: F.replace(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("ext")), F.lit("@"), k)
    text = F.col("text")
    content = F.concat(
        by(HEAD), by(FUNCTION), F.lit(" { // {\n  g_"), k, F.lit('(h(x));\n  value = "}{";\n  // '), F.replace(text, F.lit("\n"), F.lit("\n  // ")), F.lit("\n"), F.when(F.col("doc_id") % 17 == 0, "{").otherwise(""), by(FUNCTION_END),
        F.lit("/* { "), text, F.lit(" */\n"), by(TYPE), F.lit(" {\n  "), by(MEMBER), F.lit(" {\n    return f_"), k, F.lit("(x.a(1));\n  }\n}\n"), text,
    )
    docs = C.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ext.alias("ext"))
    docs = docs.select("*", F.concat(F.lit("d/f"), k, F.lit("."), F.col("ext")).alias("path"))
    return K.deal(docs, 3 * F.length("text")).select("path", content.alias("content"))  # the texts move, not the files made of them


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _literal(text: str) -> str:
    """A string with line ends."""
    return "concat(" + ", chr(10), ".join(_quoted(p) for p in text.split("\n")) + ")"


def _by(table: dict[str, str]) -> str:
    return "replace(CASE ext " + " ".join(f"WHEN '{k}' THEN {_literal(v)}" for k, v in table.items()) + " END, '@', CAST(doc_id AS VARCHAR))"


_FILES = f"""bd AS (SELECT doc_id, coalesce(text, '') AS text, ({'[' + ', '.join(map(_quoted, EXTENSIONS)) + ']'})[doc_id % {len(EXTENSIONS)} + 1] AS ext FROM documents),
bf AS (SELECT concat('d/f', doc_id, '.', ext) AS path, CASE ext {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANGUAGE.items())} END AS language, concat(
  {_by(HEAD)}, {_by(FUNCTION)}, {_literal(' { // {' + chr(10) + '  g_')}, doc_id, {_literal('(h(x));' + chr(10) + '  value = "}{";' + chr(10) + '  // ')}, replace(text, chr(10), chr(10) || '  // '), chr(10),
  CASE WHEN doc_id % 17 = 0 THEN '{{' ELSE '' END, {_by(FUNCTION_END)}, '/* {{ ', text, ' */', chr(10), {_by(TYPE)}, ' {{', chr(10), '  ', {_by(MEMBER)}, ' {{', chr(10), '    return f_', doc_id, '(x.a(1));', chr(10), '  }}', chr(10), '}}', chr(10), text) AS content FROM bd)"""

_WORD = _quoted(f"^{K.WORD}$")
TOKENS = f"""{_FILES},
t0 AS (SELECT path, language, CASE language {' '.join(f"WHEN '{n}' THEN regexp_extract_all(content, {_quoted(K.pattern(n, java=False))})" for n in K.LANGUAGES)} END AS ts FROM bf),
t1 AS (SELECT path, language, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM t0),
t2 AS (SELECT *, substr(t, 1, 1) AS c, substr(t, 1, 2) IN ('//', '/*') OR substr(t, 1, 1) IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) AS blank FROM t1),
t3 AS (SELECT path, language, pos, CASE WHEN blank THEN NULL WHEN c IN (chr(34), '`') OR (c = '''' AND t[-1] = '''') OR regexp_matches(t, '^b?r#*"') THEN '""' WHEN c IN ('(', '[', '{{') THEN c ELSE t END AS text,
  length(t) - length(replace(t, chr(10), '')) AS ends, CASE WHEN c IN ('(', '[', '{{') AND NOT blank THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END AS step FROM t2),
t4 AS (SELECT *, 1 + sum(ends) OVER w AS last, sum(step) OVER w AS depth FROM t3 WINDOW w AS (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t5 AS (SELECT path, language, pos, text, last - ends AS line, last AS end_line, CASE WHEN step = 1 THEN depth - 1 ELSE depth END AS level, step, depth FROM t4 WHERE text IS NOT NULL),
t6 AS (SELECT path, language, pos, text, line, end_line, level, 0 AS mark FROM t5 UNION ALL SELECT path, language, pos, text, line, end_line, depth, 1 FROM t5 WHERE step = 1),
t7 AS (SELECT *, max(CASE WHEN mark = 1 THEN pos END) OVER (PARTITION BY path, level ORDER BY pos, mark DESC ROWS UNBOUNDED PRECEDING) AS scope FROM t6),
t8 AS (SELECT * EXCLUDE (mark), lead(text) OVER w AS next, lead(line) OVER w AS next_line, lead(pos) OVER w AS next_pos, lag(text, 1) OVER w AS b1, lag(text, 2) OVER w AS b2, lag(text, 3) OVER w AS b3
  FROM t7 WHERE mark = 0 WINDOW w AS (PARTITION BY path, level, scope ORDER BY pos)),
t9 AS (SELECT *, next IS NOT NULL AND ((text = ';' AND next <> ';') OR (text = '}}' AND next NOT IN {_in(K.AFTER_BLOCK)})
  OR (language IN {_in(K.BY_LINE)} AND next_line > end_line AND text NOT IN {_in(K.GOES_ON_AFTER)} AND next NOT IN {_in(K.GOES_ON_BEFORE)} AND NOT (coalesce(b1, '') = '@' OR (text = ')' AND coalesce(b3, '') = '@')))
  OR (language = 'rust' AND text = ']' AND coalesce(b1, '') = '[' AND coalesce(b2, '') IN ('#', '!'))) AS stop FROM t8),
st AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY path, level, scope ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item FROM t9)"""


def _first_of(member: bool, what: str) -> str:
    found = [(f"CASE WHEN language IN {_in(langs.split())} THEN nullif(regexp_extract(head, {_quoted('(?s)' + p)}, 1), '') END", kind) for langs, p, kind, m in K.DECLARATIONS if m == member]
    if what == "name":
        return f"coalesce({', '.join(f for f, _ in found)})"
    return "CASE " + " ".join(f"WHEN {f} IS NOT NULL THEN '{k}'" for f, k in found) + " END"


DECLARED = f"""{TOKENS},
i0 AS (SELECT path, language, level, scope, item, min(pos) AS first, max(pos) AS last, arg_max(text, pos) AS final, min(line) AS start_line, max(end_line) AS end_line, min(pos) FILTER (text = '{{') AS body,
  min(pos) FILTER (text IN ('=', ';', '=>', ':=')) AS cut, list(struct_pack(pos := pos, text := text) ORDER BY pos) AS alls FROM st GROUP BY path, language, level, scope, item),
i1 AS (SELECT *, list_filter(alls[1:{K.HEAD}], lambda x: x.pos < least(coalesce(body, 1000000000), coalesce(cut, 1000000000)) OR (x.pos = least(coalesce(body, 1000000000), coalesce(cut, 1000000000)) AND x.text = '{{')) AS words,
  max(end_line) OVER (PARTITION BY path) AS all_lines FROM i0),
i2 AS (SELECT path, language, level, scope, item, first, CASE WHEN final NOT IN ('(', '[', '{{') THEN last END AS last, start_line, CASE WHEN final IN ('(', '[', '{{') THEN all_lines ELSE end_line END AS end_line, body, words,
  array_to_string(list_transform(words, lambda x: x.text), ' ') AS head, alls[1].text AS first_word, len(list_filter(alls, lambda x: x.text IN ('=', ':='))) > 0 AS assigns FROM i1),
i3 AS (SELECT *, {_first_of(False, 'name')} AS free, {_first_of(False, 'kind')} AS free_kind, CASE WHEN first_word NOT IN {_in(K.NO_MEMBER)} THEN {_first_of(True, 'name')} END AS own, {_first_of(True, 'kind')} AS own_kind FROM i2),
ih AS (SELECT DISTINCT path, body AS scope FROM i3 WHERE free_kind IN {_in(K.HOLDERS)} AND body IS NOT NULL),
i4 AS (SELECT i3.*, ih.path IS NOT NULL AS held FROM i3 LEFT JOIN ih ON ih.path = i3.path AND ih.scope = i3.scope),
i5 AS (SELECT *, coalesce(free, CASE WHEN held THEN own END) AS name, CASE WHEN free IS NOT NULL THEN CASE WHEN language IN ('javascript', 'typescript') AND first_word = 'export' THEN 'other' ELSE free_kind END WHEN held AND own IS NOT NULL THEN own_kind END AS kind,
  coalesce(CASE WHEN free IS NOT NULL THEN free_kind WHEN held AND own IS NOT NULL THEN own_kind END <> 'other', false) AS defines FROM i4),
dc AS (SELECT *, list_filter(words, lambda x: x.text = name)[1].pos AS name_pos FROM i5)"""

_BARE = r"'[ \t\n\x0B\f\r]+', '', 'g'"
_PIECES = f"""list_reduce(lines[a:b], lambda s, x: CASE WHEN s.size + length(x) + 1 > {K.MAX_CHUNK} AND s.size > 0 THEN {{'size': length(x) + 1, 'at': s.at + 1, 'cuts': list_append(s.cuts, s.at)}}
  ELSE {{'size': s.size + length(x) + 1, 'at': s.at + 1, 'cuts': s.cuts}} END, {{'size': CAST(0 AS BIGINT), 'at': CAST(a AS BIGINT), 'cuts': CAST([] AS BIGINT[])}}).cuts"""
CHUNKS = f"""WITH {DECLARED},
bl AS (SELECT path, string_split(content, chr(10)) AS lines FROM bf WHERE regexp_replace(content, {_BARE}) <> ''),
tp AS (SELECT path, name AS symbol, coalesce(kind, 'other') AS symbol_type, CAST(start_line AS INTEGER) AS a, CAST(end_line AS INTEGER) AS b, body, first FROM dc WHERE level = 0 AND scope IS NULL
  AND (name IS NOT NULL OR (language IN ('javascript', 'typescript') AND first_word NOT IN {_in(K.NO_MEMBER)}) OR (language = 'java' AND first_word = 'import'))),
tx AS (SELECT tp.*, lines, array_to_string(lines[a:b], chr(10)) AS text FROM tp JOIN bl USING (path)),
mb AS (SELECT path, scope AS body, name AS symbol, kind AS symbol_type, CAST(start_line AS INTEGER) AS a, CAST(end_line AS INTEGER) AS b, first FROM dc WHERE held AND name IS NOT NULL),
mf AS (SELECT path, body, arg_min(a, first) AS a FROM mb GROUP BY path, body),
hd AS (SELECT tx.path, symbol, symbol_type, tx.a, mf.a - 1 AS b, array_to_string(lines[tx.a:mf.a - 1], chr(10)) AS text FROM tx JOIN mf USING (path, body) WHERE length(tx.text) > {K.MAX_CHUNK} AND mf.a > tx.a),
pt AS (SELECT tx.path, lines, mb.symbol, mb.symbol_type, mb.a, mb.b FROM tx JOIN mb USING (path, body) WHERE length(text) > {K.MAX_CHUNK}
  UNION ALL SELECT tx.path, lines, symbol, symbol_type, tx.a, tx.b FROM tx LEFT JOIN mf USING (path, body) WHERE length(text) > {K.MAX_CHUNK} AND mf.a IS NULL),
pp AS (SELECT *, CASE WHEN length(array_to_string(lines[a:b], chr(10))) <= {K.MAX_CHUNK} THEN CAST([a, b + 1] AS BIGINT[]) ELSE list_concat(CAST([a] AS BIGINT[]), {_PIECES}, CAST([b + 1] AS BIGINT[])) END AS cuts FROM pt),
pc AS (SELECT path, symbol, symbol_type, lines, unnest(cuts[:-2]) AS a, unnest(cuts[2:]) - 1 AS b FROM pp),
rs0 AS (SELECT path, lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM bl WHERE path IN (SELECT path FROM tp)),
rs1 AS (SELECT path, i, line FROM rs0 WHERE trim(translate(line, concat(chr(9), chr(11), chr(12), chr(13)), '    ')) <> '' AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.path = rs0.path AND rs0.i BETWEEN tp.a AND tp.b)),
rs AS (SELECT path, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS text FROM rs1 GROUP BY path)
SELECT path, symbol, symbol_type, a AS start_line, b AS end_line, text FROM tx WHERE length(text) <= {K.MAX_CHUNK}
UNION ALL SELECT path, symbol, symbol_type, a, b, text FROM hd WHERE length(text) <= {K.MAX_CHUNK} AND regexp_replace(text, {_BARE}) <> ''
UNION ALL SELECT path, symbol, symbol_type, CAST(a AS INTEGER), CAST(b AS INTEGER), array_to_string(lines[a:b], chr(10)) FROM pc
UNION ALL SELECT path, NULL, 'preamble', CAST(a AS INTEGER), CAST(b AS INTEGER), text FROM rs WHERE length(text) <= {K.MAX_CHUNK}
UNION ALL SELECT path, NULL, 'file', 1, CAST(len(lines) AS INTEGER), array_to_string(lines, chr(10)) FROM bl WHERE path NOT IN (SELECT path FROM tp)"""

CONTEXTS = f"""{DECLARED},
nm AS (SELECT path, name_pos AS pos FROM dc WHERE name_pos IS NOT NULL),
cl AS (SELECT w.path, w.pos, w.text AS callee, w.line, o.pos AS open, CASE WHEN o.next = ')' THEN o.next_pos END AS close FROM st o JOIN st w ON w.path = o.path AND w.next_pos = o.pos AND w.level = o.level
  WHERE o.text = '(' AND regexp_matches(o.b1, {_WORD}) AND o.b1 NOT IN {_in(K.NO_CALL)} AND coalesce(o.b2, '') <> '@' AND (w.path, w.pos) NOT IN (SELECT path, pos FROM nm)),
iv AS (SELECT path, 'import' AS type, first, last, NULL AS name FROM dc WHERE first_word IN {_in(K.IMPORTS)} UNION ALL SELECT path, 'set', first, last, NULL FROM dc WHERE assigns UNION ALL SELECT path, 'def', first, last, name FROM dc WHERE name IS NOT NULL
  UNION ALL SELECT path, 'define', first, last, name FROM dc WHERE name IS NOT NULL AND defines UNION ALL SELECT path, 'call', open, close, NULL FROM cl)"""
_INNER = "(SELECT arg_max(name, first) FROM iv WHERE iv.path = p.path AND iv.type = 'def' AND iv.first <= p.pos AND coalesce(iv.last, 1000000000) >= p.pos)"


def _outermost(type_: str, more: str = "") -> str:
    return f"(SELECT min(first) FROM iv WHERE iv.path = p.path AND iv.type = '{type_}' {more} AND iv.first <= p.pos AND coalesce(iv.last, 1000000000) >= p.pos)"


CALLS = f"""WITH {CONTEXTS}
SELECT coalesce({_INNER}, '<module>') AS caller, path AS caller_path, callee, CAST(line AS INTEGER) AS call_line, CAST(pos AS INTEGER) AS pos FROM cl p"""
USAGES = f"""WITH {CONTEXTS},
ht AS (SELECT p.path, p.pos, p.text AS symbol, p.line, p.language, p.next, p.b1, nm.pos IS NOT NULL AS named FROM st p LEFT JOIN nm ON nm.path = p.path AND nm.pos = p.pos WHERE p.text IN {_in(SYMBOLS)}),
ev AS (SELECT p.*, {_INNER} AS enclosing, list_min([
  struct_pack(f := coalesce({_outermost('import')}, 2000000000), r := 0, u := 'import'), struct_pack(f := coalesce({_outermost('define', 'AND iv.name = p.symbol')}, 2000000000), r := 1, u := 'definition'),
  struct_pack(f := coalesce({_outermost('call')}, CASE WHEN next = '(' AND coalesce(b1, '') <> '@' AND NOT named AND symbol NOT IN {_in(K.NO_CALL)} THEN pos END, 2000000000), r := 2, u := 'call'),
  struct_pack(f := coalesce({_outermost('set')}, 2000000000), r := 3, u := 'assignment'),
  struct_pack(f := CASE WHEN b1 IN {_in(K.BEFORE_TYPE)} OR (language = 'java' AND regexp_matches(next, {_WORD})) THEN pos ELSE 2000000000 END, r := 4, u := 'type_reference'), struct_pack(f := 1900000000, r := 5, u := 'reference')]) AS e FROM ht p)
SELECT path, CAST(line AS INTEGER) AS line, symbol, arg_min(e.u, struct_pack(f := e.f, r := e.r, p := pos)) AS usage, arg_min(struct_pack(v := enclosing), struct_pack(f := e.f, r := e.r, p := pos)).v AS enclosing_symbol FROM ev GROUP BY path, line, symbol"""
