"""Syntax of brace languages as a table of tokens: statements, declarations, chunks, calls and usages, all in columns.

A file is cut into tokens by one regular expression of its language.  Bracket depth is a running sum over the tokens; a
token's scope is the last bracket that opened its depth; the tokens that stand directly in a scope are cut into
statements; the first words of a statement say what it declares.  One exchange deals files by path, and the windows of
tokens and statements keep to it.  What a token stands in (declarations, calls, assignments) follows from running counts of
the intervals that are open there; no token is joined with the intervals of its file.

Rules, the same in every language.  A statement ends after ``;``, after ``}`` unless what follows goes on with it, and, in
JS, TS, Go and Kotlin, at a line end between two tokens that do not ask for each other; the insides of all brackets have
statements.  A declaration is recognised by the first HEAD tokens of a statement up to its body.  A call is a word before
``(`` that is neither declared there nor a keyword nor an annotation; it is named by that word.

Defined results.  Null content: as the empty text.  Files of other languages give no rows.  A text that is no code gives
the tokens, statements and spans that the rules give; nothing fails.  An unclosed bracket, comment or raw string reaches to
the end of its file, an unclosed string to the end of its line; a closing bracket too many opens no scope.  Paths name
files: one row each.  Not recognised: comments within comments, and regular expressions of JavaScript that do not follow
one of ``( , = : ! & | ?``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LANGUAGES = ("java", "kotlin", "javascript", "typescript", "go", "rust")
#: Languages in which a line end may end a statement.
BY_LINE = ("javascript", "typescript", "go", "kotlin")
#: Tokens of a statement that are looked at for a declaration; most characters of a chunk.
HEAD, MAX_CHUNK = 64, 4000
#: Characters of the files of a partition: some million tokens, which a task sorts in memory.
PART = 1 << 22
SPACE = r"[ \t\n\x0B\f\r]+"
LETTER, MORE = r"[^\x00-\x23\x25-\x40\x5B-\x5E\x60\x7B-\x7F]", r"[^\x00-\x23\x25-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
WORD, NUMBER = f"{LETTER}{MORE}*", r"[0-9][0-9A-Za-z_.]*"
OPERATORS = r"=>|->|::|:=|==|!=|<=|>=|&&|\|\||(?s:.)"
#: After ``}``, what goes on with its statement; at a line end, before what it goes on, and after what.
AFTER_BLOCK = (";", ",", ")", "]", ".", "(", "[", "=", "?", ":", "&", "|", "&&", "||", "+", "-", "*", "/", "==", "!=", "<", ">", "=>", "->", "::", "else", "catch", "finally", "from", "as")
GOES_ON_BEFORE = ("{", "}", ")", "]", ".", "?", ":", ",", ";", "=", "+", "-", "*", "/", "&", "|", "&&", "||", "<", ">", "==", "!=", "<=", ">=", "=>", "->", "::", ":=", "else", "catch", "finally", "extends", "implements", "where", "by", "as", "in", "is", "of", "instanceof")
GOES_ON_AFTER = ("{", "(", "[", ".", "?", ":", ",", "=", "+", "-", "*", "/", "&", "|", "&&", "||", "<", "==", "!=", "<=", ">=", "=>", "->", "::", ":=", "!", "@", "~", "^", "%", "else", "extends", "implements", "export", "default", "async", "public", "private", "protected", "internal", "override", "open", "abstract", "sealed", "data", "suspend", "inline", "static")
#: Words before a bracket that make no call.
NO_CALL = ("if", "for", "while", "switch", "catch", "return", "function", "def", "fn", "func", "fun", "match", "when", "else", "in", "of", "do", "try", "new", "typeof", "await", "yield", "throw", "case", "super", "this", "constructor", "synchronized", "pub")
#: First words of a statement that cannot be the head of a member.
NO_MEMBER = ("if", "for", "while", "switch", "catch", "return", "function", "do", "try", "else", "new", "throw", "await", "yield", "case", "import", "package")
IMPORTS = ("import", "use", "require", "include")


#: Letters as WORD has them, in the form that Java's patterns test fastest: characters one by one in a set of bits.
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"
#: A run: words of a line with one space between them, marks before it, and marks after the last.  It is cut again by PIECE;
#: a number with a full stop, a raw string of Rust, ``!=`` and what may begin a regular expression stay outside.
MARKS = ",.%*#!"
_RAW, _LETTERS = '(?!b?r#{0,2}")', f"[{_CHARS}\\x80-\\x{{10FFFF}}][{_CHARS}0123456789\\x80-\\x{{10FFFF}}]*"
_MARK = r"(?:[.%*#]|,(?![ \t]*/)|!(?!=|[ \t]*/))*+"
RUN = rf"{_RAW}{_LETTERS}(?:{_MARK} {_RAW}(?:{_LETTERS}|[0-9][0-9A-Za-z_]*+(?!\.)))*+{_MARK}"
PIECE, PIECES = f"[^ {MARKS}]+|[ {MARKS}]", f"[^ {MARKS}]+|[{MARKS}]"  # with and without spaces



def _string(quote: str, lines: bool, java: bool) -> str:
    """A string with escapes: to its end, or to the end of its line (``lines``: of its file) where it has none.

    Spark's pattern finds the end from behind, without a loop for each character, which would exhaust the stack.
    """
    any_ = "(?s:.)" if lines else r"[^\n]"
    body = rf"{any_}*?(?<!\\)(?:\\\\)*" if java else rf"(?:[^{quote}\\{'' if lines else chr(92) + 'n'}]|\\{any_})*"
    return f"{quote}{body}{quote}|{quote}{any_}*"


def pattern(language: str, java: bool = True, runs: bool = False) -> str:
    """The tokens of a language as one alternation that covers every text; ``java`` False: without looking around; ``runs``: words in runs."""
    text = lambda q, lines=False: _string(q, lines, java)
    block = r'"""(?s:.*?)(?:"""|\z)'
    own = {
        "java": [block, text('"'), text("'")],
        "kotlin": [block, text('"'), text("'")],
        "javascript": [_regex(java), text('"'), text("'"), text("`", True)],
        "go": [text('"'), text("'"), r"`[^`]*(?:`|\z)"],
        "rust": [r'b?r"[^"]*(?:"|\z)', r'b?r#"(?s:.*?)(?:"#|\z)', r'b?r##"(?s:.*?)(?:"##|\z)', text('"', True), rf"'(?:\\[^\n][^'\n]*|[^\\'\n])'|'{WORD}"],
    }
    own["typescript"] = own["javascript"]
    return "|".join([r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)", *own[language], *([RUN] if runs else []), SPACE, WORD, NUMBER, OPERATORS])


def _regex(java: bool) -> str:
    """A regular expression's literal with the token before it, as only that tells it from a division."""
    body = r"(?![*/])[^\n]*?(?<!\\)(?:\\\\)*" if java else r"(?:[^*/\\\n]|\\[^\n])(?:[^/\\\n]|\\[^\n])*"
    return rf"[(,=:!&|?][ \t]*/{body}/"


#: What statements declare: language, pattern of the head (tokens with one space between), kind.  The first that matches
#: is taken; ``member`` ones count only in the body of a class, interface, trait or enum.
_JS = r"^(?:(?:export|default|declare|abstract|async) )*"
_JAVA = r"^(?:.* )?"
DECLARATIONS = [
    ("javascript typescript", _JS + rf"function (?:\* )?({WORD})", "function", False),
    ("javascript typescript", _JS + rf"class ({WORD})", "class", False),
    ("typescript", _JS + rf"interface ({WORD})", "interface", False),
    ("typescript", _JS + rf"(?:const )?enum ({WORD})", "enum", False),
    ("typescript", _JS + rf"type ({WORD})", "other", False),
    ("javascript typescript", _JS + rf"(?:const|let|var) ({WORD})", "other", False),
    ("javascript typescript", rf"^(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set|\*) )*({WORD}) (?:< .* > )?\( \)", "method", True),
    ("java", _JAVA + rf"class ({WORD})", "class", False),
    ("java", _JAVA + rf"interface ({WORD})", "interface", False),
    ("java", _JAVA + rf"enum ({WORD})", "enum", False),
    ("java", _JAVA + rf"record ({WORD}) \(", "class", False),
    ("java", rf"^(?:@ {WORD} (?:\( \) )?)*(?:{WORD} |< .* > |\[ \] |\. |\? |, )+({WORD}) \( \)", "method", True),
    ("java", rf"^(?:@ {WORD} (?:\( \) )?)*({WORD}) \( \) (?:throws .* )?\{{", "method", True),
    ("kotlin", _JAVA + rf"(?:class|object) ({WORD})", "class", False),
    ("kotlin", _JAVA + rf"interface ({WORD})", "interface", False),
    ("kotlin", rf"^(?:.* )?fun (?:< .* > )?(?:{WORD} (?:< .* > )?(?:\? )?\. )*({WORD}) \(", "function", False),
    ("go", rf"^func \( \) ({WORD})", "method", False),
    ("go", rf"^func ({WORD})", "function", False),
    ("go", rf"^type ({WORD})", "other", False),
    ("rust", rf"^(?:pub (?:\( \) )?)?(?:(?:async|unsafe|const|extern|\"\") )*fn ({WORD})", "function", False),
    ("rust", rf"^(?:unsafe )?impl (?:< [^{{]*? > )?({WORD})", "trait", False),
    ("rust", rf"^(?:pub (?:\( \) )?)?(?:unsafe )?trait ({WORD})", "trait", False),
    ("rust", rf"^(?:pub (?:\( \) )?)?enum ({WORD})", "enum", False),
    ("rust", rf"^(?:pub (?:\( \) )?)?(?:struct|mod) ({WORD})", "other", False),
]
#: Kinds whose bodies have members.
HOLDERS = ("class", "interface", "trait", "enum")


def deal(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` dealt by path into partitions of some PART characters; ``size``: the characters of a row's file.

    The number of partitions is fixed: joined by their bytes, files would make partitions of a hundred times as many bytes of tokens.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.repartition(max(1, -(-total // PART)), "path")


def by_path(files: DataFrame, dealt: bool = False) -> DataFrame:
    """(path, language, content) of files of brace languages, dealt by path unless they are; the only exchange of whole texts."""
    own = files.select("path", T.language(F.col("path")).alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    own = own.where(F.col("language").isin(*LANGUAGES))
    return own if dealt else deal(own, F.length("content"))


def tokens(files: DataFrame, dealt: bool = False, runs: bool = False) -> DataFrame:
    """(path, language, pos, text, line, end_line, level, scope): the tokens of files (path, content) but comments and spaces.

    ``dealt``: the files have been dealt by path.  ``runs``: one row for a run of words, as all that is asked of most words
    is how many they are: ``pos`` and ``until`` are the places of its first and last token, ``head`` and ``tail`` those tokens.

    ``text`` of a string is two quotes.  ``level`` is the depth of the scope that the token stands in, brackets themselves
    outside of what they hold; ``scope`` is the place of the bracket that opened it, null for the file.
    """
    own = by_path(files, dealt)
    cut = F.lit(None).cast("array<string>")
    for name in LANGUAGES:
        cut = F.when(F.col("language") == name, F.regexp_extract_all("content", F.lit(pattern(name, runs=runs)), F.lit(0))).otherwise(cut)
    t = F.col("token")
    rows = own.select("path", "language", F.posexplode(cut).alias("at", "token"))
    first, two = F.substring(t, 1, 1), F.substring(t, 1, 2)
    blank = two.isin("//", "/*") | first.isin(" ", "\t", "\n", "\x0b", "\f", "\r")
    string = first.isin('"', "`") | ((first == "'") & (F.substring(t, -1, 1) == "'")) | (first.isin("b", "r") & t.rlike('^b?r#*"'))
    open_, close = first.isin("(", "[", "{"), t.isin(")", "]", "}")
    code, count = F.ascii(t), lambda mark: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(mark), F.lit("")))
    letter = code.between(65, 90) | code.between(97, 122) | code.isin(36, 95) | (code > 127)
    many = F.when(letter & ~string, 2 * count(" ") + sum(map(count, MARKS)) + 1).otherwise(1) if runs else F.lit(1)  # tokens, spaces among them
    rows = rows.select(
        "path", "language", "at", F.when(blank, None).when(string, F.lit('""')).when(open_, first).otherwise(t).alias("text"), many.alias("many"),
        count("\n").alias("ends"), F.when(open_, 1).when(close, -1).otherwise(0).alias("step"),
    )
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = (F.sum("many").over(before) - 1).cast("int") if runs else F.col("at")
    rows = rows.withColumns({"until": until, "last": (F.sum("ends").over(before) + 1).cast("int"), "depth": F.sum("step").over(before).cast("int")}).where("text is not null")
    rows = rows.withColumns({"pos": F.col("until") - F.col("many") + 1, "line": F.col("last") - F.col("ends"), "level": F.when(F.col("step") == 1, F.col("depth") - 1).otherwise(F.col("depth"))})
    # an opening bracket also stands at the level that it opens, as a mark
    at = F.when(F.col("step") == 1, F.array("level", "depth")).otherwise(F.array("level"))
    rows = rows.select("path", "language", "pos", "until", "text", "line", F.col("last").alias("end_line"), "step", F.posexplode(at).alias("mark", "level"))
    seen = Window.partitionBy("path", "level").orderBy("pos", F.desc("mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("scope", F.last(F.when(F.col("mark") == 1, F.col("pos")), ignorenulls=True).over(seen)).where("mark = 0")
    rows = rows.select("path", "language", "pos", "text", "line", "end_line", "level", "scope", "until")
    if not runs:
        return rows.drop("until")
    text, several = F.col("text"), F.col("until") > F.col("pos")
    mark = F.substring(text, -1, 1)
    return rows.withColumns({
        "head": F.when(several, F.translate(F.substring_index(text, " ", 1), MARKS, "")).otherwise(text),
        "tail": F.when(~several, text).when(mark.isin(*MARKS), mark).otherwise(F.substring_index(text, " ", -1)),
    })


def statements(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``item``, the number of the statement in its scope, and their neighbours in the scope: next, b1 to b4 before.

    No statement ends within a run; of ``tokens`` with runs, next and next_pos follow a run's tail, b1 to b4 precede its head.
    """
    runs = "until" in tokens.columns
    scope = Window.partitionBy("path", "level", "scope").orderBy("pos")
    after = {"next": F.lead("head" if runs else "text").over(scope), "next_line": F.lead("line").over(scope), "next_pos": F.lead("pos").over(scope)}
    if runs:
        several = F.col("until") > F.col("pos")
        some = F.regexp_extract_all(F.substring_index("text", " ", -4), F.lit(PIECES), F.lit(0))  # four words at least, or all
        rows = tokens.withColumn("four", F.when(~several, F.array("text")).when(F.size(some) > 4, F.slice(some, -4, 4)).otherwise(some))
        rows = rows.withColumns({**after, **{f"f{n}": F.lag("four", n).over(scope) for n in range(1, 5)}})
        none = F.array().cast("array<string>")
        rows = rows.withColumn("behind", F.reverse(F.concat(*[F.coalesce(f"f{n}", none) for n in (4, 3, 2, 1)])))
        rows = rows.withColumns({f"b{n}": F.get("behind", F.lit(n - 1)) for n in range(1, 5)})
        b1 = F.when(~several, F.col("b1"))  # of a run's tail it is a word
    else:
        rows = tokens.withColumns({**after, **{f"b{n}": F.lag("text", n).over(scope) for n in range(1, 5)}})
        b1 = F.col("b1")
    text, none = F.col("tail" if runs else "text"), F.col("next").isNull()
    block = (text == "}") & ~F.col("next").isin(*AFTER_BLOCK)
    annotated = (F.coalesce(b1, F.lit("")) == "@") | ((text == ")") & (F.coalesce("b3", F.lit("")) == "@"))
    line = F.col("language").isin(*BY_LINE) & (F.col("next_line") > F.col("end_line")) & ~text.isin(*GOES_ON_AFTER) & ~F.col("next").isin(*GOES_ON_BEFORE) & ~annotated
    attribute = (F.col("language") == "rust") & (text == "]") & (F.coalesce("b1", F.lit("")) == "[") & (F.coalesce("b2", F.lit("")).isin("#", "!"))
    ends = ~none & (((text == ";") & (F.col("next") != ";")) | block | line | attribute)
    before = scope.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("item", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)).cast("int"))
    return rows.select("path", "language", "pos", "text", "line", "end_line", "level", "scope", "item", "next", "next_pos", "b1", "b2", "b3", "b4", *(["until", "tail"] if runs else []))


def asked(*symbols: str) -> Column:
    """The tokens of ``statements`` that calls, and usages of ``symbols``, are found by."""
    return (F.col("text") == "(") | F.coalesce(F.col("next") == "(", F.lit(False)) | F.col("text").isin(*symbols)


def in_runs(statements: DataFrame, *symbols: str) -> DataFrame:
    """``statements`` of runs with ``kept``, the tokens of each row that ``asked`` names, as ``items`` holds them."""
    called = F.coalesce(F.col("next") == "(", F.lit(False))
    several = F.col("until") > F.col("pos")
    here = called
    if symbols:
        here = here | F.col("text").rlike("(?:^| )(?:" + "|".join(map(re.escape, symbols)) + f")(?:$|[ {MARKS}])")
    cut = F.transform(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), lambda t, i: F.struct((F.col("pos") + i).alias("pos"), t.alias("text")))
    rows = statements.withColumn("run", F.when(several & here, F.filter(cut, lambda t: t["text"] != " ")))
    end = F.size("run") - 1
    hits = F.filter(F.sequence(F.lit(0), end), lambda k: F.get("run", k)["text"].isin(*symbols) | (called & (k == end)))
    behind = F.array("b1", "b2", "b3", "b4")

    def token(k):
        own, after = F.get("run", k), F.get("run", k + 1)
        near = [F.coalesce(F.get("run", k - n)["text"], F.get(behind, n - 1 - k)).alias(f"b{n}") for n in range(1, 5)]
        return F.struct(own["pos"].alias("pos"), own["text"].alias("text"), "line", F.coalesce(after["text"], "next").alias("next"), F.coalesce(after["pos"], "next_pos").alias("next_pos"), *near)

    whole = F.struct("pos", "text", "line", "next", "next_pos", "b1", "b2", "b3", "b4")
    return rows.withColumn("kept", F.when(several & here, F.transform(hits, token)).when(~several & asked(*symbols), F.array(whole))).drop("run")


def items(statements: DataFrame, keep: Column | None = None) -> DataFrame:
    """The statements: path, language, level, scope, item, first and last place, lines, body (the first brace's place), head, words.

    ``last`` is null, and the last line that of the last token, where a bracket stays open.  ``keep``: tokens that each
    statement is to hold, in a column ``kept`` (of runs: what ``in_runs`` gives each row); ``kept`` gives them as rows.
    """
    hold = [F.collect_list(F.when(keep, F.struct("pos", "text", "line", "next", "next_pos", "b1", "b2", "b3", "b4"))).alias("kept")] if keep is not None else []
    runs = "until" in statements.columns
    if "kept" in statements.columns:
        hold = [F.flatten(F.collect_list("kept")).alias("kept")]
    row = F.struct("pos", F.substring_index("text", " ", HEAD).alias("text"), "until") if runs else F.struct("pos", "text")
    per = statements.groupBy("path", "language", "level", "scope", "item").agg(
        F.min("pos").alias("first"), F.max("until" if runs else "pos").alias("last"), F.max_by("tail" if runs else "text", "pos").alias("final"), F.min("line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.min(F.when(F.col("text") == "{", F.col("pos"))).alias("body"), F.min(F.when(F.col("text").isin("=", ";", "=>", ":="), F.col("pos"))).alias("cut"),
        F.array_sort(F.collect_list(row)).alias("all"), F.max(F.col("text").isin("=", ":=")).alias("set"), *hold,
    )
    if runs:
        piece = lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(PIECE), F.lit(0)), lambda t, i: F.struct((x["pos"] + i).alias("pos"), t.alias("text")))
        one = lambda x: F.array(F.struct(x["pos"].alias("pos"), x["text"].alias("text")))
        cut = F.transform(F.slice("all", 1, HEAD), lambda x: F.when(x["until"] > x["pos"], F.filter(piece(x), lambda t: t["text"] != " ")).otherwise(one(x)))
        per = per.withColumn("all", F.slice(F.flatten(cut), 1, HEAD))
    upto = F.least(F.coalesce("body", F.lit(2**31 - 1)), F.coalesce("cut", F.lit(2**31 - 1)))
    words = F.filter(F.slice("all", 1, HEAD), lambda x: (x["pos"] < upto) | ((x["pos"] == upto) & (x["text"] == "{")))
    per = per.withColumn("words", words).withColumns({"head": F.array_join(F.transform("words", lambda x: x["text"]), " "), "first_word": F.get("all", F.lit(0))["text"]}).drop("all", "cut")
    everything = Window.partitionBy("path")
    open_ = F.col("final").isin("(", "[", "{")
    per = per.withColumn("all_lines", F.max("end_line").over(everything))
    per = per.withColumns({"end_line": F.when(open_, F.col("all_lines")).otherwise(F.col("end_line")), "last": F.when(~open_, F.col("last"))})
    return per.drop("final", "all_lines")


def kept(items: DataFrame) -> DataFrame:
    """The tokens that ``items`` hold, with the columns of ``statements`` that calls and usages need."""
    return items.select("path", "language", "level", "scope", F.explode("kept").alias("t")).select("path", "language", "level", "scope", "t.*")


def declared(items: DataFrame) -> DataFrame:
    """``items`` with name, its place and kind of what they declare, null for those that declare nothing; ``held``: in such a body.

    ``defines`` tells declarations of functions and types from those of values.
    """
    name = kind = F.lit(None).cast("string")
    inner = lambda i: F.when(F.col("language").isin(*DECLARATIONS[i][0].split()), F.nullif(F.regexp_extract("head", "(?s)" + DECLARATIONS[i][1], 1), F.lit("")))
    for member in (True, False):
        name = kind = F.lit(None).cast("string")
        for i in reversed(range(len(DECLARATIONS))):
            if DECLARATIONS[i][3] == member:
                found = inner(i)
                name, kind = F.coalesce(found, name), F.when(found.isNotNull(), F.lit(DECLARATIONS[i][2])).otherwise(kind)
        if member:
            ok = ~F.col("first_word").isin(*NO_MEMBER)
            items = items.withColumns({"own_name": F.when(ok, name), "own_kind": F.when(ok, kind)})
    items = items.withColumns({"name": name, "kind": kind})
    # a holder also stands under the place of its body, where its members' scope is
    holder = F.col("kind").isin(*HOLDERS) & F.col("body").isNotNull()
    under = F.when(holder, F.array("scope", "body")).otherwise(F.array("scope"))
    items = items.select("*", F.posexplode(under).alias("as_holder", "under"))
    items = items.withColumn("held", F.col("under").isNotNull() & (F.max("as_holder").over(Window.partitionBy("path", "under")) == 1)).where("as_holder = 0").drop("as_holder", "under")
    member = F.col("name").isNull() & F.col("held") & F.col("own_name").isNotNull()
    real = F.when(member, F.col("own_kind")).otherwise(F.col("kind"))
    exported = F.col("language").isin("javascript", "typescript") & (F.col("first_word") == "export") & F.col("name").isNotNull()
    items = items.withColumns({"kind": F.when(member, F.col("own_kind")).when(exported, F.lit("other")).otherwise(F.col("kind")), "name": F.when(member, F.col("own_name")).otherwise(F.col("name")), "defines": F.coalesce(real != "other", F.lit(False))})
    return items.withColumn("name_pos", F.get(F.filter("words", lambda x: x["text"] == F.col("name")), F.lit(0))["pos"]).drop("own_name", "own_kind", "words")


def spans(declared: DataFrame) -> DataFrame:
    """(path, name, symbol_type, start_line, end_line, pos): all declarations, as ``code.enclosing`` and others take them."""
    return declared.where("name is not null").select("path", "name", F.col("kind").alias("symbol_type"), "start_line", "end_line", F.col("first").alias("pos"))


def _pieces(lines: Column, first: Column, last: Column) -> Column:
    """Ranges (a, b) of lines of at most MAX_CHUNK characters, line ends counted, but of one line at least."""
    start = F.struct(F.lit(0).alias("size"), first.cast("int").alias("at"), F.array().cast("array<int>").alias("cuts"))
    long = lambda a, x: (a["size"] + F.length(x) + 1 > MAX_CHUNK) & (a["size"] > 0)
    grow = lambda a, x: F.struct(
        (F.when(long(a, x), F.lit(0)).otherwise(a["size"]) + F.length(x) + 1).alias("size"), (a["at"] + 1).alias("at"), F.when(long(a, x), F.array_append(a["cuts"], a["at"])).otherwise(a["cuts"]).alias("cuts")
    )
    cuts = F.aggregate(F.slice(lines, first, last - first + 1), start, grow, lambda a: a["cuts"])
    return F.arrays_zip(F.concat(F.array(first.cast("int")), cuts).alias("a"), F.concat(F.transform(cuts, lambda x: x - 1), F.array(last.cast("int"))).alias("b"))


def chunks(files: DataFrame, found: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Chunks of brace languages' files: path, symbol, symbol_type, start_line, end_line, text.

    A top declaration is one chunk if it is small enough; else its head and its members; else pieces; so are imports of
    Java and other statements of JS and TS.  Lines outside of them that are not blank make one preamble, unless it is too
    long.  A file without any is one chunk; one of white space none.
    """
    files, dealt = by_path(files, dealt).select("path", "content"), True  # once
    found = declared(items(statements(tokens(files, dealt, runs=True)))) if found is None else found
    own = by_path(files, dealt).select("path", (F.ltrim("content", F.lit(" \t\n\x0b\f\r")) != "").alias("any"), F.split("content", "\n", -1).alias("lines"))
    statement = F.col("language").isin("javascript", "typescript") & ~F.col("first_word").isin(*NO_MEMBER) | ((F.col("language") == "java") & (F.col("first_word") == "import"))
    top = F.col("scope").isNull() & (F.col("level") == 0) & (F.col("name").isNotNull() | statement)
    kept = found.withColumn("top", top).where(F.col("top") | (F.col("held") & F.col("name").isNotNull()))
    row = F.struct(F.col("first").alias("pos"), "top", F.col("name").alias("symbol"), F.coalesce("kind", F.lit("other")).alias("symbol_type"), "start_line", "end_line", "body", "scope", "held")
    per = kept.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("all"))
    both = own.join(per, "path", "left").withColumn("all", F.coalesce("all", F.array().cast(per.schema["all"].dataType)))
    both = both.withColumn("found", F.filter("all", lambda s: s["top"]))
    text = lambda a, b: F.array_join(F.slice("lines", a, b - a + 1), "\n")
    chunk = lambda s, a, b: F.struct(s["symbol"].alias("symbol"), s["symbol_type"].alias("symbol_type"), a.alias("start_line"), b.alias("end_line"), text(a, b).alias("text"))
    small = lambda s: F.length(text(s["start_line"], s["end_line"])) <= MAX_CHUNK
    whole = lambda s: F.array(chunk(s, s["start_line"], s["end_line"]))
    cut = lambda s: F.transform(_pieces(F.col("lines"), s["start_line"], s["end_line"]), lambda p: chunk(s, p["a"], p["b"]))
    members = lambda s: F.filter("all", lambda m: m["held"] & ~m["top"] & (m["scope"] == s["body"]))

    def divided(s):
        """A large declaration: its head and members, or pieces."""
        first = F.get(members(s), F.lit(0))["start_line"]
        head = F.filter(F.array(chunk(s, s["start_line"], first - 1)), lambda c: (first > s["start_line"]) & (F.length(c["text"]) <= MAX_CHUNK) & (F.regexp_replace(c["text"], SPACE, "") != ""))
        return F.when(first.isNull(), cut(s)).otherwise(F.concat(head, F.flatten(F.transform(members(s), lambda m: F.when(small(m), whole(m)).otherwise(cut(m))))))

    by_symbol = F.flatten(F.transform("found", lambda s: F.when(small(s), whole(s)).otherwise(divided(s))))
    # every line of a file that no top declaration covers, and is not blank
    covered = F.array_distinct(F.flatten(F.transform("found", lambda s: F.sequence(s["start_line"], s["end_line"]))))
    rest = F.filter(F.array_except(F.sequence(F.lit(1), F.size("lines")), covered), lambda i: F.trim(F.translate(F.element_at("lines", i), "\t\x0b\f\r", "    ")) != "")
    both = both.withColumns({"by_symbol": by_symbol, "rest": rest}).withColumn("body", F.array_join(F.transform("rest", lambda i: F.element_at("lines", i)), "\n"))
    none = F.lit(None).cast("string").alias("symbol")
    preamble = F.array(F.struct(none, F.lit("preamble").alias("symbol_type"), F.array_min("rest").alias("start_line"), F.array_max("rest").alias("end_line"), F.col("body").alias("text")))
    file = F.array(F.struct(none, F.lit("file").alias("symbol_type"), F.lit(1).alias("start_line"), F.size("lines").alias("end_line"), F.array_join("lines", "\n").alias("text")))
    every = F.when(F.size("found") == 0, file).when((F.size("rest") > 0) & (F.length("body") <= MAX_CHUNK), F.concat("by_symbol", preamble)).otherwise(F.col("by_symbol"))
    return both.where("any").select("path", F.inline(every))


def _calls(statements: DataFrame, declared: DataFrame) -> DataFrame:
    """Calls: path, language, pos (of the word), callee, line, open and close (places of the brackets), b2, b3, b4 before the word."""
    word = F.col("b1").rlike(f"^{WORD}$") & ~F.col("b1").isin(*NO_CALL)
    rows = statements.where((F.col("text") == "(") & word & (F.coalesce("b2", F.lit("")) != "@"))
    names = declared.where("name_pos is not null").select("path", F.col("name_pos").alias("pos"))
    rows = rows.select("path", "language", (F.col("pos")).alias("open"), F.when(F.col("next") == ")", F.col("next_pos")).alias("close"), F.col("b1").alias("callee"), "b2", "b3", "b4", "line", "level", "scope")
    # the word itself: the last token of its scope before the bracket
    own = statements.where(F.col("next") == "(").select("path", F.col("next_pos").alias("open"), "pos", F.col("line").alias("word_line"))
    rows = rows.join(own, ["path", "open"]).join(names, ["path", "pos"], "left_anti")
    return rows.select("path", "language", "pos", "callee", F.col("word_line").alias("line"), "open", "close", "b2", "b3", "b4")


def _open_at(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` (path, pos, ...) with what is open there, from ``intervals`` (path, type, first, last, name); null last: to the end.

    Per type t: t_first, the place where the outermost interval around the point begins, or null.  ``inner``: the name of the
    innermost interval of type def.  ``own_first``: the outermost of type define whose name is the point's ``symbol``.
    """
    kinds = ("import", "call", "set", "def", "define")
    row = F.struct("*")
    blank = F.lit(None)
    marks = intervals.select("path", F.explode(F.array(F.struct(F.col("first").alias("pos"), F.lit(0).alias("order"), F.lit(1).alias("step")), F.struct(F.col("last").alias("pos"), F.lit(2).alias("order"), F.lit(-1).alias("step")))).alias("m"), "type", F.col("name").alias("key"))
    marks = marks.where("m.pos is not null").select("path", "m.pos", "m.order", "m.step", "type", "key", blank.cast(points.select(row.alias("p")).schema["p"].dataType).alias("p"))
    own = points.select("path", "pos", F.lit(1).alias("order"), F.lit(0).alias("step"), blank.cast("string").alias("type"), F.col("symbol").alias("key"), row.alias("p"))
    rows = marks.unionByName(own)
    run = Window.partitionBy("path").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"{t}_depth": F.coalesce(F.sum(F.when(F.col("type") == t, F.col("step"))).over(run), F.lit(0)) for t in kinds})
    starts = lambda t: (F.col("type") == t) & (F.col("step") == 1)
    rows = rows.withColumns({f"{t}_first": F.when(F.col(f"{t}_depth") > 0, F.last(F.when(starts(t) & (F.col(f"{t}_depth") == 1), F.col("pos")), ignorenulls=True).over(run)) for t in ("import", "call", "set")})
    deep = Window.partitionBy("path", "def_depth").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inner", F.when(F.col("def_depth") > 0, F.last(F.when(starts("def"), F.col("key")), ignorenulls=True).over(deep)))
    named = Window.partitionBy("path", "key").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("own_depth", F.coalesce(F.sum(F.when(F.col("type") == "define", F.col("step"))).over(named), F.lit(0)))
    rows = rows.withColumn("own_first", F.when(F.col("own_depth") > 0, F.last(F.when(starts("define") & (F.col("own_depth") == 1), F.col("pos")), ignorenulls=True).over(named)))
    return rows.where("p is not null").select("p.*", "import_first", "call_first", "set_first", "inner", "own_first")


def _intervals(declared: DataFrame, calls: DataFrame) -> DataFrame:
    part = lambda df, type_, name=F.lit(None).cast("string"): df.select("path", F.lit(type_).alias("type"), "first", "last", name.alias("name"))
    own = declared.where("name is not null")
    return (
        part(declared.where(F.col("first_word").isin(*IMPORTS)), "import").unionByName(part(declared.where("set"), "set")).unionByName(part(own, "def", F.col("name")))
        .unionByName(part(own.where("defines"), "define", F.col("name"))).unionByName(calls.select("path", F.lit("call").alias("type"), F.col("open").alias("first"), F.col("close").alias("last"), F.lit(None).cast("string").alias("name")))
    )


def call_edges(statements: DataFrame, declared: DataFrame, module: str = "<module>", call_name: str = "last") -> DataFrame:
    """(caller, caller_path, callee, call_line, pos): the calls of files, by the innermost declaration that they stand in.

    ``call_name`` first names a call ``a.b()`` after ``a``.
    """
    calls = _calls(statements, declared)
    points = calls.select("path", "pos", F.col("callee").alias("symbol"), "line", "b2", "b3", "b4")
    at = _open_at(points, _intervals(declared, calls))
    simple = (F.col("b2") == ".") & F.col("b3").rlike(f"^{WORD}$") & ~(F.coalesce("b4", F.lit("")) == ".")
    name = F.when(simple, F.col("b3")).otherwise(F.col("symbol")) if call_name == "first" else F.col("symbol")
    return at.select(F.coalesce("inner", F.lit(module)).alias("caller"), F.col("path").alias("caller_path"), name.alias("callee"), F.col("line").alias("call_line"), "pos")


#: What comes before a type's name.
BEFORE_TYPE = (":", "<", "new", "extends", "implements", "throws", "instanceof", "->", "as")


def usages(statements: DataFrame, declared: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, symbol, usage, enclosing_symbol): how lines use ``symbols`` (symbol): the outermost of what a use stands in.

    An import; the declaration of a function or type of that name; a call, of the symbol or around it; an assignment; the
    symbol as a type; else a reference.  Of several uses in a line the one whose context begins first counts.
    """
    calls = _calls(statements, declared)
    asked = symbols.select(F.col("symbol").alias("text")).where("text is not null").distinct()
    hits = statements.join(asked, "text", "left_semi")
    points = hits.select("path", "pos", F.col("text").alias("symbol"), "line", "language", "next", "b1")
    names = declared.where("name_pos is not null").select("path", F.col("name_pos").alias("pos"), F.lit(True).alias("named"))
    points = points.join(names, ["path", "pos"], "left")
    at = _open_at(points, _intervals(declared, calls))
    itself = (F.col("next") == "(") & (F.coalesce("b1", F.lit("")) != "@") & F.col("named").isNull() & ~F.col("symbol").isin(*NO_CALL)
    typed = F.col("b1").isin(*BEFORE_TYPE) | ((F.col("language") == "java") & F.col("next").rlike(f"^{WORD}$"))
    event = lambda first, rank, name: F.when(first.isNotNull(), F.struct(first.alias("first"), F.lit(rank).alias("rank"), F.lit(name).alias("usage")))
    least = F.array_min(F.array(
        event(F.col("import_first"), 0, "import"), event(F.col("own_first"), 1, "definition"), event(F.coalesce("call_first", F.when(itself, F.col("pos"))), 2, "call"),
        event(F.col("set_first"), 3, "assignment"), event(F.when(typed, F.col("pos")), 4, "type_reference"), event(F.lit(2**31 - 1), 5, "reference"),
    ))
    rows = at.select("path", "line", "symbol", "inner", "pos", least.alias("e"))
    return rows.groupBy("path", "line", "symbol").agg(F.min_by(F.struct("e.usage", "inner"), F.struct("e.first", "e.rank", "pos")).alias("u")).select("path", "line", "symbol", "u.usage", F.col("u.inner").alias("enclosing_symbol"))
