"""Fill-in-middle transformation: texts cut into units by lookaround splitting, and rearranged around two cuts.

A unit grammar is translated to the places where one unit ends and the next begins: zero-width boundaries that look at
the classes of the two neighbouring characters only.  Splitting there keeps every character, so the pieces joined are
the text again.  A text of no character has no units; it is handled by itself, as a split of it would give one.

The two cuts and the form of a document are drawn from a digest of its doc_id, so reruns agree and no state is needed.
Everything is a column expression: one pass over the documents, no exchange, no Python.

Defined results.  Null text: as the empty text, which stays plain.  Null ``doc_id``: drawn as if its decimal form were
empty.  A text that holds one of the marks stays plain, as it could not be told apart again.  Repeated rows: one row
out for each, all alike.  Empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

ANY, SPACE = r"[\s\S]", r"\x20\x09-\x0D"
#: Each grammar as pairs of classes: a boundary lies between a character of the first and one of the second.
#: line: `[^\n]*\n|[^\n]+`; word: `[^ ]+[ ]*`, spaces before the first word apart; sentence: `[^.!?]*[.!?]+` and what is
#: left; char: one code point.
UNITS = {
    "line": [(r"\n", ANY)],
    "word": [(f"[{SPACE}]", f"[^{SPACE}]")],
    "sentence": [("[.!?]", "[^.!?]")],
    "char": [(ANY, ANY)],
}
#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are rearranged, and so many of those have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = "7:"


def boundary(unit: str) -> str:
    """The regular expression of no width that matches between two units."""
    return "|".join(f"(?<={a})(?={b})" for a, b in UNITS[unit])


def pieces(text: Column, unit: str = "line") -> Column:
    """The units of a text in order."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the document's id only."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h = draws(F.col("doc_id"), seed)
    rows = src.select("*", pieces(F.col("text"), unit).alias("units"), F.array(h).alias("h")).withColumn("n", F.size("units").cast("long"))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    first, second = (F.col("h")[i] % (F.col("n") + 1) for i in (0, 1))
    rows = rows.select("doc_id", "text", "units", "n", form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, size), ""))
    one = F.lit(1)
    rows = rows.select(
        "doc_id", "text", "n", "form",
        part(one, F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.size("units") - F.col("b")).alias("suffix"),
    )
    p, s, m = map(F.lit, MARKS)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from which an output of that form was made."""
    part = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(work.read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', doc_id)) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) WHEN 'spm' THEN concat('<S>', suf, '<P>', pre, '<M>', mid) ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
