"""Personal data by patterns and bootstrapped contextual extraction, with DataFrame functions only.

Base entities (email, ip, card, phone) come from four patterns and their checks.  They are the seeds.  The two words
before an entity are a lexical pattern, and so are the two after it (with the start or the end of the text, and what
there is, where there is but one).  Identifier-like words (with a digit or an at sign) elsewhere are instances.
Patterns and instances form a graph whose scores go back and forth for ROUNDS rounds: a pattern scores, for each kind,
the mean of its instances' scores weighted by how often they occur; an instance that is no seed scores the weighted
mean of its patterns, on the side that says more.  A pattern counts from SUPPORT different entities on: seeds and, from
the second round on, instances that score CONFIDENT or more, so what has been found induces patterns that no seed has
shown.  Where a pattern and its instance both score CONFIDENT or more for a kind, and the instance has the kind's shape,
the occurrence is a span of that kind.

The patterns are written so that no text makes them go back over what they have read: long runs of digits or letters
cost time in proportion to their length.  Spans of a kind never overlap; those of different kinds may.

Defined results.  Null text: as the empty text, no spans.  Null doc_id: an ordinary row.  Repeated rows: each gets its
own spans; an entity that occurs twice counts twice in the graph.  Empty table: no rows.  Other columns, whatever their
names: carried by ``redact``, ignored by ``find``.  n_email, n_ip, n_card and n_phone count base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in forms that match the same text without backtracking.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like word: it has a digit or an at sign.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What an instance of each kind must look like beyond its context.
SHAPES = {
    "email": r"^[^@]{1,64}@[^@]{3,}$",
    "ip": r"^[0-9]{1,3}([.:,][0-9]{1,3}){3}[.,;]?$",
    "card": r"^[0-9]([0-9-]{11,21})[0-9][.,;]?$",
    "phone": r"^[+(]?[0-9][0-9().-]{6,18}[0-9][.,;]?$",
}
ROUNDS, SUPPORT, CONFIDENT = 6, 5, 0.9
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for the start or the end of the text; a context of more characters than LONG is named by its digest.
START, LONG = "\n", 128


def matched(text: Column, pattern: str, guard: Column, name: str) -> list[Column]:
    """Two columns: the matches of a pattern, and what lies before each and after the last."""
    empty = F.expr("cast(array() as array<string>)")
    found = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    return [found.alias(f"f_{name}"), F.when(guard, F.split(text, pattern, -1)).otherwise(empty).alias(f"g_{name}")]


def measure(s: Column) -> Column:
    """Length, runs of white space, and length after the last of them."""
    parts = F.split(s, SPACE, -1)
    return F.struct(F.length(s).alias("n"), (F.size(parts) - 1).alias("spaces"), F.length(F.element_at(parts, -1)).alias("tail"))


def moved(at: Column, m: Column) -> Column:
    """A place (at, spaces, part) moved over text of measure ``m``; part is how much of its word lies before a place."""
    part = F.when(m["spaces"] > 0, m["tail"]).otherwise(at["part"] + m["n"])
    return F.struct((at["at"] + m["n"]).alias("at"), (at["spaces"] + m["spaces"]).alias("spaces"), part.alias("part"))


def pieces(name: str) -> Column:
    """The matches of ``matched``: array of (start, end, value, and places of both ends), in code points.

    What lies between matches and the matches themselves alternate, so running measures give places.  They are
    summed by runs of 64 matches, so the cost grows little faster than the number of matches.
    """
    found, gaps = F.col(f"f_{name}"), F.col(f"g_{name}")
    runs = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.floor((F.size(found) - 1) / 64).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    part = lambda c, j: F.slice(c, j * 64 + 1, 64)
    pairs = lambda j: F.zip_with(F.slice(part(gaps, j), 1, F.size(part(found, j))), part(found, j), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    sums = F.transform(runs, lambda j: measure(F.array_join(F.transform(pairs(j), lambda x: F.concat(x["g"], x["m"])), "")))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, value: string, spaces: int, part: int, after: int, done: int>>)")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("spaces"), F.lit(0).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        def over(start: Column) -> Column:
            end = moved(start, measure(x["m"]))
            one = F.struct(start["at"].alias("start"), end["at"].alias("end"), x["m"].alias("value"), start["spaces"].alias("spaces"), start["part"].alias("part"), end["spaces"].alias("after"), end["part"].alias("done"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.element_at(F.transform(F.array(moved(acc["at"], measure(x["g"]))), over), 1)

    def of(sums: Column) -> Column:
        def run(j: Column) -> Column:
            before = F.aggregate(F.slice(sums, 1, j), zero, moved)
            return F.aggregate(pairs(j), F.struct(before.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

        return F.flatten(F.transform(runs, run))

    return F.element_at(F.transform(F.array(sums), of), 1)


def named(words: Column) -> Column:
    """The name of a context of words, which are joined by one space."""
    whole = F.lower(F.array_join(words, " "))
    return F.when(F.length(whole) > LONG, F.sha2(whole, 256)).otherwise(whole)


def left(x: Column) -> Column:
    """The two words before a piece, from the words of the whole text; START stands for one that is missing, null for both."""
    words, none = F.col("split"), F.expr("cast(array() as array<string>)")
    own = F.when(x["part"] > 0, F.array(F.substring(F.element_at(words, x["spaces"] + 1), F.lit(1), x["part"]))).otherwise(none)
    n = F.least(x["spaces"], F.when(x["part"] > 0, 1).otherwise(2))
    some = F.filter(F.concat(F.slice(words, x["spaces"] - n + 1, n), own), lambda w: w != "")
    return F.when(F.size(some) > 0, named(F.concat(F.array(F.lit("<")), F.when(F.size(some) < 2, F.concat(F.array(F.lit(START)), some)).otherwise(some))))


def right(x: Column) -> Column:
    """The two words after a piece, the rest of its own word first; START stands for one that is missing, null for both."""
    words, none = F.col("split"), F.expr("cast(array() as array<string>)")
    word = F.element_at(words, x["after"] + 1)
    rest = F.when(F.length(word) > x["done"], F.array(F.substring(word, x["done"] + 1, F.length(word)))).otherwise(none)
    some = F.slice(F.filter(F.concat(rest, F.slice(words, x["after"] + 2, 2)), lambda w: w != ""), 1, 2)
    return F.when(F.size(some) > 0, named(F.concat(F.array(F.lit(">")), F.when(F.size(some) < 2, F.concat(some, F.array(F.lit(START)))).otherwise(some))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    total = F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x["i"] % 2 == 1, doubled(x["d"])).otherwise(x["d"]))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(value))
    if kind == "card":
        return n.between(14, 19) & luhn(digits(value))
    return n.between(10, 15)


def base_spans() -> Column:
    """The base entities of a row of matches: array of (start, kind, end, value, sides), ordered by start, then kind."""

    def of(k: int, kind: str) -> Column:
        ok = F.filter(pieces(kind), lambda x: valid(kind, x["value"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), F.array(left(x), right(x)).alias("sides")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def scored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) with their scores after ROUNDS rounds, from (left, value, kind or null, n).

    ``left`` names a pattern, its first letter the side.  patterns: left, kind, score, seeds (entities that support
    it).  instances that are no seeds: value, kind, score.
    """
    seeds = edges.where("kind is not null").select("left", "value", "kind", F.col("n").cast("double").alias("s"), F.lit(True).alias("sure"))
    others = work.stage(edges.where("kind is null").select("left", "value", "n"))
    total = work.stage(edges.groupBy("left").agg(F.sum("n").alias("total")))
    side = F.substring("left", 1, 1).alias("side")
    count = work.stage(others.groupBy("value", side).agg(F.sum("n").alias("times")))
    known = seeds
    for k in range(ROUNDS):
        per = known.groupBy("left", "kind").agg(F.sum("s").alias("s"), F.count_if("sure").alias("seeds")).where(F.col("seeds") >= SUPPORT)
        patterns = work.stage(per.join(total, "left").select("left", "kind", (F.col("s") / F.col("total")).alias("score"), "seeds"))
        reach = others.join(patterns, "left").groupBy("value", side, "kind").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
        reach = reach.join(count, ["value", "side"]).groupBy("value", "kind").agg(F.max(F.col("s") / F.col("times")).alias("score"))
        instances = work.stage(reach)
        if k + 1 < ROUNDS:
            more = others.join(instances, "value").select("left", "value", "kind", (F.col("n") * F.col("score")).alias("s"), (F.col("score") >= CONFIDENT).alias("sure"))
            known = seeds.union(more)
    return patterns, instances


def _spans(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, sha, base, spans); ``row`` numbers the rows of ``docs``, ``sha`` names the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    some = t.rlike("[0-9@]")
    guards = {"email": t.contains("@"), "ip": some & t.contains("."), "card": some, "phone": t.contains("+")}
    raw = src.select("doc_id", F.sha2(t, 256).alias("sha"), F.split(t, SPACE, -1).alias("split"), *[c for k in KINDS for c in matched(t, PATTERNS[k], guards[k], k)], *matched(t, WORD, some, "word"))
    words = F.transform(pieces("word"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.array(left(x), right(x)).alias("sides")))
    found = raw.select("doc_id", "sha", base_spans().alias("base"), words.alias("words"))
    found = work.stage(found.withColumn("row", F.monotonically_increasing_id()))
    apart = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    own = found.where(F.size("words") > 0).select("row", F.inline(F.filter("words", apart)))
    own = work.stage(own.select("row", "start", "end", "value", F.explode(F.array_compact("sides")).alias("left")))
    seeds = found.select(F.inline("base")).select(F.explode(F.array_compact("sides")).alias("left"), F.lower("value").alias("value"), "kind")
    others = own.select("left", F.lower("value").alias("value"), F.lit(None).cast("int").alias("kind"))
    edges = work.stage(seeds.union(others).groupBy("left", "value", "kind").agg(F.count(F.lit(1)).alias("n")))
    patterns, instances = scored(edges)
    sure = work.stage(patterns.where(F.col("score") >= CONFIDENT).select("left", "kind"))
    likely = work.stage(instances.where(F.col("score") >= CONFIDENT).select(F.col("value").alias("name"), "kind"))
    new = own.join(sure, "left").withColumn("name", F.lower("value")).join(likely, ["name", "kind"]).select("row", "start", "kind", "end", "value")
    shape = F.element_at(F.array(*[F.col("value").rlike(SHAPES[k]) for k in KINDS]), F.col("kind") + 1)
    new = new.where(shape).groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("new"))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = found.join(work.stage(new), "row", "left").select("row", "doc_id", "sha", bare.alias("base"), "new")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    return out.select("row", "doc_id", "sha", "base", F.array_sort(F.concat("base", F.coalesce("new", none))).alias("spans"))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    out = _spans(docs)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select("doc_id", *map(count, range(len(KINDS))), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with each span of ``text`` replaced by its kind in brackets.

    Spans depend on the text alone, beside the patterns of the whole table, so rows meet their spans by text.
    """
    spans = _spans(docs).where(F.size("spans") > 0).groupBy("sha").agg(F.first("spans").alias("spans"))
    names, text = F.array(*map(F.lit, KINDS)), F.col("row.text").cast("string")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        put = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), put.alias("out"))

    whole = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    packed = docs.select(F.struct("*").alias("row")).withColumn("sha", F.sha2(F.coalesce(text, F.lit("")), 256))
    both = packed.join(work.stage(spans), "sha", "left")
    return both.select(F.col("row").withField("text", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(whole)).alias("row")).select("row.*")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(work.read(spark, sf_dir, "documents"))
