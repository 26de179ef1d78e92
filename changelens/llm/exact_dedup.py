"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of 16 bytes says so, and becomes a recipe: the ordered list of
its chunks' SHA-256 identifiers.  Texts are equal when their recipes are.  Only chunks of texts whose recipe
digest recurs are moved: one copy of each chunk and map task goes to a byte comparison that proves that an
identifier stands for one content.  Long texts themselves never move.

Defined results.  Null text: as the empty text.  Null ``doc_id``: the row takes part and sorts below every
other, so it stays only in a group of nulls.  Rows that tie on ``doc_id`` in a group: exactly one is kept.  An
empty table gives no rows.  Other columns are carried by ``deduplicate`` and ignored by ``groups``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seq, work

#: A cut follows each position whose rolling hash has these 10 bits unset; no chunk is longer than MAX_CHUNK.
CUT_MASK, MAX_CHUNK, WINDOW = np.uint64(((1 << 10) - 1) << 40), 1 << 14, 16

#: Stands for a null doc_id, below every other.
NO_ID = -(1 << 63)
RECIPES = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("recipe", pa.binary()), ("text_sha256", pa.string())])
CHUNKS = pa.schema([("chunk", pa.binary()), ("content", pa.binary())])


def cut(text: bytes) -> list[bytes]:
    """The chunks of a text; joined they give it back, and they depend on nothing but the text."""
    n = len(text)
    if n <= WINDOW:
        return [text] if n else []
    out, at = [], 0
    for lo in range(0, n - WINDOW + 1, 1 << 17):  # blocks overlap by a window, so memory is bounded for any text
        h = seq.gram_hashes(seq.BYTE[np.frombuffer(text, np.uint8, min((1 << 17) + WINDOW - 1, n - lo), lo)], WINDOW)
        for end in (np.flatnonzero(h & CUT_MASK == 0) + lo + WINDOW).tolist():
            while end - at > MAX_CHUNK:
                out.append(text[at : at + MAX_CHUNK])
                at += MAX_CHUNK
            if end > at:
                out.append(text[at:end])
            at = end
    while n - at > MAX_CHUNK:
        out.append(text[at : at + MAX_CHUNK])
        at += MAX_CHUNK
    return [*out, text[at:]] if at < n else out


def _recipe(text: bytes) -> tuple[list[bytes], bytes]:
    chunks = cut(text)
    return chunks, b"".join(hashlib.sha256(c).digest() for c in chunks)


def _digest(recipe: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(recipe, digest_size=8).digest(), "little", signed=True)


def _recipes(batches):
    for b in batches:
        rows = []
        for v in work.texts(b.column(1)):
            v = (v or b"").translate(seq.LOWER)
            recipe = _recipe(v)[1]
            rows.append((_digest(recipe), recipe, hashlib.sha256(v).hexdigest()))
        yield work.batch(RECIPES, b.column(0), *([list(c) for c in zip(*rows)] or [[], [], []]))


def _chunks_of(bitmap):
    def run(batches):
        known: set[bytes] = set()
        for b in batches:
            names, contents = [], []
            for v in work.texts(b.column(0)):
                chunks, recipe = _recipe((v or b"").translate(seq.LOWER))
                if work.in_bloom(bitmap.value, np.array([_digest(recipe)], np.int64).view(np.uint64))[0]:
                    for k, c in enumerate(chunks):
                        if (name := recipe[32 * k : 32 * k + 32]) not in known:
                            known.add(name)
                            names.append(name)
                            contents.append(c)
            if len(known) > 1 << 18:  # a bounded memory of what this task has sent; sending twice is harmless
                known.clear()
            yield work.batch(CHUNKS, names, contents)

    return run


def groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = src.mapInArrow(_recipes, "doc_id long, digest long, recipe binary, text_sha256 string")
    base = work.stage(base.withColumn("row", F.monotonically_increasing_id()))
    again = work.stage(base.groupBy("digest").count().where("count > 1").select("digest"))
    bitmap = work.share(spark, work.bloom(again, "digest"))
    chunks = src.select("text").mapInArrow(_chunks_of(bitmap), "chunk binary, content binary")
    wrong = chunks.groupBy("chunk").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").limit(1).count()
    if wrong:
        raise ArithmeticError("one chunk identifier stands for two contents")
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("o"), "doc_id", "row"))
    same = base.groupBy("recipe").agg(best.alias("top"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    same = work.stage(same.select("recipe", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"))
    out = base.join(same, "recipe", "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of equal texts.

    Rows go by doc_id.  Only where several rows share a doc_id, and some stay and some go, are the texts of those rows
    looked at again; which of wholly tied rows stays is arbitrary.
    """
    decided = work.stage(groups(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "kept", F.col("text_sha256").alias("sha")))
    per = work.stage(decided.groupBy("id").agg(F.max("kept").alias("any"), F.min("kept").alias("all")).where("not all"))
    packed = work.packed(docs, NO_ID)
    out = packed.join(per.select("id"), "id", "left_anti")
    mixed = per.where("any").select("id")
    if mixed.isEmpty():
        return out.select("row.*")
    text = F.translate(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = packed.join(mixed, "id", "left_semi").withColumn("sha", F.sha2(text, 256))
    stay = decided.where("kept").select("id", "sha").distinct()
    own = own.join(stay, ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"])
    return out.select("row").union(own.select("row")).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(work.read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
