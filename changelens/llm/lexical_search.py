"""Ranked lexical search over document-sharded postings with precomputed integer impacts.

The documents of a task are cut into shards.  A shard's postings are one row in compressed sparse form: its terms in
order, where each one's postings begin, the places of documents in the shard and their impacts.  An impact is what a
document gives to a score besides the term's weight; it depends on the term's count, the document's length and two
totals of the corpus, so it is computed once, when the index is written.  Weights follow from document frequencies,
which are sums over the shards' rows.

A search sends queries in blocks.  Each task goes through its shards term by term: the impacts of a term, times its
weight, are added into a dense accumulator of the shard for each query that asks for it.  ``argpartition`` finds the
shard's k-th score; all above it are kept, and of those that equal it the first by doc_id, so ties lose nothing.  A
task keeps the best k of its shards, and those are merged in two steps.  All sums are 64-bit integers: results do not
depend on how documents are dealt.

Defined results.  Null text: no terms.  Null ``doc_id``: takes part and sorts last among equal scores.  Repeated
documents: each is ranked.  Repeated item rows: each is a query of its own under its item_id.  A query without terms, or
with none that occurs, has no rows; a query's terms count once each.  Empty tables give no rows.  A text of any length
is read whole, in parts.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import seq, work

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
IN_TERM = np.array([TERM.fullmatch(bytes([c])) is not None for c in range(256)])
#: Bytes of text and documents of a shard; bytes of a text that are looked at together.
SHARD_BYTES, SHARD_DOCS, PART = 1 << 23, 1 << 14, 1 << 20
#: Shards of a file, as many as a reader holds at once.
FILE_SHARDS = 4
#: Items and different terms that are sent at once; groups in which the tasks' best are merged first.
BLOCK, BLOCK_TERMS, SALT = 1024, 1 << 18, 64
#: Constants of the impact: scale, and the fixed and length-dependent shares of the damping in hundredths and tenths.
SCALE, FIXED, BY_LENGTH, K1 = 1_000_000_000, 100, 90, 8
DEPTH = 10
SHARDS = "docs array<long>, terms array<binary>, first array<int>, place array<int>, impact array<int>"


def terms(text: bytes | None):
    """The terms of a text in lists, a part of it at a time."""
    at, n = 0, len(text) if text else 0
    while at < n:
        end = min(n, at + PART)
        while end < n and IN_TERM[text[end]]:
            end += 1
        yield TERM.findall(text[at:end].translate(seq.LOWER))
        at = end


def _length(text: bytes | None) -> int:
    """How many terms a text has."""
    n, before = 0, False
    for at in range(0, len(text) if text else 0, PART):
        inside = IN_TERM[np.frombuffer(text, np.uint8, min(PART, len(text) - at), at)]
        n += int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0] and not before)
        before = bool(inside[-1])
    return n


def _lengths(batches):
    for b in batches:
        n = [_length(v) for v in work.texts(b.column(0))]
        yield work.batch(pa.schema([("documents", pa.int64()), ("words", pa.int64())]), [sum(x > 0 for x in n)], [sum(n)])


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the documents that have a term, and L, all their terms with repeats."""
    work.ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths, "documents long, words long")
    n, words = rows.agg(F.sum("documents"), F.sum("words")).first()
    return n or 0, words or 0


def impacts(tf: np.ndarray, length: np.ndarray, n: int, words: int) -> np.ndarray:
    """What a term that occurs tf times gives to a document of so many terms, times its weight."""
    m = FIXED - BY_LENGTH + (BY_LENGTH * length * n) // max(words, 1)
    return (SCALE * tf) // (1000 * tf + K1 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _shard(held: list, n: int, words: int) -> pa.RecordBatch:
    """The row of a shard from (doc_id, {term: count})."""
    held = sorted(held, key=lambda x: (x[0] is None, x[0]))  # in the order of ties
    names = sorted({t for _, c in held for t in c})
    number = {t: i for i, t in enumerate(names)}
    size = [len(c) for _, c in held]
    total = sum(size)
    term = np.fromiter((number[t] for _, c in held for t in c), np.int64, total)
    tf = np.fromiter((k for _, c in held for k in c.values()), np.int64, total)
    place = np.repeat(np.arange(len(held)), size)
    length = np.bincount(place, tf, len(held)).astype(np.int64)
    order = np.argsort(term, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(names)))))
    impact = impacts(tf, length[place], n, words)[order]
    columns = [
        pa.array([[k for k, _ in held]], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.binary())),
        *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (first, place[order], impact)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["docs", "terms", "first", "place", "impact"])


def _index(n: int, words: int, most: int):
    def run(batches):
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), work.texts(b.column(1))):
                counts = Counter()
                for some in terms(text):
                    counts.update(some)
                if not counts:
                    continue  # has no score
                held.append((doc, counts))
                size += len(text)
                if size >= SHARD_BYTES or len(held) >= most:
                    yield _shard(held, n, words)
                    held, size = [], 0
        if held:
            yield _shard(held, n, words)

    return run


class Index:
    """The shards of a corpus, a table that every executor reads, and the number of its documents."""

    def __init__(self, shards: DataFrame, n: int):
        self.shards, self.n = shards, n


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of documents (doc_id, text), written to the shared folder; a shard has at most ``shard_docs`` of them."""
    n, words = totals(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Index(work.stage(src.mapInArrow(_index(n, words, shard_docs), SHARDS), rows=FILE_SHARDS), n)


def _blocks(items: DataFrame, most: int):
    """Item ids and the terms of each, in blocks bounded by their number and by their terms, streamed to the driver."""
    ids, asked, size = [], [], 0
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        own = sorted({t for some in terms((r[1] or "").encode()) for t in some})
        if ids and (len(ids) == most or size + len(own) > BLOCK_TERMS):
            yield ids, asked
            ids, asked, size = [], [], 0
        if own:
            ids.append(r[0])
            asked.append(own)
            size += len(own)
    if ids:
        yield ids, asked


def _frequencies(shared):
    """(term's number, documents of the task that hold it)."""
    schema = pa.schema([("at", pa.int32()), ("df", pa.int64())])

    def run(batches):
        names = pa.array(shared.value, pa.binary())
        total = np.zeros(len(names), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                own, first = b.column(0)[i].values, b.column(1)[i].values.to_numpy()
                at = pc.index_in(names.cast(own.type), own).to_numpy(zero_copy_only=False)
                here = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
                total[here] += np.diff(first)[at[here].astype(np.int64)]
        some = np.flatnonzero(total)
        yield work.batch(schema, some.astype(np.int32), total[some])

    return run


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above zero, of equal ones the first; in order of place."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        above = np.flatnonzero(score > max(least, 0))
        if least > 0:
            above = np.sort(np.concatenate((above, np.flatnonzero(score == least)[: k - len(above)])))
        return above
    return np.flatnonzero(score > 0)


def _search(shared, k: int):
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        names, weights, asked = shared.value
        names = pa.array(names, pa.binary())
        found: list[list] = [[] for _ in asked]
        for b in batches:
            for i in range(b.num_rows):
                docs, own, first, place, impact = (b.column(c)[i].values for c in range(5))
                docs = docs.to_pylist()
                first, place, impact = first.to_numpy(), place.to_numpy(), impact.to_numpy()
                at = pc.index_in(names.cast(own.type), own).to_pylist()
                part = [None if x is None else (place[first[x] : first[x + 1]], weights[t] * impact[first[x] : first[x + 1]].astype(np.int64)) for t, x in enumerate(at)]
                score = np.zeros(len(docs), np.int64)
                for q, wanted in enumerate(asked):
                    score[:] = 0
                    for t in wanted:
                        if part[t] is not None:
                            score[part[t][0]] += part[t][1]  # a document stands once under a term
                    found[q] = _first(found[q] + [(int(score[x]), docs[x]) for x in best(score, k).tolist()], k)
        rows = [(q, doc, s) for q, some in enumerate(found) for s, doc in some]
        yield work.batch(schema, *([list(c) for c in zip(*rows)] or [[], [], []]))

    return run


def _first(rows: list, k: int) -> list:
    return rows if len(rows) <= k else sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]


def search(index: Index, items: DataFrame, k: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text), ``block`` items in a pass."""
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for ids, asked in _blocks(items, block):
        names = sorted({t for own in asked for t in own})
        df = np.zeros(len(names), np.int64)
        counts = index.shards.select("terms", "first").mapInArrow(_frequencies(work.share(spark, names)), "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()  # the terms of a block
        df[counts.column("at").to_numpy()] = counts.column("df").to_numpy()
        number = {t: i for i, t in enumerate(names)}
        asking = work.share(spark, (names, [weight(index.n, int(x)) for x in df], [[number[t] for t in own] for own in asked]))
        rows = index.shards.mapInArrow(_search(asking, k), "query long, doc_id long, score long")
        rows = _ranked(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))), ["query", "salt"], k).drop("salt", "rank")
        name = spark.createDataFrame(list(enumerate(ids)), f"query long, item_id {kind}")  # at most BLOCK rows
        part = _ranked(rows, ["query"], k).join(F.broadcast(name), "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(work.read(spark, sf_dir, "documents")), work.read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
l AS (SELECT doc_id, len(t) AS n, t FROM d WHERE len(t) > 0), g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM l) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, nn),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10
"""
