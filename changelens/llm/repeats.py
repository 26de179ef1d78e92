"""Candidate search shared by the two substring deduplicators: which windows of W symbols can recur at all.

A window is named by its anchor, the leftmost least hash among its runs of K symbols.  Equal windows have equal
anchors at equal offsets, so only windows of one anchor need to meet.  Neighbouring windows mostly share an anchor;
those of one anchor occurrence make a cell.  Anchors that occur once are dropped by a bitmap of those that recur.

Anchors of more than HOT occurrences (of more than the corpus's total over MAX_HOT, if that is more) are hot, and so
are runs that occur as often in windows of hot anchors; at most 2 * MAX_HOT names are hot, and they are broadcast.  A
hot run is an anchor only where a window has no other: common runs in ever new surroundings thus meet under rarer
names, and under a hot name meet only windows that are hot throughout, which are few different ones.  Copies of one content are combined by each task before anything is shuffled, so a hot
name brings no more rows than tasks and different contents.

Rows with one doc_id and one text are one document here.  Documents are ordered by doc_id, null last, then by a hash
of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seq, work

#: Occurrences from which an anchor is hot; most hot names, 8 bytes each, that are broadcast.
HOT, MAX_HOT = 4096, 1 << 22
#: Cells a shuffle partition and a chunk hold; symbols of a text that are handled at once; contents a task remembers.
CELLS, CHUNK, BLOCK, MEMORY = 200_000, 20_000, 1 << 18, 1 << 17
NO_ID = (1 << 63) - 1
TOP = seq.U(1 << 63)

ANCHORS = pa.schema([("key", pa.int64()), ("n", pa.int64())])
CELL = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])
CELL_DDL = "key long, doc long, th long, start long, n long, content binary"


@dataclass(frozen=True)
class Spec:
    """What a symbol is (``words`` or bytes), the window W and the run K that names it."""

    words: bool
    window: int
    run: int


class Symbols:
    """Hashes of the symbols of a run of texts, each text's first and past-last symbol, and contents of stretches."""

    def __init__(self, spec: Spec, values: list[bytes | None]):
        if spec.words:
            w = seq.Words(values)
            self.buf, self.hash, self.first, self.last = w.buf, w.hash, w.first, w.last
            self.words = self.buf.tobytes().split()
        else:
            self.buf, self.first, self.last = seq.joined(values)
            self.hash, self.words, self.text = None, None, self.buf.tobytes()

    def blocks(self, spec: Spec):
        """(offset, hashes) of stretches that overlap by a window, so every window is in exactly one by its start."""
        n = len(self.buf) if self.hash is None else len(self.hash)
        for lo in range(0, max(1, n - spec.window + 1), BLOCK):
            part = slice(lo, min(n, lo + BLOCK + spec.window - 1))
            yield lo, seq.BYTE[self.buf[part]] if self.hash is None else self.hash[part]

    def content(self, a: int, b: int) -> bytes:
        return self.text[a:b] if self.words is None else b" ".join(self.words[a:b])


class Hot:
    """The hot names, sorted, and a table that tells most others apart at once."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.table = np.zeros(1 << min(26, max(16, (64 * len(names)).bit_length())), bool)
        self.table[(names & seq.U(len(self.table) - 1)).astype(np.int64)] = True

    def among(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), bool)
        if len(self.names):
            at = np.flatnonzero(self.table[(g & seq.U(len(self.table) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.names, g[at]), len(self.names) - 1)
            out[at] = self.names[k] == g[at]
        return out


def cells(spec: Spec, s: Symbols, hot: Hot | None = None):
    """Per block: text index, anchor, first and last window of each cell, and whether a run of it is hot."""
    for off, h in s.blocks(spec):
        g = seq.gram_hashes(h, spec.run) >> seq.U(1)
        burns = hot.among(g) if hot is not None else np.zeros(0, bool)
        if burns.any():
            g[burns] |= TOP  # last in rank
        p, lo, hi = seq.winnow(g, spec.window - spec.run + 1)
        d = np.searchsorted(s.last, p + off, side="right")
        ok = d < len(s.last)
        p, lo, hi, d = p[ok], lo[ok] + off, hi[ok] + off, d[ok]
        lo, hi = np.maximum(lo, s.first[d]), np.minimum(hi, s.last[d] - spec.window)
        ok = (lo <= hi) & (hi <= p + off)
        p, lo, hi, d = p[ok], lo[ok], hi[ok], d[ok]
        near = np.zeros(len(p), bool)
        if burns.any():
            total = np.concatenate(([0], np.cumsum(burns)))
            near = total[hi - off + spec.window - spec.run + 1] > total[lo - off]
        yield d, g[p], lo, hi, near


def _anchors(spec: Spec):
    def run(batches):
        for b in batches:
            values, found = work.texts(b.column(0)), []
            for lo, hi in work.segments(values):
                found += [c[1] for c in cells(spec, Symbols(spec, values[lo:hi]))]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield work.batch(ANCHORS, key.view(np.int64), n.astype(np.int64))

    return run


def _around(spec: Spec, hot):
    """The runs of windows whose anchors are hot, counted where they stand."""

    def run(batches):
        names = Hot(hot.value)
        for b in batches:
            values, found = work.texts(b.column(0)), []
            for lo, hi in work.segments(values):
                s = Symbols(spec, values[lo:hi])
                ends = [(first[at], last[at]) for _, key, first, last, _ in cells(spec, s) for at in [names.among(key)] if at.any()]
                if not ends:
                    continue
                first, last = (np.concatenate(x) for x in zip(*ends))
                edge = np.zeros(int(last.max()) + spec.window - spec.run + 3, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + spec.window - spec.run + 1, -1)
                inside = np.cumsum(edge) > 0
                done = 0  # blocks overlap; each run counts once
                for off, h in s.blocks(spec):
                    g = seq.gram_hashes(h, spec.run) >> seq.U(1)
                    at = np.arange(max(off, done), min(off + len(g), len(inside)))
                    found.append(g[at[inside[at]] - off])
                    done = off + len(g)
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield work.batch(ANCHORS, key.view(np.int64), n.astype(np.int64))

    return run


def _cells(spec: Spec, bitmap, hot, sender):
    def run(batches):
        send, names = sender(), Hot(hot.value)
        for b in batches:
            doc, th, values = b.column(0).to_numpy(), b.column(1).to_numpy(), work.texts(b.column(2))
            for lo, hi in work.segments(values):
                s, rows = Symbols(spec, values[lo:hi]), []
                for d, key, first, last, near in cells(spec, s, names):
                    ok = work.in_bloom(bitmap.value, key) | near
                    d, key, first, last = d[ok], key[ok], first[ok], last[ok]
                    row = d + lo
                    text = [s.content(x, y + spec.window) for x, y in zip(first.tolist(), last.tolist())]
                    rows += zip(key.view(np.int64).tolist(), doc[row].tolist(), th[row].tolist(), (first - s.first[d]).tolist(), (last - first + 1).tolist(), text)
                out = send(rows)
                if out:
                    yield work.batch(CELL, *map(list, zip(*out)))

    return run


def spread(*parts: int) -> int:
    """A name for a row that need not meet any other."""
    h = sum(p * q for p, q in zip(parts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) & (2**64 - 1)
    h ^= h >> 31
    return (h * 0xBF58476D1CE4E5B9 & (2**64 - 1)) - 2**63


@dataclass
class Candidates:
    """Documents as rows (doc_id, doc, th, text), and an estimate of their recurring cells."""

    src: DataFrame
    cells: DataFrame
    total: int


def candidates(docs: DataFrame, spec: Spec, sender: Callable) -> Candidates:
    """The cells of windows that can recur, sorted by key within partitions by key.

    ``sender()`` gives each task a function from its cells (rows of CELL) to the rows of CELL that it sends.
    """
    spark = docs.sparkSession
    work.ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    anchors = src.select("text").mapInArrow(_anchors(spec), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = work.stage(anchors, small=True)
    total = anchors.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT, -(-total // MAX_HOT))  # so at most MAX_HOT anchors can be above it
    hot = anchors.where(F.col("n") > limit).select("key").toArrow().column(0).to_numpy()
    if len(hot):
        names = work.share(spark, np.sort(hot.astype(np.int64).view(seq.U)))
        runs = src.select("text").mapInArrow(_around(spec, names), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        runs = runs.where(F.col("n") > limit).orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key")
        hot = np.union1d(hot, runs.toArrow().column(0).to_numpy())
    bitmap = work.share(spark, work.bloom(anchors, "key"))
    names = work.share(spark, np.sort(hot.astype(np.int64).view(seq.U)))
    found = src.select("doc", "th", "text").mapInArrow(_cells(spec, bitmap, names, sender), CELL_DDL)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CELLS))
    return Candidates(src, found.repartition(parts, "key").sortWithinPartitions("key"), total)


def without(src: DataFrame, bitmap, result: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """The results of documents whose ``th`` is not in the bitmap, as they are."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(~work.in_bloom(bitmap.value, b.column(1).to_numpy().view(seq.U))))
            rows = [result(t or b"", []) for t in work.texts(b.column(2))]
            yield work.batch(schema, b.column(0), *([list(c) for c in zip(*rows)] or [[] for _ in list(schema)[1:]]))

    return src.select("doc_id", "th", "text").mapInArrow(run, ddl)


def held(batches, bitmap):
    """Of batches (doc_id, doc, th, text) the documents whose ``th`` is in the bitmap."""
    for b in batches:
        yield b.filter(pa.array(work.in_bloom(bitmap.value, b.column(2).to_numpy().view(seq.U))))


def within(src: DataFrame, bitmap) -> DataFrame:
    """The documents whose ``th`` is in the bitmap."""
    return src.select("doc_id", "doc", "th", "text").mapInArrow(lambda batches: held(batches, bitmap), "doc_id long, doc long, th long, text string")


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint, sorted stretches that cover what the stretches from ``a`` to before ``b`` cover."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return list(zip(a[first].tolist(), b[np.concatenate((first[1:] - 1, [len(b) - 1]))].tolist()))
