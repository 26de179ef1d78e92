"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word trigrams of the test items are looked up in every whole document.  No seed is left out for being common: a
passage that stands in very many documents makes its own trigrams common.  Places where at least MIN_SEEDS different
seeds of one item lie within an item's length become candidate passages.  In a passage with a margin, only stretches
that can hold an alignment of a sufficient score are looked at (``promising``, an upper bound, so nothing that matches
is lost); they are aligned with the item by Smith-Waterman over words (match 2, mismatch -1, gap -1), so substituted,
inserted and lost words cost a little each.  The score is the alignment's share of a perfect one.

The test items are a stated query set: they are broadcast in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES
bytes, one pass over the documents for each block, so what is broadcast does not grow with either table.

Defined results.  Null or empty text of a document or an item: no match.  Items of fewer than three words: the whole
item is its seed.  Null ids: carried as they are.  Repeated rows: matched each by themselves; equal
rows of the result are returned once.  ``remove`` goes by text, so neither null nor repeated ids matter to it.  Empty tables: no match.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seq, work

SEED_WORDS, MIN_SEEDS = 3, 2
#: Alignment scores, and the share of a perfect score from which a document is contaminated.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.6
MARGIN = 8
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 16 << 20
#: Places of seeds held at once; a run of texts with more is halved, down to one text.
HELD = 1 << 21
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("sha", pa.string())])
HITS_DDL = "doc_id long, item_id long, score double, start_word long, end_word long, sha string"


class Items:
    """Word hashes of a block of test items, and their seeds sorted by hash."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.words = ids, []
        seeds, item = [], []
        for i, t in enumerate(texts):
            h = normalised([t]).hash
            self.words.append(h)
            g = np.unique(seq.gram_hashes(h, min(SEED_WORDS, len(h)))) if len(h) else h
            seeds.append(g)
            item.append(np.full(len(g), i))
        seeds, item = (np.concatenate(x) if x else np.zeros(0, int) for x in (seeds, item))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item = seeds[order].astype(seq.U), item[order].astype(np.int64)


#: bytes.translate table: lower case of A-Z, and ASCII punctuation as white space.
PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def normalised(values: list[bytes | None]) -> seq.Words:
    return seq.Words([v.translate(PLAIN) if v else v for v in values])


def _grams(w: seq.Words, sizes: list[int]):
    """Per size: (hashes, word index) of the grams that lie within one text."""
    own = np.searchsorted(w.last, np.arange(len(w.hash)), side="right")
    for n in sizes:
        g = seq.gram_hashes(w.hash, n)
        at = np.flatnonzero(own[: len(g)] == own[n - 1 : n - 1 + len(g)])
        yield g[at], at


def _sizes(items: Items) -> list[int]:
    return sorted({min(SEED_WORDS, len(w)) for w in items.words if len(w)})


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-hash sequences: score, and first and past-last word of ``b``.

    Anti-diagonals are computed as vectors; the start of the best alignment is carried along with its score.
    """
    n, m = len(a), len(b)
    p2 = p1 = np.zeros(n + 1, np.int64)
    s2 = s1 = np.zeros(n + 1, np.int64)
    best = (0, 0, 0)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        same = a[i - 1] == b[j - 1]
        diag = p2[i - 1] + np.where(same, MATCH, MISMATCH)
        start = np.where(p2[i - 1] > 0, s2[i - 1], j - 1)
        up, left = p1[i - 1] + GAP, p1[i] + GAP
        score, first = diag, start
        score, first = np.where(up > score, up, score), np.where(up > score, s1[i - 1], first)
        score, first = np.where(left > score, left, score), np.where(left > score, s1[i], first)
        score = np.maximum(score, 0)
        p, s = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        p[i], s[i] = score, first
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(first[k]), int(j[k]))
        p2, p1, s2, s1 = p1, p, s1, s
    return best


def passages(at: np.ndarray, seed: np.ndarray, length: int, need: int) -> list[tuple[int, int]]:
    """Stretches of sorted seed positions in which ``need`` different seeds lie within ``length`` words.

    Stretches that overlap are joined, so every position is looked at once.
    """
    out: list[list[int]] = []
    for k in range(len(at)):
        end = int(np.searchsorted(at, at[k] + length))
        if need > 1 and len(set(seed[k : min(end, k + 4 * need)].tolist())) < need and len(set(seed[k:end].tolist())) < need:
            continue
        lo, hi = int(at[k]), int(at[end - 1])
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def promising(w: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches of a passage outside which no alignment with an item of ``n`` words reaches THRESHOLD.

    ``w`` holds MATCH for words of the item and the lesser penalty for others.  An alignment scores no more than the
    sum of ``w`` over the words it spans; with at most n matches, one that reaches THRESHOLD spans no more words than
    those matches and the penalties that they can pay for.
    """
    least = THRESHOLD * MATCH * n
    cost = -max(MISMATCH, GAP)
    span = min(len(w), n + int((MATCH * n - least) / cost) + 1)
    total = np.concatenate(([0], np.cumsum(w)))
    best = seq.sliding(np.concatenate((total, np.full(span, total[-1]))), span + 1, np.maximum)
    out: list[list[int]] = []
    for i in np.flatnonzero(best - total >= least - 1e-9).tolist():
        if out and i <= out[-1][1]:
            out[-1][1] = min(i + span, len(w))
        else:
            out.append([i, min(i + span, len(w))])
    return [(a, b) for a, b in out]


def _found(items: Items, values: list[bytes | None], at: int = 0):
    """(row of the first text, words, places) of runs of texts; places are (word, item, seed) by text, item and word."""
    w = normalised(values)
    grams = [(g, k, np.searchsorted(items.seeds, g)) for g, k in _grams(w, _sizes(items))]
    grams = [(k, first, np.searchsorted(items.seeds, g, side="right") - first) for g, k, first in grams]
    if len(values) > 1 and sum(n.sum() for _, _, n in grams) > HELD:
        half = len(values) // 2
        yield from _found(items, values[:half], at)
        yield from _found(items, values[half:], at + half)
        return
    found = [np.zeros((3, 0), np.int64)]
    for word, first, n in grams:
        k = np.flatnonzero(n)
        each = np.repeat(first[k] - np.concatenate(([0], np.cumsum(n[k])[:-1])), n[k]) + np.arange(n[k].sum())
        found.append(np.stack([np.repeat(word[k], n[k]), items.item[each], each]))
    f = np.concatenate(found, axis=1)
    order = np.lexsort((f[0], f[1], np.searchsorted(w.last, f[0], side="right")))
    yield at, w, f[:, order]


def _hits(shared):
    def run(batches):
        items = shared.value
        many = np.bincount(items.item, minlength=len(items.ids))
        for b in batches:
            ids, values, rows = b.column(0).to_pylist(), work.texts(b.column(1)), []
            for lo, hi in work.segments(values):
                for at, w, f in _found(items, values[lo:hi], lo):
                    text = np.searchsorted(w.last, f[0], side="right")
                    cut = np.flatnonzero(np.diff(text) | np.diff(f[1])) + 1
                    for s, e in zip([0, *cut], [*cut, len(text)]):
                        if e == s:
                            continue
                        i, d = int(f[1, s]), int(text[s])
                        a, need = items.words[i], min(MIN_SEEDS, int(many[i]))
                        best = (0, 0, 0)
                        for p, q in passages(f[0, s:e], f[2, s:e], len(a), need) if e - s >= need else ():
                            x, y = max(int(w.first[d]), p - len(a) - MARGIN), min(int(w.last[d]), q + len(a) + MARGIN)
                            own = np.where(np.isin(w.hash[x:y], a), MATCH, max(MISMATCH, GAP))
                            for u, v in promising(own, len(a)):
                                score, start, end = align(a, w.hash[x + u : x + v])
                                if score > best[0]:
                                    best = (score, start + x + u - int(w.first[d]), end + x + u - int(w.first[d]))
                        if (share := best[0] / (MATCH * len(a))) >= THRESHOLD:
                            rows.append((ids[at + d], items.ids[i], share, best[1], best[2], hashlib.sha256(values[at + d]).hexdigest()))
            yield work.batch(HITS, *([list(c) for c in zip(*rows)] or [[]] * 6))

    return run


def blocks(items: DataFrame):
    """The test items in blocks of bounded size, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text")
    for row in own.toLocalIterator():
        t = row[1].encode()
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(t) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(t)
        size += len(t)
    if ids:
        yield ids, texts


def _matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of HITS, a row for each matching pair of rows."""
    spark = docs.sparkSession
    work.ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = None
    for ids, texts in blocks(items):
        block = Items(ids, texts)
        if not len(block.seeds):
            continue
        part = src.mapInArrow(_hits(work.share(spark, block)), HITS_DDL)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], HITS_DDL) if out is None else out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per matching pair: doc_id, item_id, score, and the words of the document that match."""
    return _matches(docs, items).drop("sha").dropDuplicates()


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text matches no item."""
    gone = work.stage(_matches(docs, items).select("sha").distinct())
    sha = F.sha2(F.col("row.text").cast("string"), 256)
    return work.packed(docs, 0).withColumn("sha", sha).join(gone, "sha", "left_anti").select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(work.read(spark, sf_dir, "documents"), work.read(spark, sf_dir, "benchmark"))
