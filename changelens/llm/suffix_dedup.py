"""Suffix-array deduplication by longest-previous-factor arrays: later copies go, the first stays.

Windows of 100 bytes that can recur meet by anchor (``repeats``), as the contents of cells.  A chunk's contents are a
shard; the suffixes that start a window are put in suffix order by 8-byte words, refining only runs that still tie,
which also gives the common prefix of neighbours (to 100 bytes; no more is asked).  In suffix order each suffix looks
for the nearest one on either side that stands earlier in the corpus, its previous and next smaller position; the
longer of the two common prefixes is its longest previous factor.  Where that reaches 100, the window is a later copy
and its bytes are removed.

A task sends one cell of each content it remembers, the earliest; others like it are later copies throughout, and only
their stretch is sent.  Only documents that lose bytes are shuffled, once, to meet their stretches.

Defined results.  Null text: as the empty text.  Null doc_id: the document comes after all others.  Rows of one
doc_id and one text are one document and get one result each; rows of one doc_id and different texts are ordered by a
hash of the text.  Texts shorter than a window: nothing removed.  Cuts fall where bytes do, so what is left of a text
may split a character.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, work

WINDOW = 100
SPEC = repeats.Spec(words=False, window=WINDOW, run=32)
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPAN = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
SPAN_DDL = "doc long, th long, s long, e long"


def suffix_order(buf: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``at`` of ``buf`` in the order of their first ``depth`` bytes, ties by place in ``at``.

    Returns the order and, for each place in it, the common prefix with the suffix before, ``depth`` at most.
    """
    order, n = np.arange(len(at)), len(at)
    run, lcp = np.zeros(n, np.int64), np.full(n, depth, np.int16)
    act = np.arange(n)  # places whose runs have more than one suffix
    step = np.arange(8)
    for k in range(0, depth, 8):
        if not len(act):
            break
        width = min(8, depth - k)
        raw = np.zeros((len(act), 8), np.uint8)
        raw[:, :width] = buf[at[order[act]][:, None] + k + step[:width]]
        word = raw.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((order[act], word, run[act]))
        order[act], word = order[act][by], word[by]
        same = run[act][1:] == run[act][:-1]
        apart = word[1:] ^ word[:-1]
        split = np.flatnonzero(same & (apart != 0)) + 1
        bytes_ = np.ascontiguousarray(apart[split - 1].astype(">u8")).view(np.uint8).reshape(-1, 8)
        lcp[act[split]] = k + (bytes_ != 0).argmax(1)
        new = np.ones(len(act), bool)
        new[1:] = ~same | (apart != 0)
        run[act] = act[np.flatnonzero(new)][np.cumsum(new) - 1]  # a run is named by its first place
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(act)])))
        act = act[np.repeat(size > 1, size)]
    if n:
        lcp[0] = 0
    return order, lcp


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, numbered by position, the longest prefix that it shares with one at a smaller position.

    Per side, every place points at its neighbour, and on from places of larger positions to where those point, until
    it points at its previous (next) smaller position; the common prefix is the least on the way.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    position = np.concatenate((order, [-1]))  # past either end: before all positions
    for side in (-1, 1):
        link = np.arange(n) + side
        reach = (lcp if side < 0 else np.concatenate((lcp[1:], [0])))[:n].astype(np.int64)
        link[(link < 0) | (reach == 0)] = n
        act = np.flatnonzero(position[link] > order)
        while len(act):
            j = link[act]
            link_on, reach_on = link[j], np.minimum(reach[act], reach[j])
            link[act], reach[act] = np.where(reach_on == 0, n, link_on), reach_on
            act = act[position[link[act]] > order[act]]
        out[order] = np.maximum(out[order], np.where(link < n, reach, 0))
    return out


def sender():
    """What a task sends: the earliest cell of each content, and the stretches of later ones, joined."""
    known: dict[tuple[int, bytes], tuple[int, int, int]] = {}

    def send(rows):
        out, late = [], []
        for row in rows:
            key, doc, th, start, n, content = row
            at, name = (doc, th, start), (key, content)
            old = known.get(name)
            if old is None or at < old:
                known[name] = at
                out.append(row)
            elif at != old:
                end = start + n - 1 + WINDOW
                if late and late[-1][0] == doc and late[-1][1] == th and late[-1][2] <= start <= late[-1][3]:
                    late[-1][3] = max(late[-1][3], end)
                else:
                    late.append([doc, th, start, end])
        if len(known) > repeats.MEMORY:
            known.clear()
        return out + [(repeats.spread(doc, th, s), doc, th, s, e, None) for doc, th, s, e in late]

    return send


def _factors(batches):
    """Stretches of windows whose longest previous factor is a whole window."""
    for (key, doc, th, start, n, content), _ in work.chunks(batches, repeats.CELL.names, repeats.CHUNK, whole=True):
        late = np.array([c is None for c in content], bool)
        yield work.batch(SPAN, doc[late], th[late], start[late], n[late])
        key, doc, th, start, n, content = (c[~late] for c in (key, doc, th, start, n, content))
        order = np.lexsort((start, th, doc, key))
        key, doc, th, start, n, content = (c[order] for c in (key, doc, th, start, n, content))
        first: dict[tuple, int] = {}
        own = np.array([first.setdefault(c, i) for i, c in enumerate(zip(key.tolist(), content.tolist()))], np.int64)
        copy = own != np.arange(len(own))
        again = copy & ((doc != doc[own]) | (th != th[own]) | (start != start[own]))  # else the same place once more
        yield work.batch(SPAN, doc[again], th[again], start[again], (start + n - 1 + WINDOW)[again])
        key, doc, th, start, n, content = (c[~copy] for c in (key, doc, th, start, n, content))
        if not len(key):
            continue
        family = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        several = (np.bincount(family) > 1)[family]
        doc, th, start, n, content = (c[several] for c in (doc, th, start, n, content))
        if not len(doc):
            continue
        size = np.array([len(c) for c in content.tolist()])
        buf = np.frombuffer(b"".join(content.tolist()), np.uint8)
        cell = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(size) - size)[cell] + off
        place = np.lexsort((start[cell] + off, th[cell], doc[cell]))  # windows in the order of the corpus
        hit = np.zeros(len(cell), bool)
        hit[place] = longest_previous_factor(*suffix_order(buf, at[place], WINDOW)) >= WINDOW
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.where(hit, cell + 1, 0), [0]))))
        a, b = edge[:-1], edge[1:]
        a, b = a[hit[a]], b[hit[a]]  # runs of flagged windows of one cell
        c = cell[a]
        yield work.batch(SPAN, doc[c], th[c], start[c] + off[a], start[c] + off[b - 1] + WINDOW)


def result(text: bytes, stretches: list[tuple[int, int]]) -> tuple:
    kept, at = [], 0
    for a, b in stretches:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return len(text), sum(b - a for a, b in stretches), len(stretches), hashlib.sha256(b"".join(kept)).hexdigest()


def _applied(docs: DataFrame, result, schema: pa.Schema, ddl: str) -> DataFrame:
    """Per document, ``result(text, stretches to remove)`` as the columns after doc_id."""
    found = repeats.candidates(docs, SPEC, sender)
    spans = work.stage(found.cells.mapInArrow(_factors, SPAN_DDL))
    bitmap = work.share(docs.sparkSession, work.bloom(spans.select("th").distinct(), "th"))
    lost = spans.groupBy("doc", "th").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def run(batches):
        for b in batches:
            cut = [repeats.merged(np.array(s, np.int64), np.array(e, np.int64)) if s else [] for s, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            rows = [result(t or b"", c) for t, c in zip(work.texts(b.column(1)), cut)]
            yield work.batch(schema, b.column(0), *([list(c) for c in zip(*rows)] or [[] for _ in list(schema)[1:]]))

    both = repeats.within(found.src, bitmap).join(lost, ["doc", "th"], "left").select("doc_id", "text", "s", "e")
    return both.mapInArrow(run, ddl).unionByName(repeats.without(found.src, bitmap, result, schema, ddl))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _applied(docs, result, OUT, DDL)


def kept_bytes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the bytes that stay."""

    def keep(text, stretches):
        ends = [0, *[b for _, b in stretches]]
        return (b"".join(text[e:a] for e, a in zip(ends, [*[a for a, _ in stretches], len(text)])),)

    return _applied(docs, keep, pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())]), "doc_id long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(work.read(spark, sf_dir, "documents"))
