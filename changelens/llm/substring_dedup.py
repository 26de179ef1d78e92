"""Substring deduplication by repeated-phrase automata.

1. Confirm.  Windows of 35 words that can recur meet by anchor (``repeats``), as the contents of cells.  Windows of
   equal hash are compared word by word; those that start at two places are confirmed, and neighbouring ones of a
   content make a phrase.  No place of an occurrence goes on from here: a phrase goes to the shards of documents that
   hold its content, by a hash of the document.
2. Locate.  Each shard's documents and phrases meet.  Phrases are compiled, at most LETTERS words at a time, into an
   Aho-Corasick automaton over words, and every document of the shard is streamed through it whole; the words
   that its hits cover are removed.  Phrases of hot anchors occur in most shards: they are broadcast in blocks of at
   most HOT_BYTES while they have at most HOT_LIMIT bytes in all.  Beyond that a further pass over the documents finds,
   by the hash of a phrase's first window, the shards that hold it, and it goes to those.

Documents that hold no confirmed window are not shuffled.

Defined results.  Null text: no words.  Null doc_id: an ordinary document.  Rows of one doc_id and one text are one
document and get one result each.  Texts of fewer than 35 words: nothing removed.  Empty table: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, seq, work

WINDOW = 35
SPEC = repeats.Spec(words=True, window=WINDOW, run=8)
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Words of one automaton; recurring cells of a shard's documents, about; bytes of a block and of all broadcast phrases.
LETTERS, SHARD_CELLS = 400_000, 5_000
HOT_BYTES, HOT_LIMIT = 4 << 20, 32 << 20
#: What the confirming step gives: a phrase for a shard, a phrase of a hot anchor, a document that holds a phrase.
PHRASE, COMMON, HOLDER = 0, 1, 2
FOUND = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("th", pa.int64()), ("phrase", pa.binary())])
FOUND_DDL = "kind int, shard long, th long, phrase binary"
ROW = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("body", pa.binary())])
ROW_DDL = "shard long, kind int, doc_id long, body binary"


def named(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def sender():
    """What a task sends: each content from two places, which proves that it recurs; from then on only its name.

    A name is sent to its anchor, which brings the phrase to that document's shard.  A hot anchor's phrases are
    everywhere, so a document that has only those is sent by itself, to no group.
    """
    known: dict[tuple[int, bytes], tuple | None] = {}

    def send(rows):
        out, told = [], set()
        for row in rows:
            key, doc, th, start, n, content = row
            name, at = (key, content), (doc, th, start)
            old = known.get(name, at)
            if old is None:
                if key >= 0:
                    out.append((key, doc, th, named(content), 0, None))
                elif th not in told:
                    told.add(th)
                    out.append((repeats.spread(doc, th, 1), doc, th, 0, -1, None))
                continue
            if old is not at and old != at:
                known[name] = None
            else:
                known[name] = at
                if old is not at:
                    continue  # the same place once more
            out.append(row)
        if len(known) > repeats.MEMORY:
            known.clear()
        return out

    return send


def phrases(key: np.ndarray, content: list[bytes], times: np.ndarray) -> list[list[bytes]]:
    """Per content of an anchor, sorted by anchor, the longest stretches of windows that start at two places.

    ``times``: at how many places each content is known to stand.  Windows are compared by their words, where their
    hashes agree.
    """
    out: list[list[bytes]] = [[c] if t > 1 else [] for c, t in zip(content, times.tolist())]
    family = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    open_ = np.bincount(family, weights=times == 1)[family] > 0
    look = np.flatnonzero(open_ & (np.bincount(family) > 1)[family])
    if not len(look):
        return out
    w = seq.Words([content[i] for i in look])
    g = seq.gram_hashes(w.hash, WINDOW)
    n = w.last - w.first - WINDOW + 1
    cell = np.repeat(np.arange(len(look)), n)
    at = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + w.first[cell]
    fam, h = family[look][cell], g[at]
    order = np.lexsort((h, fam))
    new = np.concatenate(([True], (fam[order][1:] != fam[order][:-1]) | (h[order][1:] != h[order][:-1])))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    hit = np.zeros(len(cell), bool)
    hit[times[look][cell] > 1] = True
    text, a, b = w.buf.tobytes(), w.ws[at].tolist(), w.we[at + WINDOW - 1].tolist()
    cut = np.concatenate((np.flatnonzero(new), [len(order)]))
    for k in np.flatnonzero(size > 1).tolist():
        own = order[cut[k] : cut[k + 1]].tolist()
        same: dict[bytes, list[int]] = {}
        for i in own:
            same.setdefault(text[a[i] : b[i]], []).append(i)
        for places in same.values():
            if len(places) > 1:
                hit[places] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.where(hit, cell + 1, 0), [0]))))
    x, y = edge[:-1], edge[1:]
    x, y = x[hit[x]], y[hit[x]]  # runs of confirmed windows of one content
    for p, q in zip(x.tolist(), y.tolist()):
        i = int(look[cell[p]])
        if times[i] == 1:
            out[i].append(text[a[p] : b[q - 1]])
    return out


def shard_of(doc: np.ndarray, th: np.ndarray, shards: int) -> np.ndarray:
    return (seq.mix(doc.view(seq.U) * seq.STEP[50] + th.view(seq.U)) % seq.U(shards)).astype(np.int64)


def _confirm(shards: int):
    def run(batches):
        for (key, doc, th, start, n, content), _ in work.chunks(batches, repeats.CELL.names, repeats.CHUNK, whole=True):
            alone = n < 0
            if alone.any():
                yield work.batch(FOUND, np.full(int(alone.sum()), HOLDER, np.int32), np.full(int(alone.sum()), -1), th[alone], pa.nulls(int(alone.sum()), pa.binary()))
            names: dict[tuple[int, bytes], int] = {}
            full = np.array([c is not None for c in content], bool)
            own, places = np.full(len(key), -1), []
            for i in np.flatnonzero(full).tolist():
                k = own[i] = names.setdefault((int(key[i]), content[i]), len(names))
                at = (doc[i], th[i], start[i])
                if k == len(places):
                    places.append(at)
                elif places[k] is not None and places[k] != at:
                    places[k] = None  # at two places
            if not names:
                continue
            group, texts = np.array([k for k, _ in names], np.int64), [c for _, c in names]
            found = phrases(group, texts, np.array([2 if p is None else 1 for p in places]))
            called: dict[tuple[int, int], list[int]] = {}
            held = np.flatnonzero(~full & ~alone)
            if len(held):
                for k, (g, c) in enumerate(names):
                    called.setdefault((g, named(c)), []).append(k)
            shard, rows, common, holders = shard_of(doc, th, shards), set(), set(), set()
            for i in np.flatnonzero(full).tolist() + held.tolist():
                for k in [int(own[i])] if full[i] else called.get((int(key[i]), int(start[i])), []):
                    if found[k]:
                        holders.add(int(th[i]))
                        if key[i] < 0:
                            common.update(found[k])
                        else:
                            rows.update((int(shard[i]), p) for p in found[k])
            none = pa.nulls(len(holders), pa.binary())
            yield work.batch(FOUND, np.full(len(holders), HOLDER, np.int32), np.full(len(holders), -1), list(holders), none)
            for kind, some in ((PHRASE, rows), (COMMON, [(-1, p) for p in common])):
                some = sorted(some)
                yield work.batch(FOUND, np.full(len(some), kind, np.int32), [s for s, _ in some], np.zeros(len(some), np.int64), [p for _, p in some])

    return run


class Automaton:
    """An Aho-Corasick automaton of phrases.  A word of theirs is two letters, any other word is one that none has.

    First and second letters are of two alphabets, so hits start and end at words; both are small, as the library
    looks through a state's letters one by one.
    """

    def __init__(self, some: list[list[bytes]]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for words in some:
            for w in words:
                if w not in self.letters:  # LETTERS of them give less than 2,000 first letters
                    k = len(self.letters)
                    self.letters[w] = chr(0x1000 + k // 256) + chr(0x100 + k % 256)
            self.automaton.add_word("".join([self.letters[w] for w in words]), len(words))
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]):
        """(start, end) of each occurrence of a phrase, in words."""
        get = self.letters.get
        for end, size in self.automaton.iter("".join([get(w, "\x01\x01") for w in words])):
            yield (end + 1) // 2 - size, (end + 1) // 2


def automata(some):
    """Automata of at most LETTERS words each (one phrase at least) that together have all phrases."""
    part, size = [], 0
    for p in some:
        words = p.split()
        if part and size + len(words) > LETTERS:
            yield Automaton(part)
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield Automaton(part)


class Streams:
    """A shard's documents, and which of their words hits have covered."""

    def __init__(self):
        self.ids, self.words, self.covered = [], [], []

    def add(self, doc_id, text: bytes):
        self.ids.append(doc_id)
        self.words.append(text.split())
        self.covered.append([])

    def through(self, a: Automaton):
        for words, covered in zip(self.words, self.covered):
            for s, e in a.hits(words):  # ends rise
                while covered and s <= covered[-1][1] and covered[-1][0] <= e:
                    x, y = covered.pop()
                    s, e = min(s, x), max(e, y)
                covered.append((s, e))

    def results(self, result):
        for doc_id, words, covered in zip(self.ids, self.words, self.covered):
            a = np.array(covered, np.int64).reshape(-1, 2)
            yield doc_id, *result(words, repeats.merged(a[:, 0], a[:, 1]))


def _locate(blocks, result, schema: pa.Schema):
    """Rows of a shard: its documents (kind 0), then its phrases (kind 1)."""

    def run(batches):
        common = [a for b in blocks for a in automata(b.value)] if blocks else []
        shard, streams, part, size = None, Streams(), [], 0

        def close():
            nonlocal part, size
            for a in automata(part):
                streams.through(a)
            part, size = [], 0

        def end():
            close()
            for a in common:
                streams.through(a)
            rows = list(streams.results(result))
            if rows:
                return work.batch(schema, *([list(c) for c in zip(*rows)]))

        for b in batches:
            for s, kind, doc_id, body in zip(*(b.column(i).to_pylist() for i in range(4))):
                if s != shard:
                    if (out := end()) is not None:
                        yield out
                    shard, streams = s, Streams()
                if kind == 0:
                    streams.add(doc_id, body or b"")
                else:
                    part.append(body)
                    size += len(body)
                    if size > 8 * LETTERS:
                        close()
        if (out := end()) is not None:
            yield out

    return run


def _common(rows: DataFrame):
    """Phrases in blocks of at most HOT_BYTES (one phrase at least), streamed to the driver; the caller checks their size."""
    part, size = [], 0
    for r in rows.toLocalIterator():
        if part and size + len(r[0]) > HOT_BYTES:
            yield part
            part, size = [], 0
        part.append(bytes(r[0]))
        size += len(r[0])
    if part:
        yield part


FIRST = pa.schema([("h", pa.int64()), ("phrase", pa.binary())])
PLACE = pa.schema([("h", pa.int64()), ("shard", pa.int64())])


def _windows(values: list[bytes | None]):
    """The hash of each window of some texts, and the number of its text."""
    w = seq.Words(values)
    n = np.maximum(w.last - w.first - WINDOW + 1, 0)
    cell = np.repeat(np.arange(len(values)), n)
    at = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + w.first[cell]
    return seq.gram_hashes(w.hash, WINDOW)[at] if len(at) else np.zeros(0, seq.U), cell


def _firsts(batches):
    """Phrases by the hash of their first window."""
    for b in batches:
        texts = work.texts(b.column(0))
        h, cell = _windows(texts)
        first = np.searchsorted(cell, np.arange(len(texts)))
        yield work.batch(FIRST, h[first].view(np.int64), texts)


def _to_holders(common: DataFrame, src: DataFrame, bitmap, shards: int) -> DataFrame:
    """(shard, phrase): hot phrases, each for the shards with a document that holds its first window, once a task."""
    spark = src.sparkSession
    firsts = work.stage(common.mapInArrow(_firsts, "h long, phrase binary"))
    known = work.share(spark, work.bloom(firsts.select("h").distinct(), "h"))

    def places(batches):
        sent: set[tuple[int, int]] = set()
        for b in repeats.held(batches, bitmap):
            shard, texts = shard_of(b.column(1).to_numpy(), b.column(2).to_numpy(), shards), work.texts(b.column(3))
            for lo, hi in work.segments(texts):
                h, cell = _windows(texts[lo:hi])
                some = np.flatnonzero(work.in_bloom(known.value, h))
                new = set(zip(h[some].view(np.int64).tolist(), shard[lo + cell[some]].tolist())) - sent
                sent |= new
                if new:
                    yield work.batch(PLACE, [x for x, _ in new], [y for _, y in new])
            if len(sent) > repeats.MEMORY:
                sent.clear()

    at = src.select("doc_id", "doc", "th", "text").mapInArrow(places, "h long, shard long").distinct()
    return at.join(firsts, "h").select("shard", "phrase")


def _applied(docs: DataFrame, result, schema: pa.Schema, ddl: str) -> DataFrame:
    """Per document, ``result(words, stretches to remove)`` as the columns after doc_id."""
    spark = docs.sparkSession
    found = repeats.candidates(docs, SPEC, sender)
    shards = max(1, -(-found.total // SHARD_CELLS))
    told = work.stage(found.cells.mapInArrow(_confirm(shards), FOUND_DDL))
    bitmap = work.share(spark, work.bloom(told.where(F.col("kind") == HOLDER).select("th").distinct(), "th"))
    common = work.stage(told.where(F.col("kind") == COMMON).select("phrase").distinct())
    own = told.where(F.col("kind") == PHRASE).select("shard", "phrase").distinct()
    blocks = []
    if (common.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) <= HOT_LIMIT:
        blocks = [work.share(spark, b) for b in _common(common)]
    else:
        own = own.union(_to_holders(common, found.src, bitmap, shards))

    def dealt(batches):
        for b in repeats.held(batches, bitmap):
            shard = shard_of(b.column(1).to_numpy(), b.column(2).to_numpy(), shards)
            yield work.batch(ROW, shard, np.zeros(b.num_rows, np.int32), b.column(0), b.column(3).cast(pa.binary()))

    rows = found.src.select("doc_id", "doc", "th", "text").mapInArrow(dealt, ROW_DDL)
    rows = rows.union(own.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("phrase").alias("body")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 32)
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    alone = repeats.without(found.src, bitmap, lambda text, _: result(text.split(), []), schema, ddl)
    return rows.mapInArrow(_locate(blocks, result, schema), ddl).unionByName(alone)


def result(words: list[bytes], stretches: list[tuple[int, int]]) -> tuple:
    kept, at = [], 0
    for a, b in stretches:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    return _applied(docs, result, OUT, DDL)


def kept_words(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the kept words, joined by one space."""

    def keep(words, stretches):
        ends = [0, *[b for _, b in stretches]]
        return (b" ".join(w for e, a in zip(ends, [*[a for a, _ in stretches], len(words)]) for w in words[e:a]).decode(),)

    return _applied(docs, keep, pa.schema([("doc_id", pa.int64()), ("kept", pa.string())]), "doc_id long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(work.read(spark, sf_dir, "documents"))
