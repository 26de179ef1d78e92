"""N-gram Jaccard join: a blocked sparse product of documents by shingles.

A document's set holds the hashes of its distinct 5-word shingles.  Documents with equal sets are one node.

1. Statistics: each node's size, digest and parity bitmap, and how often each of BINS hashed shingle bins occurs.
2. Incidence: each node emits its rarest n - ceil(0.8 n) + 1 shingles; two sets that are similar enough share one.
3. Product: the incidence rows of one shingle give pairs, discarded where sizes or positions rule 0.8 out.  Up to
   SMALL nodes give all their pairs, more give each node's pair with the first only: no more rows than nodes.
4. Bitmaps: the bits in which two parity bitmaps differ bound the sets' difference from below, exactly.  What is left
   joins nodes to clusters.  Shingles of more than SMALL nodes that are not all in one cluster are gone through once
   more, in blocks of bounded size, for pairs between clusters; so no pair is missed.
5. Links: a cluster is cut into blocks of bounded size, and CENTERS of its nodes go to every block.  A task accumulates
   overlap counts over the whole sets of its block from the incidence lists and keeps links of 0.8 and more.
6. Between blocks: where a cluster of several blocks is not one component by then, its nodes are dealt anew, by
   component where that is large and by size.  Pairs of blocks are multiplied, but for those of one component and
   those whose sizes rule 0.8 out.

Links inside what is already one component are not looked for, as only the components are asked for; every other
pair is.  No step holds more than a block, a chunk or a bounded bitmap in memory.

Defined results.  Null, empty or wordless text: an empty set, linked with nothing.  Null doc_id: takes part, sorts
above every other as a representative, so component_id is null only where all ids are.  Repeated rows: one row out
for each.  Empty table: no rows.  Other columns, whatever their names: ignored by ``classes``, carried by
``deduplicate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seq, work
from .components import components

WIDTH = 5
#: Hashed shingle bins counted over the corpus; rows of the table of counts that a task writes.
BINS, CHUNK = 1 << 19, 1 << 12
#: Incidence rows of up to SMALL nodes give all pairs; those of more give each node's with the first.
SMALL = 4
#: Nodes of a block, and its shingles; nodes that go to every block of a cluster; incidence rows of a shuffle partition.
BLOCK, GRAMS, CENTERS, ROWS = 1024, 1 << 20, 4, 1_000_000
#: Rows of a shingle, and bytes of their bitmaps, that are looked at together for pairs between clusters.
ACROSS, ACROSS_BYTES = 1024, 1 << 22
#: Stands for a null doc_id.
NO_ID = -(1 << 63)

STATS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("node", pa.int64()), ("bitmap", pa.binary()), ("bin", pa.int32()), ("counts", pa.binary()), ("sha", pa.binary())])
STATS_DDL = "doc_id long, n long, digest binary, node long, bitmap binary, bin int, counts binary, sha binary"
ENTRY = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
ENTRY_DDL = "key long, node long, n int, pos int"
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
PAIR_DDL = "a long, b long, key long, n int, pos int"
SETS = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("grams", pa.binary())])


def needed(a, b):
    """Least overlap of sets of sizes a and b with 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


def shingles(values: list[bytes | None]):
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in work.segments(values):
        w = seq.Words(values[lo:hi], lower=True)
        g = seq.gram_hashes(w.hash, WIDTH)
        for a, b in zip(w.first.tolist(), w.last.tolist()):
            if b - a >= WIDTH:
                yield np.unique(g[a : b - WIDTH + 1])
            else:
                yield seq.gram_hashes(w.hash[a:b], b - a) if b > a else g[:0]


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of at least 2n bins, a power of two."""
    bits = 1 << max(8, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & seq.U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _stats_of(named: bool):
    """Per row the figures of its text, and its SHA-256 if ``named``; then the counts of bins."""

    def run(batches):
        total = np.zeros(BINS, np.int32)
        for b in batches:
            rows, values = [], work.texts(b.column(1))
            for s in shingles(values):
                if len(s):
                    d = digest(s)
                    rows.append((len(s), d, node_of(d), bitmap(s)))
                    np.add.at(total, (s & seq.U(BINS - 1)).astype(np.int64), 1)
                else:
                    rows.append((0, None, None, None))
            none = pa.nulls(b.num_rows)
            sha = [hashlib.sha256(v or b"").digest() for v in values] if named else none.cast(pa.binary())
            yield work.batch(STATS, b.column(0), *([list(c) for c in zip(*rows)] or [[]] * 4), none.cast(pa.int32()), none.cast(pa.binary()), sha)
        parts = [total[k : k + CHUNK] for k in range(0, BINS, CHUNK)]
        used = [k for k, p in enumerate(parts) if p.any()]
        none = pa.nulls(len(used))
        cells = [none.cast(f.type) for f in list(STATS)[:5]]
        yield work.batch(STATS, *cells, np.array(used, np.int32), pa.array([parts[k].tobytes() for k in used], pa.binary()), none.cast(pa.binary()))

    return run


def _add(batches):
    """Sums of the bins' counts; a partition has a few bins' rows, one from each task that counted."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(c, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["bin", "counts"])


def _entries(shared):
    def run(batches):
        counts, known = shared.value, set()
        for b in batches:
            cells = []
            for s in shingles(work.texts(b.column(0))):
                if len(s):
                    node = node_of(digest(s))
                    if node in known:
                        continue
                    known.add(node)
                    k = len(s) - -(-4 * len(s) // 5) + 1
                    order = np.lexsort((s, counts[(s & seq.U(BINS - 1)).astype(np.int64)]))[:k]
                    cells.append((s[order], node, len(s), k))
            if len(known) > 1 << 20:  # a bounded memory of what this task has emitted; emitting twice is harmless
                known.clear()
            if cells:
                k = [c[3] for c in cells]
                pos = np.concatenate([np.arange(x, dtype=np.int32) for x in k])
                yield work.batch(ENTRY, np.concatenate([c[0] for c in cells]).view(np.int64), np.repeat([c[1] for c in cells], k), np.repeat(np.array([c[2] for c in cells], np.int32), k), pos)

    return run


def possible(n1, p1, n2, p2):
    """Whether sizes and positions leave an overlap of 0.8 open, at the first shingle that two sets share."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= needed(n1, n2))


def _pairs(batches):
    first = None
    for (key, node, n, pos), goes_on in work.chunks(batches, ENTRY.names, ROWS):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, pos = (c[new] for c in (key, node, n, pos))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        big = np.repeat(size > SMALL, size)
        if goes_on:
            big[: size[0]] = True
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~big[d:]) if d < len(key) else np.zeros(0, int)
            left.append(i)
            right.append(i + d)
        head = np.repeat(start, size)
        i = np.flatnonzero(big & (head != np.arange(len(key))))
        if goes_on:  # the first chunk's first node goes on
            own = i[i >= size[0]]
            part = slice(0, int(size[0]))
            ok = possible(n[part], pos[part], np.full(size[0], first[1]), np.full(size[0], first[2])) & (node[part] != first[0])
            yield _pair_batch(node[part][ok], np.full(int(ok.sum()), first[0]))
            i = own
        else:
            first = None
        if len(start) > 1 or first is None:
            first = (node[start[-1]], n[start[-1]], pos[start[-1]])
        left.append(head[i])
        right.append(i)
        i, j = np.concatenate(left), np.concatenate(right)
        ok = possible(n[i], pos[i], n[j], pos[j])
        yield _pair_batch(node[i[ok]], node[j[ok]])
        if big.any():
            none = pa.nulls(int(big.sum()), pa.int64())
            yield work.batch(PAIR, node[big], none, key[big], n[big], pos[big])


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    none = pa.nulls(len(a))
    return work.batch(PAIR, a.astype(np.int64), b.astype(np.int64), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()))


def folded(m: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bitmaps as bitmaps of ``width`` words, by exclusive or of their parts."""
    return np.bitwise_xor.reduce(m.reshape(len(m), -1, width), axis=1)


def _across(batches):
    """Edges between labels, a forest for each chunk: pairs of one shingle whose bitmaps leave 0.8 open join theirs.

    Rows come by group, a shingle or two blocks of its nodes; ``own`` is a row's block, -1 where there is but one.
    """
    names = ["group", *ENTRY.names, "label", "bitmap", "own"]
    for (group, key, node, n, pos, label, bits, own), _ in work.chunks(batches, names, ACROSS, whole=True):
        order = np.lexsort((label, key, group))
        group, key, node, n, pos, label, bits, own = (c[order] for c in (group, key, node, n, pos, label, bits, own))
        size = np.array([len(x) // 8 for x in bits])
        at, table = np.zeros(len(bits), np.int64), {}
        for w in np.unique(size):  # bitmaps of one length in one matrix
            some = np.flatnonzero(size == w)
            at[some] = np.arange(len(some))
            table[w] = np.frombuffer(b"".join(bits[some].tolist()), np.uint64).reshape(len(some), w)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        run, part = np.cumsum(new | np.concatenate(([True], label[1:] != label[:-1]))), np.cumsum(new)
        end, last = np.searchsorted(run, run, side="right"), np.searchsorted(part, part, side="right")
        tree, edges = label.copy(), []
        for i in np.flatnonzero(end < last):
            j = np.arange(end[i], last[i])
            j = j[(tree[j] != tree[i]) & ((own[j] != own[i]) | (own[i] < 0))]
            j = j[possible(n[j], pos[j], n[i : i + 1], pos[i : i + 1])]
            mine, near = table[size[i]][at[i] : at[i] + 1], []
            for w in np.unique(size[j]):
                k, both = j[size[j] == w], min(w, size[i])
                apart = np.bitwise_count(folded(table[w][at[k]], both) ^ folded(mine, both)).sum(1, dtype=np.int64)
                total = n[k].astype(np.int64) + int(n[i])
                near.append(k[(total - apart) // 2 >= needed(total, 0)])
            for t in np.unique(tree[np.concatenate(near)]) if near else ():
                edges.append((tree[i], t))
                tree[tree == t] = tree[i]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _similar(batches):
    """The pairs whose bitmaps leave an overlap of 0.8 open."""
    for b in batches:
        x, y, na, nb, ba, bb = (b.column(i) for i in range(6))
        na, nb = na.to_numpy(), nb.to_numpy()
        la, lb = (pa.compute.binary_length(c).to_numpy() for c in (ba, bb))
        ba, bb, ok = ba.to_pylist(), bb.to_pylist(), np.zeros(b.num_rows, bool)
        for u, v in {*zip(la.tolist(), lb.tolist())}:
            own, w = np.flatnonzero((la == u) & (lb == v)), min(u, v)
            for lo in range(0, len(own), 1 << 14):
                at = own[lo : lo + (1 << 14)]
                p = np.bitwise_xor.reduce(np.frombuffer(b"".join([ba[i] for i in at]), np.uint8).reshape(len(at), -1, w), axis=1)
                q = np.bitwise_xor.reduce(np.frombuffer(b"".join([bb[i] for i in at]), np.uint8).reshape(len(at), -1, w), axis=1)
                apart = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
                ok[at] = (na[at] + nb[at] - apart) // 2 >= needed(na[at], nb[at])
        yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)), y.filter(pa.array(ok))], names=["a", "b"])


def _sets_of(shared):
    def run(batches):
        known = set()
        for b in batches:
            rows = []
            for s in shingles(work.texts(b.column(0))):
                if len(s):
                    d = digest(s)
                    node = node_of(d)
                    if d not in known and work.in_bloom(shared.value, np.array([node], np.int64).view(seq.U))[0]:
                        known.add(d)
                        rows.append((node, d, s.tobytes()))
            if len(known) > 1 << 20:
                known.clear()
            yield work.batch(SETS, *([list(c) for c in zip(*rows)] or [[]] * 3))

    return run


def links(sets: list[np.ndarray], label: np.ndarray | None = None) -> np.ndarray:
    """Component labels of the sets, linked at 0.8, by rows of the sparse product of sets and shingles.

    A row counts one set's overlap with all others at once from the lists of the sets that hold each shingle.  Rows
    are computed until those sets that have none yet are all in one component: no other pair can change anything.
    ``label``: what is known to be one component already.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    label, done = np.arange(m) if label is None else label.copy(), np.zeros(m, bool)
    if m == 2 and label[0] != label[1]:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return label[[0, 0]] if both >= needed(*n) else label
    owner = np.repeat(np.arange(m), n)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[token] > 1
    owner, token = owner[shared], token[shared]
    by = np.argsort(token, kind="stable")
    holders, first = owner[by], np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(df)))))
    of = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=m))))
    while True:
        open_ = np.flatnonzero(~done)
        if not len(open_) or (label[open_] == label[open_[0]]).all():
            return label
        names, size = np.unique(label[open_], return_counts=True)
        i = int(open_[np.flatnonzero(label[open_] == names[size.argmin()])[0]])
        done[i] = True
        t = token[of[i] : of[i + 1]]
        if not len(t):
            continue
        count = first[t + 1] - first[t]
        at = np.repeat(first[t] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        overlap = np.bincount(holders[at], minlength=m)
        hit = np.unique(label[np.flatnonzero(overlap >= needed(n[i], n))])
        hit = np.union1d(hit, [label[i]])
        label[np.isin(label, hit)] = hit[0]


def _verify(batches):
    """Rows (x, y, digest, root, grams) sorted by (x, y), the name of a block or of two; out: roots that are linked."""
    group, rows = None, {}
    out: list[tuple[bytes, bytes]] = []

    def close():
        names = list(rows)
        roots = [rows[d][0] for d in names]
        known: dict[bytes, int] = {}
        label = np.array([known.setdefault(r, k) for k, r in enumerate(roots)])
        if len(known) > 1:
            label = links([np.frombuffer(rows[d][1], seq.U) for d in names], label)
            out.extend({(roots[k], r) for k, r in zip(label.tolist(), roots) if roots[k] != r})

    def batch():
        some = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
        out.clear()
        return some

    for b in batches:
        for x, y, d, r, s in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (x, y) != group:
                close()
                group, rows = (x, y), {}
            rows[d] = r, s
        if out:
            yield batch()
    close()
    if out:
        yield batch()


def _filter(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    a = bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    b = bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ba", "bb")
    return work.stage(both.mapInArrow(_similar, "a long, b long").distinct())


def _place() -> Column:
    """What orders the rows of a component."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("sha").alias("sha"))


def _several(count: Column, grams: Column) -> Column:
    """In how many blocks so many nodes of so many shingles are cut."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(BLOCK)), F.ceil(grams / F.lit(GRAMS))).cast("long")


def _linked(src: DataFrame, dealt: DataFrame) -> DataFrame:
    """Linked roots (a, b), from sets dealt to groups: rows (digest, node, root, x, y)."""
    wanted = work.share(src.sparkSession, work.bloom(dealt.select("node").distinct(), "node"))
    sets = src.select("text").mapInArrow(_sets_of(wanted), "node long, digest binary, grams binary").drop("node")
    rows = sets.join(dealt.drop("node"), "digest").select("x", "y", "digest", "root", "grams")
    return work.stage(rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(_verify, "a binary, b binary"))


def _within(src: DataFrame, member: DataFrame) -> DataFrame:
    """(node, label) of the linked digests of each block, from the rows (digest, node, n, label, blocks, own)."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(CENTERS))
    centers = member.where("blocks > 1").groupBy("label", slot).agg(F.min("digest").alias("digest")).select("digest", F.lit(True).alias("center"))
    at = F.when(F.col("center"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = member.join(centers, "digest", "left").select("digest", "node", F.col("digest").alias("root"), F.col("label").alias("x"), F.explode(at).alias("y"))
    return components(_linked(src, dealt))


def _between(src: DataFrame, member: DataFrame, joined: DataFrame) -> DataFrame | None:
    """(node, label) of linked roots whose links lie between blocks; None if every cluster is one component."""
    wide = member.where("blocks > 1").join(joined.withColumnRenamed("label", "root"), F.col("digest") == joined["node"], "left")
    wide = work.stage(wide.select("digest", member["node"], "n", member["label"], F.coalesce("root", "digest").alias("root")))
    mixed = work.stage(wide.groupBy("label").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("label"))
    if mixed.isEmpty():
        return None
    wide = wide.join(mixed, "label", "left_semi")
    large = wide.groupBy("label", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).where(_several(F.col("c"), F.col("s")) > 1)
    unit = F.when(F.col("c").isNotNull(), F.col("root"))  # null: components of less than a block, together
    size = F.floor(F.log(1.26, "n")).cast("int")  # sets that can be linked are at most one apart
    wide = work.stage(wide.join(large, ["label", "root"], "left").select("digest", "node", "label", "root", "n", unit.alias("unit"), size.alias("size")))
    unit = ["label", "unit", "size"]
    per = wide.groupBy(*unit).agg(_several(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    per = per.select(*[F.col(k).alias(f"{k}_") for k in unit], "blocks")
    same = [wide[k].eqNullSafe(per[f"{k}_"]) for k in unit]
    block = F.xxhash64(*unit, F.pmod(F.xxhash64("digest"), "blocks"))
    wide = work.stage(wide.join(per, same).select("digest", "node", "root", *unit, block.alias("block")))
    blocks = work.stage(wide.select(*unit, "block").distinct())
    other = blocks.select(*[F.col(k).alias(f"{k}_") for k in blocks.columns])
    apart = F.col("unit").isNull() | ~F.col("unit").eqNullSafe(F.col("unit_"))
    near = F.abs(F.col("size") - F.col("size_")) <= 1
    pairs = blocks.join(other, F.col("label") == F.col("label_")).where(near & apart & (F.col("block") <= F.col("block_")))
    pairs = work.stage(pairs.select(F.col("block").alias("x"), F.col("block_").alias("y")).distinct())
    sides = pairs.select(F.col("x").alias("block"), "x", "y").union(pairs.where("x <> y").select(F.col("y").alias("block"), "x", "y"))
    return components(_linked(src, wide.join(sides, "block").select("digest", "node", "root", "x", "y")))


def _classes(docs: DataFrame, named: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, known): rows with their digest, null where a text has no shingles, and each digest's component.

    If ``named``, rows have the SHA-256 of their text, and components their size and their first row, by ``_place``.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work.ship(spark)
    stats = work.stage(src.mapInArrow(_stats_of(named), STATS_DDL))
    counts = np.zeros(BINS, np.int64)
    for r in stats.where("bin is not null").select("bin", "counts").repartition(64, "bin").mapInArrow(_add, "bin int, counts binary").collect():
        counts[r[0] * CHUNK : (r[0] + 1) * CHUNK] += np.frombuffer(r[1], np.int64)  # BINS values in all
    rows = stats.where("bin is null").select("doc_id", "n", "digest", "node", "sha")
    bits = stats.where("node is not null").select("node", "n", "digest", "bitmap").groupBy("digest").agg(F.first("node").alias("node"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    bits = work.stage(bits)

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(spread, -(-int(counts.sum()) // (5 * ROWS)))
    entries = src.select("text").mapInArrow(_entries(work.share(spark, counts)), ENTRY_DDL)
    entries = entries.repartition(parts, "key").sortWithinPartitions("key", "node")
    found = work.stage(entries.mapInArrow(_pairs, PAIR_DDL))
    label = components(_filter(found.where("b is not null").select("a", "b").distinct(), bits))

    big = found.where("key is not null").select("key", F.col("a").alias("node"), "n", "pos")
    big = work.stage(big.join(label, "node", "left").select("key", "node", "n", "pos", F.coalesce("label", "node").alias("label")))
    cut = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(ACROSS)), F.ceil(F.sum("n") / F.lit(2 * ACROSS_BYTES))).cast("int")
    mixed = big.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), cut.alias("cut"))
    mixed = work.stage(mixed.where("lo <> hi").select("key", "cut"))
    own = F.when(F.col("cut") > 1, F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")).otherwise(-1)
    across = big.join(mixed, "key").withColumn("own", own).join(bits.select("node", "bitmap"), "node")
    across = across.withColumn("other", F.explode(F.when(F.col("cut") > 1, F.sequence(F.lit(0), F.col("cut") - 1)).otherwise(F.array(F.lit(-1)))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    group = F.when(F.col("cut") > 1, F.xxhash64("key", lo, hi)).otherwise(F.col("key")).alias("group")
    within = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("own")
    across = across.select(group, "key", "node", "n", "pos", "label", "bitmap", within)
    across = across.repartition(spread, "group").sortWithinPartitions("group")
    more = work.stage(across.mapInArrow(_across, "a long, b long").distinct())
    if not more.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    member = bits.select("digest", "node", "n").join(label, "node")
    per = work.stage(member.groupBy("label").agg(_several(F.count(F.lit(1)), F.sum("n")).alias("blocks")))
    member = member.join(per, "label").withColumn("own", F.pmod(F.xxhash64("digest"), "blocks"))
    member = work.stage(member.select("digest", "node", "n", "label", "blocks", "own"))
    joined = _within(src, member)
    again = _between(src, member, joined)

    per = [F.min(_place()).alias("top"), F.count(F.lit(1)).alias("size")] if named else []
    over = [F.min("top").alias("top"), F.sum("size").alias("size")] if named else []
    extra = ["top", "size"] if named else []
    first = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), *per)
    first = first.join(joined, first["digest"] == joined["node"], "left").select("digest", "rep", F.coalesce("label", "digest").alias("root"), *extra)
    if again is not None:
        first = first.join(again, first["root"] == again["node"], "left").select("digest", "rep", F.coalesce("label", "root").alias("root"), *extra)
    first = work.stage(first)
    least = work.stage(first.groupBy("root").agg(F.min("rep").alias("component_id"), *over))
    return rows, work.stage(first.select("digest", "root").join(least, "root").select("digest", "component_id", *extra))


def classes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows, known = _classes(docs, False)
    out = rows.join(known, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one with the least doc_id, null last.

    Rows that tie on doc_id go by the SHA-256 of their texts; which of wholly tied rows stays is arbitrary.  Rows
    without shingles all stay.  Rows go by doc_id: only where several share one, and some stay and some go, are the
    texts of those rows looked at again.
    """
    rows, known = _classes(docs, True)
    several = known.where("size > 1").select("digest", "top")
    both = rows.join(several, "digest", "left").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "sha", _place().alias("own"), "top")
    alone = F.col("top").isNull()
    decided = work.stage(both.select("id", "sha", alone.alias("alone"), (alone | (F.col("own") == F.col("top"))).alias("kept")))
    firsts = F.count_if(F.col("kept") & ~F.col("alone"))
    per = decided.groupBy("id").agg(F.max("kept").alias("any"), F.min("kept").alias("all"), firsts.alias("firsts"))
    per = work.stage(per.where("not all or firsts > 1"))
    packed = work.packed(docs, NO_ID)
    out = packed.join(per.select("id"), "id", "left_anti")
    mixed = per.where("any").select("id")
    if mixed.isEmpty():
        return out.select("row.*")
    sha = F.unhex(F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")), 256))
    own = packed.join(mixed, "id", "left_semi").withColumn("sha", sha)
    stay = work.stage(decided.where("kept").join(mixed, "id", "left_semi").select("id", "sha", "alone").distinct())
    own = own.join(stay, ["id", "sha"])
    one = own.where("not alone").dropDuplicates(["id", "sha"])
    return out.select("row").union(own.where("alone").union(one).select("row")).select("row.*")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(work.read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(list_slice(a, i, least(i + 4, len(a))), 'string_agg', ' ') AS g
  FROM w, unnest(range(1, greatest(2, len(a) - 3))) AS u(i) WHERE len(a) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
