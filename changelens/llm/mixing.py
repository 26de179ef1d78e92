"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's target in words is water-filled from the weights.  Below its target a source is used in whole passes and
one partial pass; the partial pass is an exact quota of its blocks (BLOCK consecutive words of one document).  The
quota goes down a binary tree over the output shards: each node splits what it got between its halves by one
hypergeometric draw, whose seed is (seed, source, node), and a shard splits its own among its documents by a
multivariate-hypergeometric draw.  The tree's top ends at groups of GROUP shards; each group goes on in a task of its
own.  A document's blocks are then the first of a permutation of its own, so blocks are disjoint within a pass, and a
shard's blocks are shuffled.  What the mix takes of a document is summed from its drawn blocks.  Draws depend on the
data and the seed only, never on partitions or task order.

Only (doc_id, size, source, a digest of the text) move.  Rows are dealt by a hash of doc_id, size, digest and a number
among wholly equal rows, so neither a hot source nor very many rows without doc_id, or repeated, meet in one shard.

Defined results.  Null text: size 0, nothing taken.  Null source: a source of its own, last in order.  Null doc_id:
an ordinary row.  Repeated rows: each is drawn from by itself.  Sources without words: target 0.  Empty table: no
rows.  A text of any length is drawn from whole.  Other columns, whatever their names, are ignored; ``mixed_texts``
keeps doc_id and source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import seq, work

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Words a block has; rows a shard has on average; least number of shards.
BLOCK, SHARD_ROWS, LEAST_SHARDS = 32, 20_000, 64
SEED = 17
#: Shards that one task deals quotas to; population from which hypergeometric draws are made here, not by numpy.
GROUP, LARGE = 1024, 1_000_000_000
#: Equal rows that are written out together.
COPIES = 4096

SIZES = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("source", pa.string()), ("digest", pa.int64())])
TAKEN = "doc_id long, source string, size long, source_size long, target double, taken long"
DRAWN = "doc_id long, source string, pass int, block int, place long"


def _sizes(batches):
    for b in batches:
        values = work.texts(b.column(1))
        n = [0] * len(values)
        for lo, hi in work.segments(values):
            buf, start, end = seq.joined(values[lo:hi])
            at = seq.word_bounds(buf)[0]
            n[lo:hi] = (np.searchsorted(at, end) - np.searchsorted(at, start)).tolist()
        yield work.batch(SIZES, b.column(0), n, b.column(2), b.column(3))


def targets(sized: DataFrame) -> DataFrame:
    """Per source: source_size and target, from rows of (source, size); one row per source meets in one window."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(k)) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(CAP))
    # Sources fill in the order of cap / weight; the level at which the rest share what is left is the first
    # that no source of the rest is full at.
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    ok = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(ok, F.col("level")), F.when(ok, F.col("cap") / F.col("weight"))).over(every)
    share = F.coalesce(level * F.col("weight"), F.col("cap"))
    return per.select("source", "source_size", F.least("cap", share).alias("target"))


def _rng(seed: int, *key) -> np.random.Generator:
    name = "\x1f".join("\x00" if x is None else str(x) for x in (seed, *key))
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "little")))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw for counts of any size: numpy's below its bound, else by inversion."""
    if not n:
        return 0
    return int(rng.hypergeometric(good, bad, n)) if good + bad < LARGE else inversion(rng, good, bad, n)


def inversion(rng: np.random.Generator, good: int, bad: int, n: int, part: int = 1 << 20) -> int:
    """A hypergeometric draw by inversion of the probabilities themselves, from the mode outwards.

    Each value's weight follows from its neighbour's by an exact ratio; values are left out only where all of them
    together weigh less than a double tells from nothing.  Time grows with the standard deviation; memory does not.
    """
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), least), most)

    def side(step: int):
        """(first value, weights) of parts on one side, relative to the mode's weight of 1."""
        at, weight = mode, 1.0
        while weight > 1e-25 and at != (most if step > 0 else least):
            m = min(part, most - at if step > 0 else at - least)
            k = at + step * np.arange(m, dtype=np.float64)  # counts below 2**53 are exact
            up = (good - k) * (n - k), (k + 1) * (bad - n + k + 1)
            down = k * (bad - n + k), (good - k + 1) * (n - k + 1)
            a, b = up if step > 0 else down
            w = weight * np.cumprod(a / b)
            yield at + step, w
            at, weight = at + step * m, float(w[-1])

    total = 1.0 + sum(float(w.sum()) for step in (1, -1) for _, w in side(step))
    left = rng.random() * total - 1.0
    if left < 0:
        return mode
    for step in (1, -1):
        for at, w in side(step):
            own = float(w.sum())
            if left < own:
                return at + step * min(int(np.searchsorted(np.cumsum(w), left, side="right")), len(w) - 1)
            left -= own
    return mode


def split(counts: list[int], quota: int, seed: int, *name) -> list[int]:
    """``quota`` blocks dealt over parts that hold ``counts`` blocks, by the tree of draws below the node ``name``."""
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    out = [0] * len(counts)
    stack = [(0, len(counts), quota)]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
        elif q:
            mid = (lo + hi) // 2
            left = hypergeometric(_rng(seed, *name, "node", lo, hi), int(total[mid] - total[lo]), int(total[hi] - total[mid]), q)
            stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _of(value) -> str | None:
    return value if isinstance(value, str) else None


def _tops(seed: int, groups: int):
    """A source's groups of shards: what each is to give."""

    def run(pdf):
        source, counts = _of(pdf["source"].iloc[0]), [0] * groups
        for g, n in zip(pdf["group"], pdf["blocks"]):
            counts[int(g)] = int(n)
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole, part = divmod(target / size, 1) if size else (0, 0)
        quota = split(counts, round(part * sum(counts)), seed, source)
        out = pdf[["source", "group", "source_size", "target"]].copy()
        out["whole"] = int(whole)
        out["quota"] = [quota[int(g)] for g in pdf["group"]]
        return out

    return run


def _quotas(seed: int):
    """A group's shards of one source: what each is to give."""

    def run(pdf):
        source, group = _of(pdf["source"].iloc[0]), int(pdf["group"].iloc[0])
        counts = [0] * GROUP
        for s, n in zip(pdf["shard"], pdf["blocks"]):
            counts[int(s) % GROUP] = int(n)
        quota = split(counts, int(pdf["quota"].iloc[0]), seed, source, "group", group)
        out = pdf[["source", "shard", "source_size", "target", "whole"]].copy()
        out["quota"] = [quota[int(s) % GROUP] for s in pdf["shard"]]
        return out

    return run


def _draws(seed: int, digest: bool):
    """One shard: its drawn blocks in their local shuffle, or (digest) what they take of each of its documents."""
    import pandas as pd

    def run(docs, quotas):
        plan = {_of(s): (int(w), int(q), int(z), float(t)) for s, w, q, z, t in zip(quotas["source"], quotas["whole"], quotas["quota"], quotas["source_size"], quotas["target"])}
        docs = docs.sort_values(["source", "doc_id", "size"], kind="stable", na_position="last")
        source = [_of(s) for s in docs["source"]]
        ids = [None if pd.isna(x) else int(x) for x in docs["doc_id"]]
        size = docs["size"].to_numpy(np.int64)
        blocks = -(-size // BLOCK)
        rows, passes, drawn, at = [], [], [], 0  # of each drawn block: document, pass, number
        shard = int(docs["shard"].iloc[0]) if len(docs) else 0
        while at < len(source):
            end = at
            while end < len(source) and source[end] == source[at]:
                end += 1
            whole, quota, _, _ = plan[source[at]]
            rng = _rng(seed, source[at], "shard", shard)
            left, total = quota, int(blocks[at:end].sum())
            for k in range(at, end):
                n = int(blocks[k])
                got = hypergeometric(rng, n, total - n, left)
                total, left = total - n, left - got
                drawn += [*[np.arange(n)] * whole, rng.permutation(n)[:got]]
                passes += [np.full(n, p) for p in range(whole)] + [np.full(got, whole)]
                rows.append(np.full(whole * n + got, k))
            at = end
        rows, passes, drawn = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, passes, drawn))
        place = _rng(seed, "place", shard).permutation(len(rows))
        if digest:
            words = np.minimum(BLOCK, size[rows] - drawn * BLOCK)
            taken = np.bincount(rows, weights=words, minlength=len(size)).astype(np.int64)
            z = [plan[s] for s in source]
            cells = (pd.array(ids, "Int64"), source, size, [p[2] for p in z], [p[3] for p in z], taken)
            return pd.DataFrame(dict(zip(("doc_id", "source", "size", "source_size", "target", "taken"), cells)))
        names = np.array([*source, None], object)[rows]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64")[rows], "source": names, "pass": passes, "block": drawn, "place": shard * (1 << 40) + place})

    return run


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``copy``, a number among wholly equal rows that does not depend on where they lie.

    Equal rows are counted, and written out again in runs of COPIES, so very many of them are spread like others.
    """
    per = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("n"))
    runs = per.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    last = F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1
    return runs.select(*sized.columns, F.explode(F.sequence(F.col("run") * COPIES, last)).alias("copy"))


def _mix(docs: DataFrame, seed: int, digest: bool) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    digest_of = src.select("doc_id", "text", "source", F.xxhash64("text").alias("digest"))
    sized = work.stage(_numbered(digest_of.mapInArrow(_sizes, "doc_id long, size long, source string, digest long")))
    shards = max(LEAST_SHARDS, -(-sized.count() // SHARD_ROWS))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "digest", "copy"), F.lit(shards)).cast("int")).drop("digest", "copy")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    counts = sized.groupBy("source", "shard").agg(F.sum(blocks).alias("blocks"))
    counts = work.stage(counts.withColumn("group", F.floor(F.col("shard") / GROUP).cast("int")))  # a row for each shard and source
    tops = counts.groupBy("source", "group").agg(F.sum("blocks").alias("blocks"))
    goal = targets(sized).withColumnRenamed("source", "of")
    tops = tops.join(goal, tops["source"].eqNullSafe(goal["of"])).drop("of")
    tops = tops.groupBy("source").applyInPandas(_tops(seed, -(-shards // GROUP)), "source string, group int, source_size long, target double, whole int, quota long")
    tops = work.stage(tops).withColumnsRenamed({"source": "of", "group": "at"})
    quotas = counts.join(tops, counts["source"].eqNullSafe(F.col("of")) & (F.col("group") == F.col("at"))).drop("of", "at")
    quotas = quotas.groupBy("source", "group").applyInPandas(_quotas(seed), "source string, shard int, source_size long, target double, whole int, quota long")
    quotas = work.stage(quotas)  # at most shards rows a source
    pairs = sized.groupBy("shard").cogroup(quotas.groupBy("shard"))
    return pairs.applyInPandas(_draws(seed, digest), TAKEN if digest else DRAWN)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken."""
    return _mix(docs, seed, True)


def mixed_blocks(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: one row per drawn block (doc_id, source, pass, block); ``place`` orders a shard's blocks."""
    return _mix(docs, seed, False)


def mixed_texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``mixed_blocks`` with the words of each block, for documents whose doc_id is unique."""
    words = F.expr("regexp_extract_all(text, '[^ \\\\x09-\\\\x0D]+', 0)")
    drawn = mixed_blocks(docs, seed)
    per = drawn.groupBy("doc_id").agg(F.collect_list(F.struct("pass", "block", "place")).alias("drawn"))
    both = docs.select("doc_id", "source", words.alias("words")).join(work.stage(per), "doc_id")
    out = both.select("doc_id", "source", "words", F.inline("drawn"))
    text = F.array_join(F.slice("words", F.col("block") * BLOCK + 1, BLOCK), " ")
    return out.select("doc_id", "source", "pass", "block", "place", text.alias("text"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(work.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
