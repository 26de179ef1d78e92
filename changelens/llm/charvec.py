"""Hashed character n-gram counts of whole texts, and document frequencies over a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seq, work

#: Characters handled at once, so memory does not grow with a text.
BLOCK = 1 << 18
FREQUENCY = pa.schema([("k", pa.int32()), ("n", pa.int64())])
SPARSE = pa.schema([("doc_id", pa.int64()), ("view", pa.int32()), ("k", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("s", pa.list_(pa.float32())), ("label", pa.string())])
#: Class of each byte: 0 other, 1 capital, 2 symbol, 3 digit.
CLASS = np.array([1 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 2 if chr(c) in "#$%&*|!<>{}[]=+~^@\\/_" else 0 for c in range(256)])
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point below 0x110000, itself where it is a letter, else a space."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.uint32)
        alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(alpha, points, np.uint32(32)))
    return _letters[0]


def letter_codes(text: bytes) -> np.ndarray:
    """Lower-cased code points, everything but letters as a space."""
    return letters()[np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32)]


def raw_codes(text: bytes) -> np.ndarray:
    """Bytes as they are, but every digit as 0: case, symbols and layout tell quality."""
    b = np.frombuffer(text, np.uint8).copy()
    b[(b >= 48) & (b <= 57)] = 48
    return b


def counts(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Occurrences of each hashed n-gram of the given orders, in 2**bits bins."""
    out = np.zeros(1 << bits, np.int64)
    most, shift = max(orders), seq.U(64 - bits)
    for lo in range(0, len(codes), BLOCK):
        c = codes[lo : lo + BLOCK + most - 1].astype(seq.U)
        h = None
        for n in range(1, most + 1):
            h = c * seq.STEP[40] if n == 1 else h[: len(h) - 1] * seq.STEP[41] + c[n - 1 :]
            if n in orders:
                own = h[:BLOCK]  # grams that start in this block
                out += np.bincount(((own * seq.STEP[42 + n]) >> shift).astype(np.int64), minlength=1 << bits)
            if len(h) <= 1:
                break
    return out


def structure(text: bytes) -> np.ndarray:
    """Shares that n-gram counts do not show: words that repeat the one before, words seen before, capitals, symbols."""
    h = seq.Words([text]).hash
    b = np.frombuffer(text, np.uint8)
    kinds = np.bincount(CLASS[b], minlength=4) / max(1, len(b))
    again = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    return np.array([again, 1 - len(np.unique(h)) / max(1, len(h)), kinds[1], kinds[2], kinds[3]], np.float32)


def document_frequency(docs: DataFrame, codes, orders, bits: int) -> tuple[np.ndarray, int]:
    """Texts with each bin, over all rows of ``docs``, and their number; 2**bits values reach the driver."""

    def run(batches):
        n = np.zeros((1 << bits) + 1, np.int64)
        for b in batches:
            for v in work.texts(b.column(0)):
                if v:
                    n[:-1] += counts(codes(v), orders, bits) > 0
                    n[-1] += 1
        k = np.flatnonzero(n)
        yield work.batch(FREQUENCY, k.astype(np.int32), n[k])

    work.ship(docs.sparkSession)
    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << bits) + 1, np.int64)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def sample_counts(rows: DataFrame, limit: int, views, orders, bits: int):
    """A bounded sample of (doc_id, text, label), the ``limit`` rows of least hashed doc_id.

    ``views`` gives the code sequences that are counted of a text.  Returns per view the bins, their counts, the
    text's structure shares, its label, and the view's number.  Of rows that share a doc_id, the greatest by text,
    then label, is taken.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, (v, label) in enumerate(zip(work.texts(b.column(1)), b.column(2).to_pylist())):
                s = structure(v or b"")
                for view, codes in enumerate(views(v or b"")):
                    c = counts(codes, orders, bits)
                    at = np.flatnonzero(c)
                    rows.append((b.column(0)[i].as_py(), view, at.astype(np.int32), c[at].astype(np.int32), s, label))
            yield work.batch(SPARSE, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SPARSE)))

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"))
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    picked = rows.join(F.broadcast(ids), "doc_id")  # at most ``limit`` ids
    picked = picked.groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")
    work.ship(rows.sparkSession)
    got = picked.mapInArrow(run, "doc_id long, view int, k array<int>, n array<int>, s array<float>, label string")
    got = got.withColumn("h", F.xxhash64("doc_id")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("view", "ascending")])
    lists = []
    for name in ("k", "n", "s"):  # slices of one array each, not lists of Python numbers
        c = got.column(name).combine_chunks()
        c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks or [pa.array([], c.type)])
        at, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        lists.append([flat[a:b] for a, b in zip(at[:-1], at[1:])])
    return [*lists, got.column("label").to_pylist(), got.column("view").to_pylist()]


def tfidf(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times idf, of unit length."""
    x = np.log1p(c) * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + df)) + 0.1
