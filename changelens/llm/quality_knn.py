"""Quality classification by nearest-neighbour voting among latent-semantic vectors.

Hashed byte trigrams (case, symbols and layout kept) become TF-IDF vectors, get a few shares of repetition and
symbols beside them and, by a truncated singular value decomposition of the labelled sample, latent vectors.  The sample's vectors are broadcast; each document is compared
with all of them by exact cosine, in blocks of one matrix product, and its NEIGHBOURS nearest vote with a weight that
falls off with their cosine.  Document frequencies are counted over all rows; the labelled sample is at most MAX_FIT rows, so the
broadcast is at most MAX_FIT * RANK floats however large the corpus is.

Defined results.  Null or empty text: the share of label 1 in the sample.  Null doc_id: never learned from, scored
like any other, held_out null.  No labelled row: score 0.5.  Repeated rows: one row out for each; of
labelled rows that share a doc_id, the greatest text and the greatest label are learned, as one row.  Empty table: no
rows.  A text of any length is scored whole.  Other columns are ignored.  A score depends on the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charvec, work
from .language_id import held_out

ORDERS, BITS = (3,), 12
#: Documented bound of the labelled sample; latent dimensions; neighbours; documents in one product.
MAX_FIT, RANK, NEIGHBOURS, ROWS = 3000, 48, 15, 256
#: Weight of the structure shares beside a unit TF-IDF vector.
STRUCTURE = np.float32(0.7)
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: DataFrame, corpus: DataFrame) -> dict:
    """A model from rows of (doc_id, text, label 0 or 1) and the corpus whose document frequencies count."""
    df, n = charvec.document_frequency(corpus, charvec.raw_codes, ORDERS, BITS)
    ks, ns, shares, labels, _ = charvec.sample_counts(rows, MAX_FIT, lambda v: [charvec.raw_codes(v)], ORDERS, BITS)
    y = np.array([float(v) for v in labels], np.float32)
    if not len(y):
        return {"prior": 0.5}
    idf = charvec.idf_of(df, n)
    x = np.zeros((len(y), 1 << BITS), np.float32)  # MAX_FIT rows at most
    for i, (k, c) in enumerate(zip(ks, ns, strict=True)):
        x[i, k] = np.log1p(c.astype(np.float32)) * idf[k]
    x = with_structure(unit(x), np.array(shares, np.float32).reshape(len(y), -1))
    basis = principal(x, RANK)
    return {"prior": float(y.mean()), "idf": idf.astype(np.float32), "basis": basis, "known": unit(x @ basis), "y": y}


def principal(x: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from a fixed start.

    It needs no more memory than a few columns beside ``x``, as no Gram matrix is formed.
    """
    rank = min(rank, *x.shape)
    wide = min(rank + 16, *x.shape)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).normal(size=(x.shape[1], wide)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, values, turn = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ turn.T)[:, : max(1, int((values[:rank] > 1e-4 * values[0]).sum()))].astype(np.float32)


def with_structure(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return np.concatenate([x, STRUCTURE * np.sqrt(shares)], axis=1)


def vote(latent: np.ndarray, model: dict) -> np.ndarray:
    """Scores of rows of unit latent vectors: similarity-weighted share of label 1 among the nearest."""
    k = min(NEIGHBOURS, len(model["y"]))
    cos = latent @ model["known"].T
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(cos, top, 1).astype(np.float64)
    weight = np.maximum(near, 0.0) ** 4 + 1e-9
    return np.clip((weight * model["y"][top]).sum(1) / weight.sum(1), 0.0, 1.0)


def _score(shared):
    def run(batches):
        m = shared.value
        for b in batches:
            values = work.texts(b.column(1))
            out = np.full(len(values), m["prior"])
            for lo in range(0, len(values) if "basis" in m else 0, ROWS):
                own = [i for i in range(lo, min(lo + ROWS, len(values))) if values[i]]
                if own:
                    x = np.stack([charvec.counts(charvec.raw_codes(values[i]), ORDERS, BITS) for i in own])
                    shares = np.stack([charvec.structure(values[i]) for i in own])
                    x = with_structure(unit(np.log1p(x).astype(np.float32) * m["idf"]), shares) @ m["basis"]
                    out[own] = vote(unit(x), m)
            yield work.batch(OUT, b.column(0), out, (out >= 0.5).astype(np.int32))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, score, predicted."""
    shared = work.share(docs.sparkSession, model)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_score(shared), "doc_id long, score double, predicted int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learned from: of documents at hand, at most MAX_FIT ids."""
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT)
    return docs.join(F.broadcast(work.stage(own)), "doc_id")  # own: at most MAX_FIT rows


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = work.read(spark, sf_dir, "documents"), work.read(spark, sf_dir, "labels")
    model = fit(labelled(docs, labels), docs)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
