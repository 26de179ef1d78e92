"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are trained by follow-the-regularised-leader with elastic-net penalties (per-coordinate rates; L1 leaves
most weights zero, and only the others are kept and broadcast).  A temperature calibrates them: of the documents kept
from training, short PIECES are cut, on which the model errs at times, and the temperature with the least log loss
against smoothed labels is taken.  Document frequencies are counted over all learnable rows; the weights are fitted on
at most MAX_FIT of them, those of least hashed doc_id.

Defined results.  Null text, empty text or text without a letter: ``und`` with score 0.  Null doc_id: never learned
from, predicted like any other, held_out null.  No learnable row: every text is ``und`` with score 0.  One learned
value only: it, with score 1.  Repeated rows: one row out for each; of learnable rows that share a doc_id, the
greatest by text, then label, is learned.  Empty table: no rows.  A text of any length is read whole.  Other columns,
whatever their names: ignored by ``predict``, carried by ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charvec, work

ORDERS, BITS = (1, 2, 3), 14
#: Documented bound of the fitting sample; passes over it; FTRL rates and penalties.
MAX_FIT, EPOCHS, ALPHA, BETA, L1, L2 = 3000, 4, 1.0, 1.0, 0.3, 1e-3
#: Characters of the pieces that the temperature is fitted on; share of a label that smoothing gives to all classes.
PIECES, SMOOTH = (4, 8, 16, 32), 0.02
#: ``keep`` rejects texts whose language is undetermined or less probable than this.
MIN_SCORE = 0.4
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int) -> np.ndarray:
    """Weights (features, classes) after EPOCHS passes of FTRL-proximal over (indices, values, class)."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k, x, y in rows:
            zk, nk = z[k], n[k]
            w = weights(zk, nk)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            g2 = g * g
            z[k] = zk + g - (np.sqrt(nk + g2) - np.sqrt(nk)) / ALPHA * w
            n[k] = nk + g2
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss against smoothed labels, of a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.005), np.log(20), 121))

    def loss(t):
        log = np.log(np.maximum(softmax(scores / t), 1e-12))
        return -((1 - SMOOTH) * log[np.arange(len(y)), y] + SMOOTH * log.mean(1)).mean()

    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def views(text: bytes) -> list[np.ndarray]:
    """The letters of a text, and of a piece of each of PIECES, from places that depend on the text alone."""
    codes = charvec.letter_codes(text)
    at = int.from_bytes(hashlib.blake2b(text, digest_size=6).digest(), "little")
    return [codes, *[codes[lo : lo + n] for k, n in enumerate(PIECES) for lo in [(at >> 8 * k) % max(1, len(codes) - n + 1)]]]


class Weights:
    """The weights that are not zero, by class: bins and values."""

    def __init__(self, w: np.ndarray):
        self.parts = [(np.flatnonzero(c).astype(np.int32), c[c != 0].astype(np.float32)) for c in w.T]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.array([float(x[k] @ v) for k, v in self.parts])


def fit(rows: DataFrame) -> dict:
    """A model from rows of (doc_id, text, label) with labels that are not null."""
    df, n = charvec.document_frequency(rows, charvec.letter_codes, ORDERS, BITS)
    ks, ns, _, labels, view = charvec.sample_counts(rows, MAX_FIT, views, ORDERS, BITS)
    names, idf = sorted(set(labels)), charvec.idf_of(df, n)
    train, pieces, nth = [], [], -1
    for k, c, label, v in zip(ks, ns, labels, view, strict=True):
        nth += v == 0
        if len(k):
            x = np.log1p(c) * idf[k]
            row = (k, x / max(1e-12, np.sqrt(x @ x)), names.index(label))
            if v == 0 and nth % 5:
                train.append(row)
            elif v and not nth % 5:
                pieces.append(row)
    if not train:  # four rows at most: learn from all of them
        train = [(k, np.full(len(k), len(k) ** -0.5), names.index(label)) for k, label, v in zip(ks, labels, view) if len(k) and not v]
    if not train:
        return {"names": []}
    w = ftrl(train, 1 << BITS, len(names))
    scores = np.array([x @ w[k] for k, x, _ in pieces]).reshape(-1, len(names))
    t = temperature(scores, np.array([y for *_, y in pieces], int)) if len(pieces) else 1.0
    return {"names": names, "idf": idf, "w": Weights(w), "t": t}


def _predict(model):
    def run(batches):
        m = model.value
        for b in batches:
            names, scores = [], []
            for v in work.texts(b.column(1)):
                codes = charvec.letter_codes(v) if v and m["names"] else None
                if codes is None or not (codes != 32).any():
                    names.append("und")
                    scores.append(0.0)
                    continue
                x = charvec.tfidf(charvec.counts(codes, ORDERS, BITS), m["idf"])
                p = softmax(m["w"].scores(x) / m["t"])
                names.append(m["names"][int(p.argmax())])
                scores.append(float(p.max()))
            yield work.batch(OUT, b.column(0), names, scores)

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = work.share(docs.sparkSession, model)  # at most 2**BITS weights a class
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, all columns, whose language the model recognises."""
    shared = work.share(docs.sparkSession, model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        score = _predict(shared)
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(at)], names=["doc_id", "text"])
            got = next(score(iter([pair])))
            ok = [n != "und" and s >= MIN_SCORE for n, s in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.read(spark, sf_dir, "documents")
    return predict(docs, fit(learnable(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
