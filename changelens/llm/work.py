"""Session-scoped work tables in the cluster's shared folder, Bloom bitmaps and Arrow helpers.

``stage`` cuts lineage by writing a Parquet table below ``spark.checkpoint.dir``, which every executor and
the driver reach, so that a lost executor costs only its running tasks.  The tables live under one folder
per application; ``drop_all`` removes it once the results have been consumed.
"""

from __future__ import annotations

import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared, ship
from ..runtime import table as read

#: Upper bound of a broadcast bitmap: 2**29 bits are 64 MB.  Beyond it the bitmap only lets more rows through;
#: every consumer confirms what the bitmap lets through, so results do not depend on its size.
MAX_BLOOM_BITS = 1 << 29
#: The paths of the work tables that each thread of an application has staged, in order: queries that run side by side
#: in threads of one application keep apart.
_tables: dict[tuple[str, int], list[str]] = {}


def _own(spark: SparkSession) -> list[str]:
    return _tables.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def stage(df: DataFrame, small: bool = False, rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    ``small``: of a table much smaller than what it is made from, few files are written; its rows are dealt anew.
    ``rows``: most rows of a file, for rows of megabytes: the reader fills its columns with thousands of one file's rows at once.
    """
    spark = df.sparkSession
    ship(spark)
    df = df.hint("rebalance") if small else df
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    _own(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """A point in the sequence of this thread's work tables."""
    return len(_own(spark))


def only_latest(spark: SparkSession, since: int) -> None:
    """Delete the work tables since a ``mark`` but the latest, which needs none of them any more."""
    own = _own(spark)
    for path in own[since:-1]:
        _delete(spark, path)
    own[since:-1] = []


def drop_all(spark: SparkSession) -> None:
    """Delete this application's work tables; DataFrames that read them stop working."""
    _delete(spark, shared(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, none: int) -> DataFrame:
    """(row, id): whole rows of ``docs`` in one column, so that no name of theirs can clash, and doc_id or ``none``."""
    row = docs.select(F.struct("*").alias("row"))
    return row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(none)).alias("id"))


def share(spark: SparkSession, value):
    """Broadcast a value whose size the caller bounds, to executors that have this package."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """A two-probe Bloom bitmap over a column of well-mixed 64-bit keys, at most ``MAX_BLOOM_BITS`` bits.

    The bits are set in the cluster by ``bit_or`` per 64-bit word; the driver gets the words that are not zero.
    """
    n = max(1, keys.count())
    bits = 1 << min(MAX_BLOOM_BITS.bit_length() - 1, max(12, (8 * n - 1).bit_length()))
    k = F.col(column)
    probes = F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 33).bitwiseAND(F.lit(bits - 1)))
    got = (
        keys.select(F.explode(probes).alias("p"))
        .select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(b)").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def in_bloom(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a uint64 key may be in the set, never False where it is."""
    mask, one, six, low = np.uint64(len(bitmap) * 64 - 1), np.uint64(1), np.uint64(6), np.uint64(63)
    p, q = keys & mask, (keys >> np.uint64(33)) & mask
    return ((bitmap[p >> six] >> (p & low)) & (bitmap[q >> six] >> (q & low)) & one).astype(bool)


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; None stays None."""
    return column.cast(pa.binary()).to_pylist() if len(column) else []


def segments(values: list[bytes | None], limit: int = 1 << 18):
    """Runs ``(first, last)`` of rows with about ``limit`` bytes of text; one longer text is a run of its own."""
    first, size = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(values):
        yield first, len(values)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def chunks(batches, names: list[str], rows: int, whole: bool = False):
    """Column arrays of at least ``rows`` rows that end where the first column's run ends, from sorted batches.

    Unless runs are to stay whole, one longer than four times that comes in parts; the flag tells that a part
    continues a run.
    """
    held, last, goes_on = [], None, False
    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))])
        if sum(len(h[0]) for h in held) < rows:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut == 0 and len(cols[0]) > 4 * rows and not whole:
            cut = len(cols[0])
        if cut:
            yield [c[:cut] for c in cols], goes_on and cols[0][0] == last
            last, goes_on = cols[0][cut - 1], True
        held = [[c[cut:] for c in cols]]
    if held:
        cols = [np.concatenate(c) for c in zip(*held)]
        if len(cols[0]):
            yield cols, goes_on and cols[0][0] == last
