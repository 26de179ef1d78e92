"""The incremental index: chunk, postings and file tables in buckets of paths, followed by snapshots or by a stream of them.

Each table lies in buckets by a hash of the path.  A refresh writes the buckets of changed paths only, under its version;
a manifest, written last and put in place by one rename, says which version of each bucket counts.  So readers see the old
index or the new one, a refresh that dies leaves nothing that counts, and one that runs twice gives the same.  ``vacuum``
removes the versions of buckets that no manifest names any more.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import search, syntax
from ..runtime import put, written

#: A row with a path is a file; one without closes the snapshot: its content is the number of the snapshot's files.
SNAPSHOT = "snapshot long, path string, content string"
#: Buckets of a new index.  An index keeps its number; one of very many files should begin with more.
BUCKETS = 64
#: Characters of chunks of a partition, and so of its postings, which are sorted in memory.
PART = 1 << 23
PARTS = ("chunks", "postings", "files")


def chunked(files: DataFrame, embed=None) -> DataFrame:
    """The chunk rows of files (path, content), with a ``chunk_id`` and, by ``embed(rows)``, their vectors."""
    place = F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "symbol")
    rows = syntax.chunks(files).withColumn("chunk_id", F.sha2(place, 256))
    return embed(rows) if embed is not None else rows


def bucket(path: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def refresh(spark: SparkSession, table: str, snapshot: DataFrame, version: int, embed=None, incremental: bool = True, buckets: int = BUCKETS, counts: dict | None = None) -> DataFrame:
    """Bring the index at ``table`` to a snapshot (path, content) of one row a file; unchanged files are not chunked again.

    Hashes are compared before anything is parsed or embedded; only buckets with changed paths are read and written.
    ``counts`` is filled with files, changed, deleted and chunks, observed in the passes that write.
    """
    content = F.coalesce("content", F.lit(""))
    now = snapshot.select("path", content.alias("content"), F.sha2(content, 256).alias("hash"), F.length(content).cast("long").alias("size"))
    old = manifest(spark, table, before=version)
    if not incremental or old is None:
        old = {"buckets": old["buckets"] if old else buckets, "rows": 0, "schemas": {}, **{p: {} for p in PARTS}}
    n, at = old["buckets"], lambda part, some=None: _read(spark, table, old, part, some)
    files = at("files")
    before = files.select("path", F.col("hash").alias("old"), "chunks") if files is not None else spark.createDataFrame([], "path string, old string, chunks long")
    both = before.join(now.select("path", F.col("hash").alias("new"), "size"), "path", "full")
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    seen, wrote = Observation(), Observation()
    gone, came = F.col("change").isin("deleted", "changed"), F.col("change").isin("added", "changed")
    both = both.withColumn("change", change).observe(
        seen, F.count("new").alias("files"), F.count_if(came).alias("changed"), F.count_if(F.col("change") == "deleted").alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("chunks"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(came, F.col("size"))), F.lit(0)).alias("size"),
    )
    changes = written(both.where("change is not null").select("path", "change", F.col("new").alias("hash"), bucket("path", n).alias("bucket")))
    some = sorted(r[0] for r in changes.select("bucket").distinct().collect())  # at most the number of buckets
    total = dict(seen.get)
    out = old | {"schemas": dict(old["schemas"])}

    def write(part: str, rows: DataFrame) -> None:
        out["schemas"][part] = rows.drop("bucket", "salt").schema.json()
        rows.drop("salt").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(_folder(table, part, version))
        there = _buckets(spark, _folder(table, part, version))
        out[part] = {b: v for b, v in old[part].items() if int(b) not in some} | {str(b): version for b in there}

    if some:
        kept = at("chunks", some)
        size = total["size"] + ((kept.agg(F.sum(F.length("text"))).first()[0] or 0) if kept is not None else 0)
        new = now.select("path", "content")
        if files is not None:
            new = new.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
        rows = chunked(new, embed).withColumn("fresh", F.lit(True))
        if kept is not None:
            rows = rows.unionByName(kept.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
        own = rows.drop("hash", "fresh").columns
        marks = changes.select("path", F.col("hash").alias("_hash"), F.lit(True).alias("_mark"))  # a row for each changed path, which moves with its chunks
        rows = _dealt(rows.unionByName(marks, allowMissingColumns=True), n, size)
        of_path = Window.partitionBy("bucket", "salt", "path")
        rows = rows.withColumns({"_hash": F.max("_hash").over(of_path), "_mark": F.max("_mark").over(of_path)})
        rows = rows.where("fresh or not fresh and _mark is null").observe(wrote, F.count_if("fresh").alias("added"))  # after the exchange: once a task that counts
        held = F.when(F.col("fresh"), F.col("_hash")).otherwise(F.col("hash")) if "hash" in rows.columns else F.col("_hash")
        write("chunks", rows.withColumn("hash", held).select(*own, "hash", "bucket", "salt"))
        rows = _read(spark, table, out, "chunks", some)
        if rows is None:
            rows = spark.createDataFrame([], StructType.fromJson(json.loads(out["schemas"]["chunks"])))
        write("postings", _postings(_dealt(rows, n, size)))
        rows = changes.where("change <> 'deleted'").select("path", "hash").join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("chunks")), "path", "left").fillna({"chunks": 0})
        if files is not None:
            rows = rows.unionByName(at("files", some).join(changes.select("path"), "path", "left_anti"))
        write("files", rows.withColumn("bucket", bucket("path", n)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "path"))
        out["rows"] = old["rows"] - total["removed"] + wrote.get["added"]
    out["version"] = version
    put(spark, f"{table}/manifest/{version}", json.dumps(out))
    if counts is not None:
        counts |= {"files": total["files"], "changed": total["changed"], "deleted": total["deleted"], "chunks": out["rows"]}
    found = latest(spark, table)
    return found if found is not None else chunked(now.limit(0), embed).withColumn("hash", F.lit(""))


def _dealt(rows: DataFrame, buckets: int, size: int) -> DataFrame:
    """``rows`` with their bucket, all of a path together, in partitions of some PART of ``size`` characters; a bucket lies in several."""
    parts = max(1, -(-size // PART))
    salt = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(max(1, 4 * parts // buckets))).cast("int")
    return rows.withColumns({"bucket": bucket("path", buckets), "salt": salt}).repartition(parts, "bucket", "salt")


def _postings(chunks: DataFrame) -> DataFrame:
    """The postings of chunks that ``_dealt`` has dealt, counted where they lie and sorted by bucket and term."""
    place = ["bucket", "salt", "path", "chunk_id"]
    words = F.regexp_extract_all(F.lower("text"), F.lit(search.WORD), F.lit(1))
    rows = chunks.select(*place, words.alias("words")).withColumn("length", F.size("words")).select(*place, "length", F.explode("words").alias("term"))
    rows = rows.groupBy(*place, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    return rows.select("bucket", "salt", "chunk_id", "term", "tf", "length", "path").sortWithinPartitions("bucket", "term")


def _folder(table: str, part: str, version: int) -> str:
    return f"{table}/{part}/version={version}"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _buckets(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.split("=")[1]) for n in _names(spark, folder) if n.startswith("bucket=")]


def _paths(table: str, known: dict, part: str, some: list[int] | None = None) -> list[str]:
    return [f"{_folder(table, part, v)}/bucket={b}" for b, v in known[part].items() if some is None or int(b) in some]


def _read(spark: SparkSession, table: str, known: dict, part: str, some: list[int] | None = None) -> DataFrame | None:
    paths = _paths(table, known, part, some)
    return spark.read.schema(StructType.fromJson(json.loads(known["schemas"][part]))).parquet(*paths) if paths else None


def part_paths(spark: SparkSession, table: str, part: str) -> list[str]:
    """The folders, one a bucket, that hold a part of the newest index."""
    known = manifest(spark, table)
    return [] if known is None else _paths(table, known, part)


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions of an index that were written to their end."""
    return sorted(int(n) for n in _names(spark, f"{table}/manifest") if n.isdigit())


def manifest(spark: SparkSession, table: str, before: int | None = None, version: int | None = None) -> dict | None:
    """The manifest of a version, of the newest, or of the newest before one: buckets, and the version of each by part."""
    found = [v for v in versions(spark, table) if (before is None or v < before) and (version is None or v == version)]
    if not found:
        return None
    text = spark.read.text(f"{table}/manifest/{found[-1]}", wholetext=True).first()[0]
    return json.loads(text)


def history(spark: SparkSession, table: str) -> DataFrame:
    """(version, chunks, buckets_written): the versions of an index that were written to their end."""
    rows = [manifest(spark, table, version=v) for v in versions(spark, table)]
    return spark.createDataFrame([(m["version"], m["rows"], sum(v == m["version"] for v in m["chunks"].values())) for m in rows], "version long, chunks long, buckets_written int")


def latest(spark: SparkSession, table: str, before: int | None = None, part: str = "chunks") -> DataFrame | None:
    """A part of the newest index (or of the newest before a version): chunks, postings or files; null if it has no rows."""
    for name in PARTS:
        if table.endswith(f"/{name}"):
            table, part = table[: -len(name) - 1], name
    found = manifest(spark, table, before)
    return None if found is None else _read(spark, table, found, part)


def vacuum(spark: SparkSession, table: str, keep: int = 1) -> int:
    """Delete manifests but the newest ``keep`` and the versions of buckets that none of those names; tells how many went."""
    known = versions(spark, table)
    kept = [manifest(spark, table, version=v) for v in known[-keep:]]
    gone = 0
    for v in known[:-keep]:
        fs, target = _fs(spark, f"{table}/manifest/{v}")
        fs.delete(target, False)
    for part in PARTS:
        named = {(int(b), v) for m in kept for b, v in m[part].items()}
        for name in _names(spark, f"{table}/{part}"):
            if not name.startswith("version="):
                continue
            v = int(name.split("=")[1])
            there = _buckets(spark, f"{table}/{part}/{name}")
            if v > known[-1]:
                continue  # being written
            for b in there:
                if (b, v) not in named:
                    fs, target = _fs(spark, f"{table}/{part}/{name}/bucket={b}")
                    fs.delete(target, True)
                    gone += 1
            if not any((b, v) in named for b in there):
                fs, target = _fs(spark, f"{table}/{part}/{name}")
                fs.delete(target, True)
    return gone


def follow(snapshots: DataFrame, table: str, checkpoint: str, embed=None):
    """Follow a stream of snapshots (snapshot, path, content); a row without path closes one and says how many files it has.

    Rows wait beside the index until as many paths of their snapshot have come as its closing row says, in however many
    micro-batches, in any order and repeated; then the newest complete snapshot is applied under its number, and what
    waited for it and for older ones goes.  Of a path that comes twice the later content stays.  Snapshots older than
    the index are passed over.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = f"{table}/arrivals"
        rows = batch.where("snapshot is not null").select("snapshot", "path", "content")
        rows.write.mode("overwrite").partitionBy("snapshot").parquet(f"{waiting}/batch={batch_id}")
        known = versions(spark, table)
        there = spark.read.schema("path string, content string, snapshot long, batch long").parquet(waiting).where(F.col("snapshot") > (known[-1] if known else -1))
        size = F.max(F.when(F.col("path").isNull(), F.col("content").cast("long")))
        ready = there.groupBy("snapshot").agg(F.count_distinct("path").alias("n"), size.alias("size")).where("n = size").agg(F.max("snapshot")).first()[0]
        if ready is None:
            return
        files = there.where((F.col("snapshot") == ready) & F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.coalesce("content", F.lit("")), "batch").alias("content"))
        refresh(spark, table, files, ready, embed)
        for name in _names(spark, waiting):
            for s in _names(spark, f"{waiting}/{name}"):
                if s.startswith("snapshot=") and int(s.split("=")[1]) <= ready:
                    fs, target = _fs(spark, f"{waiting}/{name}/{s}")
                    fs.delete(target, True)

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
