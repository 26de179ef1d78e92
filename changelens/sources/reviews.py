"""Reviews from exported platform records: a Python data source, and the mapping of both platforms' fields."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "kind string, review_id string, ord long, record string"


class ReviewExport(DataSource):
    """``spark.read.format("review_export").load(folder)``: JSON exports, one file per review, as rows of records.

    A file holds review, files, discussions (or review_comments and issue_comments), changes and versions; each item
    becomes a row (kind, review_id, ord, record as JSON).  Files are read where executors can open the path.
    """

    @classmethod
    def name(cls) -> str:
        return "review_export"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition):
        data = json.loads(Path(partition.value).read_text(encoding="utf-8"))
        review = str(data.get("review_id") or Path(partition.value).stem)
        for kind, items in data.items():
            for i, x in enumerate(items if isinstance(items, list) else [items] if isinstance(items, dict) else []):
                yield kind, review, i, json.dumps(x)


def register(spark: SparkSession) -> None:
    from ..runtime import ship

    ship(spark)
    spark.dataSource.register(ReviewExport)


def records(raw: DataFrame, kind: str, schema: str) -> DataFrame:
    """Records of one kind with their fields, from rows of ``review_export`` or any table of that shape."""
    return raw.where(F.col("kind") == kind).select("review_id", "ord", F.from_json("record", schema).alias("r")).select("review_id", "ord", "r.*")


def _filled(*columns):
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns])


def github_files(raw: DataFrame) -> DataFrame:
    """(filename, status, patch, previous_filename) to file diffs; a patch that is missing is empty."""
    return raw.select(
        "review_id", F.col("ord").alias("file_ord"), F.col("filename").alias("file_path"), F.coalesce(_filled("previous_filename"), "filename").alias("old_path"),
        F.col("status").eqNullSafe("added").alias("new_file"), F.col("status").eqNullSafe("removed").alias("deleted_file"), F.col("status").eqNullSafe("renamed").alias("renamed_file"),
        F.coalesce("patch", F.lit("")).alias("patch"),
    )


def gitlab_files(changes: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(new_path, old_path, new_file, deleted_file, renamed_file, diff) to file diffs.

    Reviews without any row in ``changes`` take theirs from ``fallback``.
    """
    if fallback is not None:
        changes = changes.unionByName(fallback.join(changes.select("review_id").distinct(), "review_id", "left_anti"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return changes.select(
        "review_id", F.col("ord").alias("file_ord"), F.coalesce(_filled("new_path"), "old_path", F.lit("unknown")).alias("file_path"), F.coalesce("old_path", "new_path", F.lit("unknown")).alias("old_path"),
        flag("new_file"), flag("deleted_file"), flag("renamed_file"), F.coalesce("diff", F.lit("")).alias("patch"),
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """Per review, the version of largest id (id, base_commit_sha, head_commit_sha, start_commit_sha)."""
    row = F.struct("id", *[F.coalesce(f"{k}_commit_sha", F.lit("")).alias(f"{k}_sha") for k in ("base", "head", "start")])
    return versions.groupBy("review_id").agg(F.max_by(row, "id").alias("v")).select("review_id", "v.*")


def github_metadata(raw: DataFrame) -> DataFrame:
    """Review metadata of pull requests; a commit's title is its message's first line."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    titles = F.transform(F.coalesce("commit_messages", F.array().cast("array<string>")), lambda m: F.split_part(m, F.lit("\n"), F.lit(1)))
    return raw.select(
        "review_id", "number", text("title").alias("title"), F.coalesce("login", F.lit("unknown")).alias("author"), text("head_ref").alias("source_branch"), text("base_ref").alias("target_branch"), text("body").alias("description"),
        text("state").alias("state"), text("mergeable_state").alias("merge_status"), titles.alias("commits"),
        F.struct(text("base_sha").alias("base_sha"), text("head_sha").alias("head_sha"), text("base_sha").alias("start_sha")).alias("shas"),
    )


def gitlab_metadata(raw: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        "review_id", F.col("iid").alias("number"), "title", F.coalesce("username", F.lit("unknown")).alias("author"), "source_branch", "target_branch", text("description").alias("description"),
        text("state").alias("state"), text("detailed_merge_status").alias("merge_status"), F.coalesce("commit_titles", F.array().cast("array<string>")).alias("commits"),
    )


def github_threads(comments: DataFrame) -> DataFrame:
    """Threads of review comments (id, ord, in_reply_to_id, login, body, created_at, path, line, original_line)."""
    from ..operators.review import reply_threads

    roots = reply_threads(comments.select("review_id", "ord", "id", "in_reply_to_id"))
    rows = comments.join(roots, ["review_id", "id"])
    note = F.struct("ord", F.coalesce("login", F.lit("unknown")).alias("author"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("created_at", F.lit("")).alias("created_at"), F.lit(False).alias("system"))
    line = F.coalesce(F.when(F.col("line") != 0, F.col("line")), "original_line")
    per = rows.groupBy("review_id", "root").agg(F.min("ord").alias("disc_ord"), F.min_by("path", "ord").alias("file_path"), F.min_by(line, "ord").alias("line"), F.array_sort(F.collect_list(note)).alias("notes"))
    bare = F.transform("notes", lambda n: F.struct(n["author"].alias("author"), n["body"].alias("body"), n["created_at"].alias("created_at"), n["system"].alias("system")))
    return per.select("review_id", "disc_ord", F.col("root").cast("string").alias("id"), F.lit(False).alias("resolved"), "file_path", "line", bare.alias("notes"))
