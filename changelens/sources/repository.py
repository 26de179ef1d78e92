"""Source trees, index sidecars and git facts."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULT_BRANCHES = ("refs/remotes/origin/HEAD", "refs/remotes/origin/main", "refs/remotes/origin/master", "refs/heads/main", "refs/heads/master")


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files of a tree but those in skipped directories; paths are relative to it."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + T.quoted(base), "")
    return files.select(rel.alias("path"), "length", "content").where(~T.in_skipped_dir(F.col("path")))


def scan(spark: SparkSession, root: str, limit: int | None = None, seen: Observation | None = None) -> DataFrame:
    """(path, language, content, hash) of a tree's source files: known extensions, no skipped directory, not blank.

    Contents are decoded on the JVM.  ``seen`` observes ``met``, the files that the walk meets, source files or not.
    """
    files = _tree(spark, root)
    files = files if seen is None else files.observe(seen, F.count(F.lit(1)).alias("met"))
    files = files.where(T.language(F.col("path")).isNotNull())
    if limit is not None:
        files = files.where(F.col("length") <= limit)
    raw = F.col("content").cast("string")
    body = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    out = files.select("path", T.language(F.col("path")).alias("language"), body.alias("content"))
    return out.where(T.strip(F.col("content")) != "").withColumn("hash", F.sha2("content", 256))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Index records of ``*.meta.json`` files; one that is not JSON gives a record of nulls.

    ``files`` may be a map from path to hash or a list of paths; an index that keeps its files as a table has neither.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.meta.json", recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.meta\.json$", 1).alias("name"), "value")
    meta = F.from_json("value", "root string, remote string, chunks long, indexed_at string, git_sha string, model string")
    as_map, as_list = F.from_json(F.get_json_object("value", "$.files"), "map<string, string>"), F.from_json(F.get_json_object("value", "$.files"), "array<string>")
    is_list = F.get_json_object("value", "$.files").startswith("[")
    files = F.coalesce(F.when(is_list, as_list).otherwise(F.map_keys(as_map)), F.array().cast("array<string>"))
    out = raw.select("name", meta.alias("m"), files.alias("fileset"), F.when(~is_list, as_map).alias("files"))
    return out.select("name", "m.root", "m.remote", "m.chunks", F.coalesce("m.indexed_at", F.lit("")).alias("indexed_at"), "m.git_sha", "m.model", "fileset", "files")


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size_bytes) of the folders just below ``folder``, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + T.quoted(folder.rstrip("/") + "/"), "")
    return files.groupBy(F.element_at(F.split(rel, "/"), 1).alias("name")).agg(F.sum("length").alias("size_bytes"))


def git(root: str, *args: str, timeout: int = 10) -> str | None:
    """What git prints, or None when it fails; runs on the driver."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def git_facts(spark: SparkSession, root: str, review_head: str | None = None) -> DataFrame:
    """One row about a checkout: head, main line, remote, dirtiness, presence of a review's head."""
    top = git(root, "rev-parse", "--is-inside-work-tree") == "true"
    main = next((s for b in DEFAULT_BRANCHES if top and (s := git(root, "rev-parse", "--verify", "--quiet", b))), None)
    head = git(root, "rev-parse", "HEAD") if top else None
    present = bool(review_head) and git(root, "cat-file", "-e", f"{review_head}^{{commit}}") is not None
    row = (root, top, head, main, git(root, "remote", "get-url", "origin") if top else None, bool(git(root, "status", "--porcelain")) if top else False, review_head, present)
    out = spark.createDataFrame([row], "root string, is_git boolean, root_sha string, main_sha string, remote_url string, dirty boolean, review_head string, head_present boolean")
    return out.withColumns({"head_sha": F.col("root_sha"), "remote": T.normal_remote(F.col("remote_url")), "key": T.index_key(F.col("root"))})


def commits_between(root: str, since: str, head: str) -> int | None:
    n = git(root, "rev-list", "--count", f"{since}..{head}")
    return int(n) if n else None


def live_keys(spark: SparkSession, roots: list[str], folders: list[str] = ()) -> DataFrame:
    """(name) of the indexes that are reachable: recorded roots that exist and checkouts found below ``folders``."""
    from pathlib import Path

    found = {str(Path(r).resolve()) for r in roots if r and Path(r).exists()}
    for f in folders:
        found |= {str(g.parent.resolve()) for g in Path(f).expanduser().rglob(".git") if g.is_dir()}
    keys = {hash_key(git(r, "rev-parse", "--path-format=absolute", "--git-common-dir") or r) for r in found}
    return spark.createDataFrame([(k,) for k in sorted(keys)], "name string")


def hash_key(path: str) -> str:
    """What ``functions.text.index_key`` gives, for one path on the driver."""
    import hashlib

    return hashlib.sha256(path.encode()).hexdigest()[:16]
