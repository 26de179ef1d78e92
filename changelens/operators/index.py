"""Incremental index maintenance: snapshot delta, application, freshness, checkout state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta(previous: DataFrame, current: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """Paths that differ between snapshots (path, hash), with ``change``: added, changed or deleted."""
    p = previous.select(key, F.col(digest).alias("old"))
    c = current.select(key, F.col(digest).alias("new"))
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return p.join(c, key, "full").select(key, change.alias("change")).where("change is not null")


def apply_delta(existing: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """``existing`` rows without those of changed paths, plus ``fresh`` rows of paths that were added or changed."""
    kept = existing.join(changes.select(key), key, "left_anti")
    new = fresh.join(changes.where("change <> 'deleted'").select(key), key, "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def delta_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_if(F.col("change") != "deleted").alias("changed_files"), F.count_if(F.col("change") == "deleted").alias("deleted_files"))


def is_incremental(force: Column, has_table: Column, meta_model: Column, model: Column, files: Column) -> Column:
    return ~force & has_table & F.coalesce(meta_model == model, F.lit(False)) & files.isNotNull()


def freshness(facts: DataFrame) -> DataFrame:
    """``facts`` with state and needs_commits_behind.

    Columns read: has_table, has_meta, meta_model, model, indexed_sha, main_sha, head_sha, dirty.  Freshness is
    measured against the main line where there is one; only without one does a dirty checkout count.
    """
    now = F.coalesce("main_sha", "head_sha")
    dirty = F.col("main_sha").isNull() & F.col("dirty")
    same = now == F.col("indexed_sha")
    known = (F.coalesce(now, F.lit("")) != "") & (F.coalesce("indexed_sha", F.lit("")) != "")
    state = (
        F.when(~F.col("has_table"), "absent")
        .when(~F.col("has_meta"), "unknown")
        .when(~F.coalesce(F.col("meta_model").eqNullSafe(F.col("model")), F.lit(False)), "model_mismatch")
        .when(~known, "unknown")
        .when(same & dirty, "stale")
        .when(same, "fresh")
        .otherwise("stale")
    )
    out = facts.withColumns({"state": state, "compared_against": F.substring(now, 1, 8)})
    return out.withColumn("needs_commits_behind", (F.col("state") == "stale") & ~F.coalesce(same, F.lit(False)))


def root_state(facts: DataFrame) -> DataFrame:
    """``facts`` (is_git, root_sha, review_head, head_present) with root_state, null where it cannot be told."""
    untold = (F.coalesce("review_head", F.lit("")) == "") | ~F.col("is_git")
    state = F.when(untold, None).when(~F.col("head_present"), "mr_head_absent").when(~F.col("root_sha").eqNullSafe(F.col("review_head")), "not_checked_out").otherwise("on_mr_head")
    return facts.withColumn("root_state", state)


def auto_index(facts: DataFrame, enabled: bool = True) -> DataFrame:
    """Whether an index is to be (re)built before it is used."""
    return facts.withColumn("auto_index", F.lit(enabled) & F.col("state").isin("absent", "stale", "model_mismatch", "unknown"))


def commits_behind(commits: DataFrame, points: DataFrame) -> DataFrame:
    """(repository, behind): commits that ``head`` reaches and ``since`` does not.

    ``commits`` (repository, sha, parent) has a row for each parent, ``points`` (repository, head, since) one a
    repository.  A repository's history, of names only, is walked once from both ends in a task of its own.
    """
    import pandas as pd

    def walk(history: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for sha, parent in zip(history["sha"], history["parent"]):
            if isinstance(parent, str):
                parents.setdefault(sha, []).append(parent)

        def ancestors(start: str, known: set[str]) -> set[str]:
            seen, front = set(), [start]
            while front:
                x = front.pop()
                if x not in seen and x not in known:
                    seen.add(x)
                    front += parents.get(x, [])
            return seen

        rows = [(r, len(ancestors(h, ancestors(s, set())))) for r, h, s in zip(points["repository"], points["head"], points["since"])]
        return pd.DataFrame(rows, columns=["repository", "behind"])

    history = commits.select("repository", "sha", "parent").groupBy("repository")
    return history.cogroup(points.select("repository", "head", "since").groupBy("repository")).applyInPandas(walk, "repository string, behind long")


def next_step(facts: DataFrame) -> DataFrame:
    """``facts`` (state) with ``next``: what to do about an index that cannot be relied on, or null."""
    advice = {
        "absent": "no index yet: build one to get similar code",
        "stale": "the index is behind the main line: refresh it, only changed files are read again",
        "model_mismatch": "the index was built with another model: rebuild it",
        "unknown": "the index has no record of its state: rebuild it once",
    }
    table = F.create_map(*[F.lit(x) for kv in advice.items() for x in kv])
    return facts.withColumn("next", F.try_element_at(table, F.col("state")))
