"""Sinks: index tables and review comments."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.review import comment_errors
from ..runtime import put
from ..schemas import POST_OUTCOME

RETRY = (429, 500, 502, 503, 504)
BASE_DELAY, MAX_DELAY, MAX_RETRIES, GAP, ERROR_CHARS = 0.5, 8.0, 4, 0.25, 200


def is_transient(error: Exception) -> bool:
    """Worth a retry: a status of rate limits or server trouble; without a status, a timeout or connection error."""
    code = next((c for a in ("response_code", "status") if isinstance(c := getattr(error, a, None), int)), None)
    if code is not None:
        return code in RETRY
    return any(word in type(error).__name__.lower() for word in ("timeout", "connection"))


def post_in_order(drafts: list[dict], post: Callable[[dict], None], scrub: Callable[[str], str] = str, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Post drafts one after the other, with backoff for transient errors and a pause after each success."""
    out = []
    for k, draft in enumerate(drafts):
        attempts, waited, error = 0, 0.0, None
        while True:
            attempts += 1
            try:
                post(draft)
                error = None
            except Exception as e:  # noqa: BLE001 - any failure is an outcome
                error = e
            if error is None or attempts > MAX_RETRIES or not is_transient(error):
                break
            delay = min(BASE_DELAY * 2 ** (attempts - 1), MAX_DELAY)
            waited += delay
            sleep(delay)
        if error is None and k + 1 < len(drafts):
            sleep(GAP)
        message = None if error is None else scrub(str(error))[:ERROR_CHARS]
        line = draft.get("new_line") or draft.get("old_line")
        status = "posted" if error is None else "failed"
        out.append({"review_id": draft["review_id"], "ord": draft["ord"], "file_path": draft["file_path"], "line": line, "status": status, "error": message, "attempts": attempts, "waited": waited})
    return out


def post_comments(drafts: DataFrame, connect: Callable[[], Callable[[dict], None]], scrub: Callable[[str], str] = str) -> DataFrame:
    """Outcome of each valid draft; a review's drafts go out in order, one at a time, reviews side by side.

    A task that is retried posts again, so ``connect`` gives a poster that knows what it has posted by ``key`` (a
    digest of review, file, line and body).
    """
    import pandas as pd

    key = F.sha2(F.concat_ws("\x1f", "review_id", "file_path", F.coalesce("new_line", "old_line").cast("string"), "body"), 256)
    valid = comment_errors(drafts).where("error is null").drop("error").withColumn("key", key)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord").astype(object)
        items = [{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in rows.to_dict("records")]
        return pd.DataFrame(post_in_order(items, connect(), scrub), columns=[c.split()[0] for c in POST_OUTCOME.split(", ")])

    return valid.groupBy("review_id").applyInPandas(run, POST_OUTCOME)


def post_summary(outcomes: DataFrame) -> DataFrame:
    posted = F.count_if(F.col("status") == "posted")
    return outcomes.groupBy("review_id").agg(F.count(F.lit(1)).alias("total"), posted.alias("posted"), F.count_if(F.col("status") == "failed").alias("failed"), (posted > 0).alias("published"))


def replace_index(rows: DataFrame, path: str) -> None:
    """Write an index anew; an empty one is written too, so that nothing of the old stays."""
    rows.write.mode("overwrite").parquet(path)


def _path(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_index(spark, path: str) -> bool:
    """Delete an index; tells whether there was one."""
    fs, target = _path(spark, path)
    return bool(fs.exists(target) and fs.delete(target, True))


def write_record(spark, folder: str, name: str, record: dict) -> None:
    """Write an index's record as ``<name>.meta.json``, over the old one by one rename."""
    put(spark, f"{folder}/{name}.meta.json", json.dumps(record, ensure_ascii=False))


def drop_record(spark, folder: str, name: str) -> bool:
    """Delete an index's record; tells whether there was one."""
    fs, target = _path(spark, f"{folder}/{name}.meta.json")
    return bool(fs.exists(target) and fs.delete(target, False))
