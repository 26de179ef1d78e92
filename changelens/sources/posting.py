"""Review comments as a sink of Spark's writer: each draft is posted once, also when a task or the whole job runs again.

A ledger, a folder that executors and driver share, has a file for each key of a draft (a digest of review, file, line and
body).  A task looks there before it posts and writes there as soon as it has posted, so what a lost task had posted is not
posted by the next.  Between the two lies one call: a task that dies there posts that one draft again.  Speculative
execution must be off, as two attempts of one task at a time would not see each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.review import comment_errors
from ..runtime import ship
from ..schemas import POST_OUTCOME
from .sinks import post_in_order

NAME = "review_comments"


class Ledger:
    """Outcomes by key below a path or a URI of a file system that Arrow reaches."""

    def __init__(self, place: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")

    def get(self, key: str) -> dict | None:
        from pyarrow import fs

        path = f"{self.base}/{key}.json"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, key: str, outcome: dict) -> None:
        self.fs.create_dir(self.base, recursive=True)
        fresh = f"{self.base}/.{key}.new"
        with self.fs.open_output_stream(fresh) as f:
            f.write(json.dumps(outcome).encode())
        self.fs.move(fresh, f"{self.base}/{key}.json")


class Done(WriterCommitMessage):
    """What a task tells the driver: counts, no rows."""

    def __init__(self, posted: int, before: int, failed: int):
        self.posted, self.before, self.failed = posted, before, failed


def sink(connect: Callable[[], Callable[[dict], None]], scrub: Callable[[str], str] = str) -> type[DataSource]:
    """A data source that writes drafts (review_id, ord, file_path, body, new_line, old_line, key, ...) to what ``connect`` gives.

    Its option ``ledger`` names the ledger.  Rows of a review must come together and in order.
    """

    class Writer(DataSourceWriter):
        def __init__(self, ledger: str):
            self.ledger = ledger

        def write(self, rows) -> WriterCommitMessage:
            ledger, post, counts = Ledger(self.ledger), connect(), [0, 0, 0]

            def once(draft):
                known = ledger.get(draft["key"])
                if known is not None and known["status"] == "posted":
                    counts[1] += 1
                    return
                post(draft)
                ledger.put(draft["key"], {"status": "posted"})
                counts[0] += 1

            def close(drafts):
                for draft, outcome in zip(drafts, post_in_order(drafts, once, scrub), strict=True):
                    counts[2] += outcome["status"] == "failed"
                    ledger.put(draft["key"], outcome | {"key": draft["key"]})

            drafts: list[dict] = []  # of one review, which has a bounded number
            for row in rows:
                if drafts and drafts[0]["review_id"] != row["review_id"]:
                    close(drafts)
                    drafts = []
                drafts.append(row.asDict())
            close(drafts)
            return Done(*counts)

        def commit(self, messages) -> None:
            done = [m for m in messages if m is not None]
            print(f"posted {sum(m.posted for m in done)}, before {sum(m.before for m in done)}, failed {sum(m.failed for m in done)}")

    class ReviewComments(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return Writer(self.options["ledger"])

    return ReviewComments


def post_once(drafts: DataFrame, connect: Callable[[], Callable[[dict], None]], ledger: str, scrub: Callable[[str], str] = str) -> DataFrame:
    """Post the valid drafts, a review's in order, and return their outcomes from the ledger.

    Drafts of one key are one post; of these the first by ord has the outcome.  Outcomes are written by the tasks and
    read as a table: none passes through the driver.
    """
    spark = drafts.sparkSession
    ship(spark)
    spark.dataSource.register(sink(connect, scrub))
    key = F.sha2(F.concat_ws("\x1f", "review_id", "file_path", F.coalesce("new_line", "old_line").cast("string"), "body"), 256)
    valid = comment_errors(drafts).where("error is null").drop("error").withColumn("key", key)
    first = valid.groupBy("key").agg(F.min_by(F.struct(*[c for c in valid.columns if c != "key"]), "ord").alias("d")).select("d.*", "key")
    first.repartition("review_id").sortWithinPartitions("review_id", "ord").write.format(NAME).mode("append").option("ledger", ledger).save()
    keys = valid.select("key").distinct()
    return spark.read.schema(f"{POST_OUTCOME}, key string").json(ledger).join(keys, "key", "left_semi").drop("key")
