"""Vectors of texts from an injected client, batch by batch; models and their presence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 32


def embed(rows: DataFrame, connect: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "text") -> DataFrame:
    """``rows`` with ``vector``; ``connect`` runs once a task and returns what turns a batch of texts into vectors."""
    import pandas as pd

    def vectors(batches):
        client = connect()
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), BATCH):
                out += client(list(texts[k : k + BATCH]))
            yield pd.Series(out)

    return rows.withColumn("vector", F.pandas_udf(vectors, "array<float>", F.PandasUDFType.SCALAR_ITER)(F.col(column)))


def model_present(name: Column, wanted: Column) -> Column:
    """A model is there under its full name, or under the name before the tag."""
    return (name == wanted) | (F.split_part(name, F.lit(":"), F.lit(1)) == F.split_part(wanted, F.lit(":"), F.lit(1)))


def with_pull(call: Callable, pull: Callable[[], None], missing: Callable[[Exception], bool]) -> Callable:
    """``call`` that fetches a missing model once and tries again."""
    done: list[bool] = []

    def run(*args):
        try:
            return call(*args)
        except Exception as e:
            if done or not missing(e):
                raise
            done.append(True)
            pull()
            return call(*args)

    return run
