"""Running sums over groups of any size, in two passes: within blocks, and over the sums of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written


def running(rows: DataFrame, by: str, block: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name, the sum of its values over the rows of ``by`` up to each one in ``order``.

    ``block`` must not fall along the order; rows are dealt and sorted by it, so a huge group lies in many partitions, and
    only one row a block meets in a window over its group.  The rows are written once, as both passes read them.
    """
    own = written(rows.withColumns({"_block": block} | {f"_{k}": v for k, v in sums.items()}))
    inner = Window.partitionBy(by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = own.groupBy(by, "_block").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    per = per.select(F.col(by).alias("_by"), F.col("_block").alias("_of"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}0") for k in sums])
    own = own.withColumns({k: F.sum(f"_{k}").over(inner) for k in sums})
    both = own.join(per, own[by].eqNullSafe(per["_by"]) & (own["_block"] == per["_of"]))
    return both.withColumns({k: F.col(k) + F.col(f"_{k}0") for k in sums}).select(*rows.columns, *sums)
