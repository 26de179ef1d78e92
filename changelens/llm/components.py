"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Nodes that a task holds before it sends what it has joined.
HELD = 1 << 19


def _forest(batches):
    """Stars from least nodes that connect what the edges of a partition connect: at most an edge for each node."""
    up: dict = {}
    names, kinds = ["a", "b"], None

    def root(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def stars():
        rows = [(root(x), x) for x in up]
        rows = [r for r in rows if r[0] != r[1]]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in (0, 1)], names=names)

    for b in batches:
        kinds = [c.type for c in b.columns]
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if x == y:
                continue
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > HELD:
            yield stars()
    if up:
        yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()
    return work.stage(edges.select("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b), loops aside: label is one node of its component.

    Each task first replaces its edges by stars.  A round sends every node to the least of its neighbours and itself,
    then to where that one went, and goes on with the edges between different ends of those ways.  Of the nodes that
    still have edges at least half go, so the number of rounds grows with the logarithm of their number.  Each round
    reads and writes tables; nothing is collected.
    """
    edges = _contracted(edges)
    label = None
    while True:
        both = edges.union(edges.select("b", "a"))
        up = work.stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")))
        jump = work.stage(up.join(up.select(F.col("node").alias("mid"), F.col("up").alias("top")), F.col("up") == F.col("mid")).select("node", "top"))
        if label is None:
            label = jump.select("node", F.col("top").alias("label"))
        else:
            on = jump.select(F.col("node").alias("mid"), "top")
            label = work.stage(label.join(on, label["label"] == on["mid"], "left").select("node", F.coalesce("top", "label").alias("label")))
        a, b = (jump.select(F.col("node").alias(x), F.col("top").alias(f"{x}_")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")).where("a <> b")
        edges = _contracted(edges)
        if edges.isEmpty():
            return label
