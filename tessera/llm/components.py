"""Connected components of links, by alternating star contractions; nothing but sums comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, written


#: Links up to which one task unites them, counted beforehand; beyond, rounds of joins do.
ONE_TASK = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of links (a, b), the smallest node that links reach.

    No more than ONE_TASK links are united by one task. Of more, each round hangs all larger neighbours of a node on its smallest one, then all smaller ones; the links end as stars,
    after about log n rounds. Nulls make no link.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    if before[0] <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(lean(_united), "node long, component long")
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    ends = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
