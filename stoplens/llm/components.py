"""Connected components over an edge table, without holding a component in one task."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.common import written


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest ``v`` of each ``u``. The rebalance makes the later join shuffle both sides, so that adaptive
    execution can split a node that holds a large part of the edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Alternating large-star and small-star rounds: each node links its larger neighbours, then its smaller ones and
    itself, to the smallest node it knows. Both keep the components; the edges become stars around the smallest
    nodes in a number of rounds that grows with the logarithm of the size. Each round is written to the shared
    folder. Rows with a null end and loops are ignored; an empty table gives an empty table.
    """
    ends = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u")\
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "large-star")
        small = large.join(_smallest(large), "u")\
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct("u", F.col("m").alias("v")))).alias("e"))\
            .select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "small-star")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))\
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum: equal marks mean that a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def local_roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest place that each of ``n`` places reaches by the links (p, q) of one group, by halved paths."""
    root = np.arange(n)
    while len(p):
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, root[p], low)
        np.minimum.at(root, root[q], low)
        root = root[root]
        if (before == root).all():
            break
    return root
