"""Connected components by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: So many links or fewer are solved on the driver: 1 MB, for which rounds of joins would write mostly empty files.
DIRECT = 1 << 16


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _solved(a: np.ndarray, b: np.ndarray) -> pa.Table:
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, last = np.arange(len(ids)), None
    a, b = at[: len(a)], at[len(a) :]
    while last is None or (root != last).any():
        last, root = root, root.copy()
        least = np.minimum(root[a], root[b])
        for end in (a, b, last[a], last[b]):
            np.minimum.at(root, end, least)
        root = root[root]
    return pa.table({"node": ids, "root": ids[root]})


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches.

    `links` has two long columns, in either direction, repeated or not. Nodes
    without a link to another node, and rows with a null end, give no row. The
    edge list is contracted by distributed joins and written after each round,
    until DIRECT links or fewer are left, which the driver solves; of more
    nothing but two numbers reaches it.
    """
    a, b = links.columns[:2]
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = checkpointed(edges)
    last = _signature(edges)
    while last[0] > DIRECT:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.a", "e.b").filter("a != b").distinct())
        now = _signature(edges)
        if now == last:
            break
        last = now
    if last[0] <= DIRECT:
        few = edges.toArrow()
        return edges.sparkSession.createDataFrame(_solved(few["a"].to_numpy(), few["b"].to_numpy()), "node long, root long")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
