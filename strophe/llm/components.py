"""Connected components of an edge table, without gathering it.

Edges are first contracted within partitions; then alternating large-star and small-star rounds run
until nothing changes. Once at most `finish` edges are left (a fixed bound, not a share of the data),
one task ends the work. Nodes are non-negative longs; the result has a row for each node of an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import cut, fold

FINISH = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest node of each local component."""
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 4_000_000:  # bounded memory: what was read so far becomes stars
            left, right = _stars(np.concatenate(a), np.concatenate(b))
            a, b = [left], [right]
            if len(left) > 2_000_000:
                yield _edges(left, right)
                a, b = [], []
    if a:
        yield _edges(*_stars(np.concatenate(a), np.concatenate(b)))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = fold(at[: len(a)], at[len(a) :], len(nodes))
    leaf = root != np.arange(len(nodes))
    return nodes[root[leaf]], nodes[leaf]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """node, component (the smallest node reachable) for the edges' columns a and b."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    e = cut(e.mapInArrow(_contract, "a long, b long"))
    n = e.count()
    while n > finish:
        before = e
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b")
        # small star: a node's neighbours below it, and itself, go to the smallest of them
        e = e.where("a < b").distinct()
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        up = e.join(low, "b")
        e = up.select(F.col("m").alias("a"), "b").unionByName(up.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        e = cut(e)
        n = e.count()
        if n == before.count() and e.exceptAll(before).isEmpty():
            break
    if n <= finish:
        e = e.coalesce(1).mapInArrow(_contract, "a long, b long")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
