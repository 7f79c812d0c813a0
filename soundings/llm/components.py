"""Connected components of links between 64-bit numbers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soundings.session import cut_lineage

HELD = 200_000


def join_roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Let ``root``, which has each number's smallest known relation, know that these pairs belong together."""
    while True:
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def joined_links(links: list[np.ndarray]) -> list[np.ndarray]:
    """The same groups with the fewest links: each number of a group to its smallest (signed)."""
    if not links or not sum(map(len, links)):
        return []
    whole = np.concatenate(links)
    nodes, at = np.unique(whole.view(np.int64), return_inverse=True)
    left, right = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    join_roots(root, left, right)
    other = root != np.arange(len(nodes))
    return [np.stack([nodes[root[other]], nodes[other]], axis=1).view(whole.dtype)]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out(links):
        whole = np.concatenate([np.empty((0, 2), np.int64), *links])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(whole[:, 0])), pa.array(np.ascontiguousarray(whole[:, 1]))], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1))
        n += batch.num_rows
        if n > HELD:
            held = joined_links(held)
            n = sum(map(len, held))
            if n > HELD // 2:
                yield out(held)
                held, n = [], 0
    yield out(joined_links(held))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest number it is joined with, for every linked node but roots.

    ``links`` has columns a and b.  Each round first joins every node's larger neighbours to
    the smallest it knows, then its smaller ones; what has become a star stays.  Rounds are
    written, so that a lost executor costs one of them, and a node with many neighbours is
    a crowded join key like any other, which adaptive execution splits.
    """
    edges = cut_lineage(links.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        larger = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        larger = cut_lineage(larger)
        least = larger.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        smaller = larger.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut_lineage(smaller.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
