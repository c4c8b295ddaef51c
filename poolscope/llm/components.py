"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Links that one task contracts.
LOCAL = 500_000


def _contract(batches):
    """The links of a partition as stars: each node that is not the smallest of those it reaches here, with the smallest."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b]):  # whole trees move, so a chain takes few rounds
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["u", "v"])


def connected(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over links (u, v), for each node that has a link.

    Tasks first contract LOCAL links each to stars, in memory; where all links fit in one task, that is the result. Else rounds follow.
    Each round joins every node's larger neighbours to its smallest neighbour, then its smaller ones, which halves the depth of the trees;
    it ends when a round changes nothing. Smallest neighbours come from a partial aggregation and are written before they are joined, so that a node with
    very many links is split by the join. Links stay distributed: only a count and a checksum reach the driver.
    """

    def least(rows: DataFrame, step: str) -> DataFrame:
        """Each row (u, v) with m, the smallest v of its u."""
        found = scratch.keep(rows.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-{step}")
        return rows.join(found.hint("merge"), "u")

    parts = max(1, -(-links.count() // LOCAL))
    edges = links.filter("u <> v").select("u", "v").coalesce(parts).mapInArrow(_contract, "u long, v long")
    sign, k = None, 0
    while True:
        edges = scratch.keep(edges, f"{name}-{k}")
        now = (1, 0) if parts == 1 else edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if k:
            scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large", f"{name}-{k}-small")
        if sign == tuple(now) or not now[0] or parts == 1:
            break
        sign, k = tuple(now), k + 1
        both = edges.union(edges.select("v", "u"))
        large = least(both, "large").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")
        small = least(large, "small")
        edges = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
