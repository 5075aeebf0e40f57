"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One contraction: each node links its larger (or its smaller and equal) neighbours to its least neighbour.

    The minimum is a pre-aggregated shuffle and meets the pairs in an equi-join, so that a node with
    very many neighbours isn't gathered anywhere.
    """
    if small:
        least = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        moved = pairs.join(least, pairs["hi"] == least["node"]).select(F.col("lo").alias("a"), F.col("least").alias("b"))
        own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        out = moved.unionByName(own)
    else:
        both = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
        out = pairs.join(least, pairs["lo"] == least["node"]).select(F.col("hi").alias("a"), F.col("least").alias("b"))
    return out.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def roots_of(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component), by halving paths over one array."""
    nodes, at = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    x, y = at[: len(lo)], at[len(lo) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = 0) -> DataFrame:
    """Returns (node, root) for each node that has an edge; root is the least node of its component.

    Each round is cut to the shared folder. Rounds grow with the logarithm of a component's diameter. Up to `few` different edges
    between long nodes the driver finds the roots instead, which takes one job and not some thirty.
    Null ends and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    pairs = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    before = mark(pairs)
    if before["n"] == 0:
        return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    if before["n"] <= few:
        got = pairs.toArrow()
        node, root = roots_of(*(got.column(c).to_numpy() for c in ("hi", "lo")))
        return cut(pairs.sparkSession.createDataFrame(pa.table({"node": node, "root": root})))
    for _ in range(rounds):
        pairs = cut(_star(_star(pairs, small=False), small=True))
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
