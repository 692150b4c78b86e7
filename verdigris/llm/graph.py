"""Connected components of an edge table, for unions of near-duplicate pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of ``a[k]`` and ``b[k]``, in place; ``root`` holds the
    smallest index of each index's class before and after."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the smallest v of each u as m. The minimum is combined
    before it moves, and rows of a hot u are divided by the adaptive skew join."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` for every id on an edge; component = smallest id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); the
    number of rounds grows with the logarithm of the widest component. Every
    round is a written table. Nulls, self-loops and repeated pairs are ignored;
    an empty table gives an empty result.
    """
    edges = durable(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    before = None
    while True:
        # large star: each id joins its greater neighbours to its smallest one
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(
            _least(both).where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        # small star: each id joins its smaller neighbours and itself to the smallest
        small = _least(large)
        edges = durable(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
