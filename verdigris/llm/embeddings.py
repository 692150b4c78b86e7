"""Embedding near-duplicates by sorted projection passes.

A pass hashes each vector by the signs of random projections, orders the vectors
lexicographically by the concatenated signs and compares each with the next
``window`` in that order; pairs that reach the cosine threshold are verified on
the spot. The union of the passes' pairs gives classes (connected components).
As groups of copies may be larger than any window, all pairs inside a class are
then compared exactly, so the window bounds work and not the number of links.
Passes return edges that connect what they verified, and the last comparison
returns numbers of links, so that results grow with the vectors and not with the
pairs among copies.

Of n spread vectors a pass links an isolated pair if the first log2(n / window)
of its signs agree. The passes and the window follow from n, so that this holds
for at least ``RECALL`` of the pairs at the threshold, however large the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable
from .graph import components, unite

THRESHOLD = 0.9
#: The fewest passes and the smallest window, which do for small tables.
PASSES, BITS, WINDOW = 12, 48, 32
#: Modelled share of isolated pairs at the threshold that the passes link, the
#: widest window, and what sorting a vector costs in comparisons with a neighbour.
RECALL, WIDEST, SORTING = 0.95, 1_024, 1_024
#: Vectors in a sorted run, and in a side of a tile of a group.
RUN, TILE = 50_000, 2_048

EDGES = "a bigint, b bigint"


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows with an id and a vector of finite numbers that
    isn't empty or zero; others are left out."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).distinct()


def linked(count: int, window: int, threshold: float) -> float:
    """Modelled chance that one pass links an isolated pair at the threshold."""
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return agree ** max(0.0, math.log2(max(1, count) / window))


def plan(count: int, threshold: float = THRESHOLD, passes: int | None = None, window: int | None = None) -> tuple[int, int]:
    """Passes and window for ``count`` vectors: of the windows whose passes reach
    ``RECALL``, the one with the least work. What is given stays."""
    if passes is not None and window is not None:
        return passes, window
    best = None
    size = window or WINDOW
    while True:
        chance = linked(count, size, threshold)
        need = PASSES if chance >= 1 else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-chance)))
        if passes is None:
            if best is None or need * (SORTING + size) < best[0] * (SORTING + best[1]):
                best = need, size
        elif need <= passes or size >= count:
            return passes, size
        if window is not None or (passes is None and size >= WIDEST):
            return best
        size *= 2


def planes(dim: int, number: int, bits: int) -> np.ndarray:
    return np.random.default_rng([number, dim]).standard_normal((dim, bits)).astype(np.float32)


def unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _keys(number: int, bits: int):
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                key = np.zeros(len(batch), np.int64)
                dims = batch.v.map(len).to_numpy()
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    key[at] = ((unit(batch.v.iloc[at]) @ planes(int(dim), number, bits)) > 0) @ weights
                yield batch.assign(dim=dims.astype(np.int32), key=key)

    return work


def _near(x: np.ndarray, window: int, threshold: float, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``window`` apart; with ``split``, only those across it."""
    step = max(256, min(window, 1_024))
    first, last = (0, len(x)) if split is None else (max(0, split - window), split)
    for i in range(first, last, step):
        rows = min(i + step, last)
        ahead = i if split is None else split
        r, c = np.nonzero(x[i:rows] @ x[ahead : rows + window].T >= threshold)
        apart = ahead + c - i - r
        fit = (apart >= 1) & (apart <= window)
        yield i + r[fit], ahead + c[fit]


def _edges(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """An edge from each index that has a pair to the first of its class."""
    root = np.arange(len(ids))
    for i, j in pairs:
        unite(root, i, j)
    at = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[at], "b": ids[root[at]]})


def _run(window: int, threshold: float):
    """Edges inside a sorted partition, its rows within a window of its ends, and
    its number of rows (in ``pos``, with part alone)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        part, n = int(rows.part.iloc[0]), len(rows)
        for _, same in rows.groupby("dim"):
            yield _edges(same.vec_id.to_numpy(), _near(unit(same.v), window, threshold)).assign(part=None, pos=None, end=None, v=None)
        yield pd.DataFrame({"a": [None], "b": [None], "part": [part], "pos": [n], "end": [None], "v": [None]})
        for end, at in ((0, np.arange(min(window, n))), (1, np.arange(max(0, n - window), n))):
            yield pd.DataFrame({"a": rows.vec_id.to_numpy()[at], "b": None, "part": part, "pos": at - end * n, "end": end, "v": rows.v.to_numpy()[at]})

    return work


def reaches(sizes: dict[int, int], window: int) -> list[tuple[int, int, int]]:
    """``(part, border, gap)``: the first rows of ``part`` lie ``gap`` rows beyond
    the end of part ``border``, nearer than the window. Parts may be shorter than
    the window, or missing."""
    parts = sorted(sizes)
    found = []
    for k, part in enumerate(parts):
        gap = 0
        for border in reversed(parts[:k]):
            if gap >= window:
                break
            found.append((part, border, gap))
            gap += sizes[border]
    return found


def _border(window: int, threshold: float):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        group["dim"] = group.v.map(len)
        out = [_edges(same.a.to_numpy(), _near(unit(same.v), window, threshold, int((same.pos < 0).sum()))) for _, same in group.groupby("dim")]
        return pd.concat(out, ignore_index=True)

    return work


def _tile(threshold: float):
    """Numbers of links between two tiles of a class, or inside one."""

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.tile == key[1]], group[group.tile == key[2]]
        x, y = unit(left.v), unit(right.v)
        out, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for i in range(0, len(x), 1_024):
            near = x[i : i + 1_024] @ y.T >= threshold
            if key[1] == key[2]:
                near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            out[i : i + 1_024] = near @ right.copies.to_numpy(np.int64)
            back += left.copies.to_numpy(np.int64)[i : i + 1_024] @ near
        if key[1] == key[2]:
            return pd.DataFrame({"vec_id": left.vec_id.to_numpy(), "links": out})
        return pd.DataFrame({"vec_id": np.concatenate([left.vec_id.to_numpy(), right.vec_id.to_numpy()]), "links": np.concatenate([out, back])})

    return work


def edges_of_passes(unique: DataFrame, count: int, threshold: float, passes: int, window: int, bits: int = BITS, run: int = RUN) -> DataFrame:
    """Verified edges ``(a, b)`` of all passes over ``unique`` (vec_id, v)."""
    spark = unique.sparkSession
    runs = max(1, -(-count // run))
    unions = None
    for number in range(passes):
        keyed = unique.mapInPandas(_keys(number, bits), "vec_id bigint, v array<float>, dim int, key bigint")
        ordered = keyed.repartitionByRange(runs, "dim", "key", "vec_id").sortWithinPartitions("dim", "key", "vec_id").withColumn("part", F.spark_partition_id())
        near = durable(ordered.mapInPandas(_run(window, threshold), f"{EDGES}, part int, pos bigint, end int, v array<float>"))
        inside = near.where("b IS NOT NULL").select("a", "b")
        # one number a partition
        sizes = {r["part"]: r["pos"] for r in near.where("a IS NULL").select("part", "pos").collect()}
        reach = reaches(sizes, window)
        if reach:
            across = spark.createDataFrame(reach, "part int, border int, gap bigint")
            ahead = near.where("end = 0").join(across, "part").select("border", "a", (F.col("pos") + F.col("gap")).alias("pos"), "v").where(F.col("pos") < window)
            behind = near.where("end = 1").select(F.col("part").alias("border"), "a", "pos", "v")
            inside = inside.unionByName(ahead.unionByName(behind).groupBy("border").applyInPandas(_border(window, threshold), EDGES))
        unions = inside if unions is None else unions.unionByName(inside)
    return unions.where("a <> b").distinct()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, passes: int | None = None,
                    window: int | None = None, bits: int = BITS, run: int = RUN, tile: int = TILE) -> DataFrame:
    """``(vec_id, class_id, links)``, a row a vector.

    ``class_id`` is the smallest id of the vector's class, all vectors that it
    reaches by links; ``links`` the number of vectors in its class whose cosine
    with it reaches the threshold, copies included. Equal vectors are compared
    once, as one with a number of copies. A vector that ``clean`` leaves out is a
    class of its own, without links. Vectors of different lengths are never near.
    Rows that repeat an id with one vector are one; with different vectors, the id's links
    are summed and its classes are one. Rows with a null id are left out, and an empty
    table gives an empty one. Passes and window that aren't given follow from the number
    of distinct vectors (``plan``); nothing is capped.
    """
    rows = durable(clean(vectors, id_col, vec_col))
    unique = durable(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    count = unique.count()
    passes, window = plan(count, threshold, passes, window)
    points = unique.select(F.col("node").alias("vec_id"), "v")
    edges = durable(edges_of_passes(points, count, threshold, passes, window, bits, run))

    member = durable(components(edges, "a", "b"))
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    large = durable(
        member.join(sizes, "component").select(F.col("id").alias("vec_id"), "component", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
        .withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    )
    # a member meets every tile of its class, in the order of tiles
    meets = large.join(unique.select(F.col("node").alias("vec_id"), "v", "copies"), "vec_id").withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    tiles = meets.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "vec_id", "v", "copies")
    links = tiles.groupBy("component", "i", "j").applyInPandas(_tile(threshold), "vec_id bigint, links bigint").groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))

    # classes of ids: those of their vectors, joined where an id has several
    named = unique.select("node", "rep").join(member.withColumnRenamed("id", "node"), "node")
    several = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    bound = rows.join(several, "vec_id", "left_semi").join(unique.select("v", "rep"), "v").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    roots = named.groupBy("component").agg(F.min("rep").alias("first"))
    joined = components(named.join(roots, "component").select(F.col("rep").alias("a"), F.col("first").alias("b")).unionByName(bound), "a", "b").withColumnRenamed("id", "rep").withColumnRenamed("component", "class_id")
    nodes = durable(unique.join(links, "node", "left").join(joined, "rep", "left").select("v", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    every = vectors.select(F.col(id_col).cast("bigint").alias("vec_id")).where("vec_id IS NOT NULL").select("vec_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    placed = rows.join(nodes, "v").select("vec_id", "class_id", "links").unionByName(every)
    return placed.groupBy("vec_id").agg(F.coalesce(F.min("class_id"), "vec_id").alias("class_id"), F.sum("links").alias("links"))
