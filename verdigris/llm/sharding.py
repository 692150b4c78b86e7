"""K-d tree sharding by distributed weighted medians.

Documents are points whose coordinates are whole numbers of metadata: the text's
length, its language and its source (by their ranks among all values), and last
a hash of the id. A leaf that holds more than the target bytes is split at the
weighted median (weights: bytes) of its widest dimension, its extent being
measured against the whole table's. All leaves of a level are split at once:
one aggregation finds extents, one sums bytes by leaf and value. The hash
dimension is used only where a leaf has no other extent.

Documents find their shard by the tree's cuts, from their own columns, so texts
are read once more and never move. The tree has a node a few MiB of text; its
nodes are gathered and go to each task as one array.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, fresh, key_hash

#: Bytes of text that a shard may hold.
TARGET = 16 << 20
#: Name and scale of each dimension.
DIMS = ("length", "lang", "source", "spread")
SCALES = (1.0, 1.0, 1.0, 1e-9)
#: Buckets of the hash dimension: a leaf of equal metadata divides into so many at most.
SPREAD_BITS = 20
DEEPEST = 60


def _rank(docs: DataFrame, column: str) -> DataFrame:
    values = docs.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v")).distinct()
    return durable(values.withColumn("rank", F.row_number().over(Window.orderBy("v")).cast("bigint")))


def _coordinates(id_col: str, lang_col: str, source_col: str, text_col: str) -> list[Column]:
    """Of a row of documents: its length, language, source and hash."""
    return [
        F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint").alias("length"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang_v"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source_v"),
        F.coalesce(F.shiftright(key_hash(F.col(f"`{id_col}`")), 60 - SPREAD_BITS), F.lit(0)).alias("spread"),
    ]


def _points(docs: DataFrame, id_col: str, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, and the languages and sources by rank."""
    rows = durable(
        docs.select(
            F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
            F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint").alias("bytes"),
            *_coordinates(id_col, lang_col, source_col, text_col),
        )
    )
    lang, source = _rank(rows, "lang_v"), _rank(rows, "source_v")
    named = rows.join(lang.select(F.col("v").alias("lang_v"), F.col("rank").alias("lang")), "lang_v").join(source.select(F.col("v").alias("source_v"), F.col("rank").alias("source")), "source_v")
    return named.select("doc_id", "bytes", *DIMS), lang, source


def points(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, bytes, length, lang, source, spread)``: null texts have 0 bytes,
    null languages and sources count as ''. Rows with a null id are kept."""
    return _points(docs, id_col, lang_col, source_col, text_col)[0]


def _extents() -> list:
    return [f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]


def _grow(rows: DataFrame, target: int, deepest: int = DEEPEST) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their ``leaf``, and the cuts ``(leaf, dim, cut)`` of each level."""
    levels: list[DataFrame] = []
    whole = rows.agg(*_extents()).first()
    size = [max(1, (whole[f"{d}_hi"] or 0) - (whole[f"{d}_lo"] or 0)) for d in DIMS]
    active = durable(rows.withColumn("leaf", F.lit(1).cast("bigint")))
    finished = None
    for _ in range(deepest):
        stats = active.groupBy("leaf").agg(F.sum("bytes").alias("total"), F.count("*").alias("docs"), *_extents())
        widths = [((F.col(f"{d}_hi") - F.col(f"{d}_lo")) / F.lit(float(s)) * F.lit(w)).alias(d) for d, s, w in zip(DIMS, size, SCALES)]
        widest = F.greatest(*widths)
        dim = F.coalesce(*[F.when(w == widest, F.lit(i)) for i, w in enumerate(widths)])
        split = durable(stats.where((F.col("total") > target) & (widest > 0)).select("leaf", "total", dim.alias("dim")))
        if split.isEmpty():
            break
        value = F.element_at(F.array(*DIMS), F.col("dim") + 1)
        sums = active.join(split, "leaf").groupBy("leaf", "total", value.alias("v")).agg(F.sum("bytes").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("leaf").orderBy("v"))
        last = F.max("v").over(Window.partitionBy("leaf"))
        # the median, or the value before the last if the last alone reaches the half
        below = sums.withColumn("upto", upto).withColumn("last", last).where("v < last").groupBy("leaf").agg(
            F.coalesce(F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("v"))), F.max("v")).alias("cut")
        )
        cuts = durable(below.join(split, "leaf").select("leaf", "dim", "cut"))
        levels.append(cuts)
        whole_leaves = active.join(cuts.select("leaf"), "leaf", "left_anti").select("doc_id", "bytes", *DIMS, "leaf")
        finished = whole_leaves if finished is None else finished.unionByName(whole_leaves)
        active = durable(
            active.join(cuts, "leaf").withColumn("leaf", F.col("leaf") * 2 + F.when(value > F.col("cut"), 1).otherwise(0)).select("doc_id", "bytes", *DIMS, "leaf")
        )
    return active if finished is None else finished.unionByName(active.select(*finished.columns)), levels


def shard_points(rows: DataFrame, target: int = TARGET, deepest: int = DEEPEST) -> DataFrame:
    """Points with their ``leaf``: 1 is the root, the children of k are 2k (the
    lower side, which holds the median) and 2k + 1. There are ``deepest`` levels of cuts at most."""
    return _grow(rows, target, deepest)[0]


def _leaf(levels: list[DataFrame], lang: DataFrame, source: DataFrame, coordinates: list[Column]) -> Column:
    """The leaf of a row with these coordinates. A value of a language or source lies beyond
    a cut as its rank does, since ranks are in the order of values."""
    inner: dict[int, tuple] = {}
    for cuts in levels:
        named = cuts.join(lang.select(F.col("rank").alias("cut"), F.lit(1).alias("dim"), F.col("v").alias("a")), ["dim", "cut"], "left")
        named = named.join(source.select(F.col("rank").alias("cut"), F.lit(2).alias("dim"), F.col("v").alias("b")), ["dim", "cut"], "left")
        inner |= {r[0]: tuple(r[1:]) for r in named.select("leaf", "dim", "cut", F.coalesce("a", "b")).collect()}
    # by number from 0, the root; where the lower child is, the other is next
    leaves = [1]
    nodes = []
    for leaf in leaves:
        nodes.append((leaf, *inner.get(leaf, (None, None, None)), len(leaves)))
        if leaf in inner:
            leaves += [2 * leaf, 2 * leaf + 1]
    # a literal, which Spark makes an array of once
    names = ("leaf", "dim", "cut", "value", "lower")
    tree = F.from_json(F.lit(json.dumps([dict(zip(names, n)) for n in nodes])), "array<struct<leaf: bigint, dim: int, cut: bigint, value: string, lower: int>>")

    def step(p: Column, at: Column) -> Column:
        node = F.get(p["tree"], at)
        beyond = F.when(node.dim == 0, p["length"] > node.cut).when(node.dim == 1, p["lang_v"] > node.value).when(node.dim == 2, p["source_v"] > node.value).otherwise(p["spread"] > node.cut)
        return F.when(node.dim.isNull(), at).when(beyond, node.lower + 1).otherwise(node.lower)

    steps = F.array(*[F.lit(0)] * max(1, len(levels)))
    # in an array of one, so that the coordinates are worked out once a row and not at each step
    found = F.transform(F.array(F.struct(*coordinates, tree.alias("tree"))), lambda p: F.aggregate(steps, F.lit(0), lambda at, _: step(p, at)))
    return F.get(tree, F.get(found, F.lit(0))).leaf


def shard(docs: DataFrame, target: int = TARGET, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text", deepest: int = DEEPEST) -> DataFrame:
    """``(doc_id, bytes, length, leaf)`` for every row.

    A leaf exceeds the target only if it can't be split: one document larger than
    that, or rows that agree in every dimension, the hash of their id included
    (repeated ids). Equal values are never divided. An empty table gives an empty one.
    """
    return shard_points(points(docs, id_col, lang_col, source_col, text_col), target, deepest).select("doc_id", "bytes", "length", "leaf")


def add_shards(docs: DataFrame, target: int = TARGET, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text", name: str = "shard") -> DataFrame:
    """``docs`` with a column ``name``, in place of one that it may have. Rows that repeat an id with other metadata
    may lie in several leaves; all get the smallest of these. Rows with a null id get null."""
    doc, leaf = fresh(docs, "__doc"), fresh(docs, "__leaf")
    rows, lang, source = _points(docs, id_col, lang_col, source_col, text_col)
    leaves, levels = _grow(rows, target)
    several = leaves.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(doc)).agg(F.min("leaf").alias(leaf), F.max("leaf").alias("hi"))
    several = durable(several.where(F.col(leaf) < F.col("hi")).select(doc, leaf))
    key = F.col(f"`{id_col}`").cast("bigint")
    own = F.when(key.isNotNull(), _leaf(levels, lang, source, _coordinates(id_col, lang_col, source_col, text_col)))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    if several.isEmpty():
        return docs.select(*others, own.alias(name))
    return docs.join(several, key == F.col(doc), "left").select(*others, F.coalesce(F.col(leaf), own).alias(name))
