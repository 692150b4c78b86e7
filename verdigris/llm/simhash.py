"""SimHash near-duplicates, searched exactly with vantage-point trees.

A document's fingerprint is the 64-bit SimHash of its set of lower-case words.
Two documents are linked when their fingerprints differ in at most ``radius``
bits and a second, independent SimHash confirms it: it differs in at most a
quarter of its 64 bits. (Of unrelated pairs one in 10⁸ is within 10 bits by
chance, which is too many among the pairs of a large corpus; the second hash
leaves one in 10¹².) Sizes don't count: a text and one that adds to it are
linked if their hashes say so.

Distinct fingerprints are partitioned by a vantage-point tree: a node divides
them at the median Hamming distance from its vantage fingerprint, until a leaf
fits a shard. A query descends into each side that the triangle bound can't
exclude, so it visits every shard that its ball overlaps, and is compared there.
Inside a shard five blocks of 12 or 13 bits serve as filter: words within 10
bits are within 2 bits in the first block or within 1 in another, which leaves
a fiftieth of the comparisons and loses none. Words that agree in a block lie
together and are compared with all their neighbours in one array operation.

The comparisons are fewest where shards are large, and so are the copies of
words that meet other shards, so a shard grows with the table up to ``SHARD``.

Linked documents form classes (connected components). Shards return a number of
links and one edge for each fingerprint, never their pairs, so results grow with
the documents however large the groups of copies are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, durable, without
from .graph import components, unite

RADIUS = 10
#: Bits in which the second hash may differ.
CONFIRM = 16
#: Fingerprints that a leaf holds, and a tile of its visitors: a third of the table, but
#: ``LEAST`` at least and ``SHARD`` at most.
LEAST, SHARD = 32_768, 262_144
#: Bits of the blocks by which a shard is searched.
BLOCKS = (13, 13, 13, 13, 12)
#: Pairs that are given out at once.
CHUNK = 1 << 20
#: Pairs that are compared at once.
CELLS = 1 << 18
#: Words whose hashes a Python worker remembers.
MEMO = 400_000


class WordHashes(dict):
    """Word -> its MD5, remembered up to a bound."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()
        return value


def simhash(words: set[str], hashes: dict[str, bytes]) -> tuple[int, int]:
    """Two signed 64-bit SimHashes of a non-empty set of words, by the halves of
    the words' MD5; a tie gives a 0 bit."""
    digests = np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint8).reshape(-1, 16)
    # 255 rows at a time their ones fit a byte, in which numpy adds fastest
    ones = np.zeros(128, np.int64)
    for i in range(0, len(digests), 255):
        ones += np.unpackbits(digests[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)
    first, second = np.packbits(2 * ones > len(digests)).view(">i8").tolist()
    return first, second


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, chk)``: both SimHashes.

    Whole texts are used. Rows whose text is null or has no word have null
    hashes; rows with a null id are left out. A repeated id is kept per row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        find = WORD.findall
        for batch in batches:
            fps, checks = [], []
            for text in batch.column(1):
                text = text.as_py()
                words = set(find(text.lower())) if text else None
                fp, chk = simhash(words, hashes) if words else (None, None)
                fps.append(fp)
                checks.append(chk)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(checks, pa.int64())], ["doc_id", "fp", "chk"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(work, "doc_id bigint, fp bigint, chk bigint")


def _descend(rows: DataFrame, nodes: DataFrame, slack: int) -> DataFrame:
    """One level down: rows at an inner node go to the sides within ``slack`` of
    its border; rows at leaves stay."""
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    sides = F.filter(
        F.array(
            F.when(d - slack <= F.col("border"), F.col("path") * 2),
            F.when(d + slack > F.col("border"), F.col("path") * 2 + 1),
        ),
        lambda p: p.isNotNull(),
    )
    joined = rows.join(nodes, "path", "left")
    return joined.withColumn("path", F.explode(F.when(F.col("vantage").isNull(), F.array("path")).otherwise(sides))).select(*rows.columns)


def _grow(stored: DataFrame, capacity: int) -> tuple[DataFrame, list[DataFrame]]:
    """Split overfull leaves level by level; returns the rows at their leaves and
    each level's inner nodes. Only counts by distance (65 a leaf) are gathered
    to choose borders, and they stay a table."""
    levels: list[DataFrame] = []
    finished = None
    while True:
        whole = stored if finished is None else finished.unionByName(stored)
        overfull = durable(stored.groupBy("path").count().where(F.col("count") > capacity).select("path"))
        if overfull.isEmpty():
            return whole, levels
        vantage = stored.join(overfull, "path").groupBy("path").agg(F.min_by("fp", F.xxhash64("fp", F.lit(len(levels)))).alias("vantage"))
        counts = (
            stored.join(durable(vantage), "path")
            .groupBy("path", "vantage", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).alias("d"))
            .count()
        )
        # the border is the distance that divides most evenly with both sides non-empty
        per_node = counts.groupBy("path", "vantage").agg(F.sort_array(F.collect_list(F.struct("d", "count"))).alias("c"))
        border = F.expr(
            """aggregate(slice(c, 1, size(c) - 1),
                 named_struct('seen', 0L, 'at', -1, 'best', 9223372036854775807L),
                 (s, x) -> named_struct('seen', s.seen + x.count,
                    'at', IF(abs(2 * (s.seen + x.count) - total) < s.best, x.d, s.at),
                    'best', least(s.best, abs(2 * (s.seen + x.count) - total))),
                 s -> s.at)"""
        )
        nodes = durable(
            per_node.withColumn("total", F.expr("aggregate(c, 0L, (s, x) -> s + x.count)"))
            .withColumn("border", border)
            .where("border >= 0")  # one distance only: a leaf for good, which its tiles divide
            .select("path", "vantage", "border")
        )
        if nodes.isEmpty() or len(levels) == 61:  # paths are 63 bits long; tiles divide what is left
            return whole, levels
        levels.append(nodes)
        at_node = stored.join(nodes.select("path"), "path", "left_semi")
        done = stored.join(nodes.select("path"), "path", "left_anti")
        finished = done if finished is None else finished.unionByName(done)
        stored = durable(_descend(at_node, nodes, 0))


def masks(bits: int, most: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``most`` ones."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)


def blocks(radius: int, bits: int) -> list[tuple[int, int, int]]:
    """``(shift, width, most)`` of blocks of at most ``bits`` bits: words within ``radius``
    differ in at most ``most`` bits in one of them, as the sum of ``most + 1`` exceeds the radius."""
    starts = np.cumsum((0, *BLOCKS)).tolist()
    found = [(s, min(w, bits), (radius - k) // len(BLOCKS)) for k, (s, w) in enumerate(zip(starts, BLOCKS))]
    return [x for x in found if x[2] >= 0]


def near_in_memory(fp: np.ndarray, other: np.ndarray, radius: int, same: bool, scan: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``fp``, of ``other``) within ``radius``, each once, in
    chunks of bounded size; with ``same`` the two are one array and pairs have
    the first index greater. Small inputs are scanned, others filtered by blocks."""
    if not len(fp) or not len(other):
        return
    if len(fp) * len(other) <= scan or radius // len(BLOCKS) > 3:
        step = max(1, 131_072 // len(fp))
        for at in range(0, len(other), step):
            j, i = np.nonzero(np.bitwise_count(other[at : at + step, None] ^ fp[None]) <= radius)
            j += at
            keep = i > j if same else slice(None)
            yield i[keep], j[keep]
        return
    # some 32 words a key, so that a comparison of arrays outweighs its call
    parts = blocks(radius, max(4, len(other).bit_length() - 6))
    words = [np.uint64(((1 << w) - 1) << s) for s, w, _ in parts]
    cells, counts = np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8)
    found, size = [], 0
    for k, (shift, width, most) in enumerate(parts):
        sides = []
        for x in (fp,) if same else (fp, other):
            key = ((x & words[k]) >> np.uint64(shift)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            many = np.bincount(key, minlength=1 << width)
            sides.append((x[order], order, many, np.cumsum(many) - many))
        (mine, my_order, my_many, my_start), (theirs, their_order, their_many, their_start) = sides[0], sides[-1]
        apart_by = masks(width, most)
        for v in np.flatnonzero(my_many).tolist():
            near = apart_by ^ v
            if same:
                near = near[near >= v]  # each two keys meet once
            near = near[their_many[near] > 0]
            if not len(near):
                continue
            start, upto = their_start[near], np.cumsum(their_many[near])
            theirs_near = np.concatenate([theirs[a:b] for a, b in zip(start.tolist(), (start + their_many[near]).tolist())])
            first, last = int(my_start[v]), int(my_start[v] + my_many[v])
            wide = min(len(theirs_near), CELLS)
            high = CELLS // wide
            for at in range(first, last, high):
                rows = mine[at : min(at + high, last), None]
                for left in range(0, len(theirs_near), wide):
                    columns = theirs_near[None, left : left + wide]
                    shape = (len(rows), columns.shape[1])
                    apart = np.bitwise_xor(rows, columns, out=cells[: shape[0] * shape[1]].reshape(shape)).ravel()
                    hit = np.flatnonzero(np.bitwise_count(apart, out=counts[: len(apart)]) <= radius)
                    # a pair counts in the first of the blocks that would find it
                    for before in range(k):
                        hit = hit[np.bitwise_count(apart[hit] & words[before]) > parts[before][2]]
                    if not len(hit):
                        continue
                    i, j = np.divmod(hit, shape[1])
                    j += left
                    of = np.searchsorted(upto, j, "right")
                    i, j = my_order[at + i], their_order[start[of] + j - (upto[of] - their_many[near[of]])]
                    if same:
                        keep = (near[of] != v) | (i > j)
                        i, j = np.maximum(i, j)[keep], np.minimum(i, j)[keep]
                    found.append((i, j))
                    size += len(i)
                    if size >= CHUNK:
                        yield tuple(map(np.concatenate, zip(*found)))
                        found, size = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def _meet(radius: int):
    """Links and local roots of the fingerprints of one tile of a leaf (side 0)
    and one that meets it (side 1), or of the tile itself."""

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        group = group.iloc[np.argsort(group.side.to_numpy(), kind="stable")]
        left = int((group.side == 0).sum())
        fp, chk = group.fp.to_numpy().view(np.uint64), group.chk.to_numpy().view(np.uint64)
        copies = group.copies.to_numpy(np.int64)
        links, root = np.zeros(len(group), np.int64), np.arange(len(group))
        for i, j in near_in_memory(fp[:left], fp[:left] if same else fp[left:], radius, same):
            if not same:
                j = j + left
            fit = np.bitwise_count(chk[i] ^ chk[j]) <= CONFIRM
            i, j = i[fit], j[fit]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            unite(root, i, j)
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": group.node.to_numpy()[at], "links": links[at], "a": group.rep.to_numpy()[at], "b": group.rep.to_numpy()[root[at]]})

    return work


def linked(unique: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """``(node, links, a, b)`` of ``unique`` (node, rep, fp, chk, copies): parts of
    the number of documents that a node's are linked to, outside the node, and
    edges between representatives that connect what is linked. Exact. Without a ``shard``
    its size is chosen by the number of rows."""
    if shard is None:
        shard = min(SHARD, max(LEAST, unique.count() // 3))
    placed = unique.select("node", "rep", "fp", "chk", "copies", F.lit(1).cast("bigint").alias("path"))
    stored, levels = _grow(placed, shard)
    queries = stored.withColumnRenamed("path", "own").withColumn("path", F.lit(1).cast("bigint"))
    for nodes in levels:
        queries = _descend(queries, nodes, radius)
    # leaves are ordered, so that each pair of leaves meets once
    visits = queries.where("path > own").drop("own")

    # A leaf and its visitors lie in tiles of bounded size. A tile of the leaf meets
    # itself, the leaf's later tiles and all tiles of visitors.
    kept = durable(stored.groupBy("path").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("s")))
    tiled = durable(visits.groupBy("path").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("g")).join(kept, "path", "right").withColumn("g", F.coalesce("g", F.lit(0))))
    tile = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    home = stored.join(tiled, "path").withColumn("t", tile("s"))
    guests = visits.join(tiled, "path").withColumn("t", F.col("s") + tile("g"))
    columns = ["node", "rep", "fp", "chk", "copies", "path"]
    first = home.select(*columns, F.col("t").alias("i"), F.explode(F.expr("sequence(t, s + g - 1)")).alias("j"), F.lit(0).alias("side"))
    second = home.where("t > 0").select(*columns, F.explode(F.expr("sequence(0, t - 1)")).alias("i"), F.col("t").alias("j"), F.lit(1).alias("side"))
    third = guests.select(*columns, F.explode(F.expr("sequence(0, s - 1)")).alias("i"), F.col("t").alias("j"), F.lit(1).alias("side"))
    meetings = first.unionByName(second).unionByName(third)
    return meetings.groupBy("path", "i", "j").applyInPandas(_meet(radius), "node bigint, links bigint, a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """``(doc_id, class_id, links, kept)``, a row a document.

    ``class_id`` is the smallest id of the document's class, all documents that
    it reaches by links; ``links`` the number of documents that it is linked
    with itself, copies included; ``kept`` is true for the one that stands for its class. A
    document without a word is a class of its own, without links. Rows that repeat an
    id with one text are one document; with different texts, the id's links are the sum of
    its texts' and its classes are one. Rows with a null id are left out. An
    empty table gives an empty one. Nothing is capped: equal fingerprints are
    one node with a number of copies, and all pairs of nodes within the radius count.
    """
    prints = durable(fingerprints(docs, id_col, text_col).distinct())
    # numbered once, in a written table; copies are counted before anything moves
    unique = durable(prints.where("fp IS NOT NULL").groupBy("fp", "chk").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    found = durable(linked(unique, radius, shard))
    several = prints.where("fp IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    placed = prints.join(unique, ["fp", "chk"], "left")
    bound = placed.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = components(found.select("a", "b").unionByName(bound), "a", "b").withColumnRenamed("id", "rep")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = durable(unique.join(links, "node", "left").join(classes, "rep", "left").select(
        "fp", "chk", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    ))
    rows = prints.join(nodes, ["fp", "chk"], "left").select("doc_id", "class_id", "links")
    each = rows.groupBy("doc_id").agg(F.coalesce(F.min("class_id"), "doc_id").alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    return each.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """``docs`` with one document (the smallest id) of each class. Rows without a
    word or with a null id stay. Of rows that repeat an id that stays, all stay.
    Extra columns pass through untouched. An empty table gives an empty one."""
    return without(docs, near_duplicates(docs, id_col, text_col, radius, shard).where("NOT kept").select("doc_id"), id_col)
