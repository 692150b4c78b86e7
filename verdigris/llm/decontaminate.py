"""Benchmark decontamination by canonical templates.

Texts become templates: a number turns into <NUM>, a unit of measure right after
a number into <UNIT>, a capitalised word that doesn't begin a sentence into
<NAME>; every other word is lower-cased. Windows of ``WINDOW`` consecutive
template tokens, at least half of them literal, are joined by hash between
documents and benchmark items. A document and an item that meet at one alignment
(offset) must be consistent there: an item's value has one value in the document,
and two names don't become one ("3 ... 3" may become "7 ... 7" but not "7 ... 8",
"3 ... 5" may become "4 ... 4"). A word of ``OPENERS`` is no name and stands for
itself. Windows that hold a value that breaks this are dropped. A document leaks
an item if the windows left at any alignment cover at least ``COVERAGE`` of the
item's windows.

Whether a capitalised word at the start of a sentence is a name can't be told, so
windows are compared in three readings: with such words as literals, with them as
names, and with all names as literals, whatever their case. An item without a
usable window in any reading (slot-heavy, or shorter than ``SHORTEST``) is searched as
a whole, each of its tokens literal, so that copies are found.

Documents' windows pass a bitmap of the benchmark's hashes before they leave
their task, so the join sees few of them; the bitmap's size is a parameter and
doesn't grow with either side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, without

WINDOW = 8
COVERAGE = 0.5
#: Items with fewer tokens than this are too short for templates and searched verbatim.
SHORTEST = 5
#: log2 of the bits of the bitmap (here 2 MiB).
BITMAP = 24
MEMO = 400_000

UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur "
    "percent degree degrees mph kmh kph w kw kwh v hz khz mhz ghz kb mb gb tb".split()
)
#: Words that open sentences and questions and are never names.
OPENERS = frozenset(
    "a an the this that these those there here it its he she they we you i his her their our your my who whom whose what which when where why how "
    "is are was were be been am do does did can could will would shall should may might must has have had let if and or but so then thus as at by for from in into of on to "
    "with without after before during since until while because although though each every all any some many most more no not nor both either one two three "
    "find compute calculate determine evaluate solve given suppose assume consider name list write choose explain describe add "
    "der die das ein eine wer was wann wo warum wie ist sind in im am el la los las un una qué quién cuándo dónde cómo es son en le les une qui que quand où comment est sont dans".split()
)
#: Words, numbers, ends of sentences.
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]+")
#: Tokens whose windows are hashed at once.
BLOCK = 1 << 16

_NUM, _LITERAL, _END = 0, 1, 2
_M = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(64)]


class Tokens(dict):
    """Token -> row of (class, is capitalised, is a unit, literal hash), remembered up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.start()

    def start(self) -> None:
        self.clear()
        self.kind = np.zeros(4096, np.int8)
        self.capital = np.zeros(4096, bool)
        self.unit = np.zeros(4096, bool)
        self.hash = np.zeros(4096, np.uint64)

    def __missing__(self, token: str) -> int:
        row = len(self)
        if row == len(self.kind):
            for name in ("kind", "capital", "unit", "hash"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        first = token[0]
        low = token.lower()
        self.kind[row] = _NUM if "0" <= first <= "9" else _END if first in ".!?\n" else _LITERAL
        # all capitals of two letters or more are shouting or acronyms, not names
        self.capital[row] = first != first.lower() and (len(token) == 1 or token != token.upper())
        self.unit[row] = low in UNITS
        self.hash[row] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        self[token] = row
        return row


#: Number, unit, name, capitalised word at the start of a sentence.
NUM, UNIT, NAME, START = 0, 1, 2, 3
_SLOT_HASH = np.array([xxhash.xxh3_64_intdigest(x) for x in ("\0NUM", "\0UNIT", "\0NAME", "\0NAME")], np.uint64)

#: How windows are compared: by template, with capitals that begin sentences as
#: names too, with names as literals, with all tokens as literals.
TEMPLATE, TITLED, FOLDED, VERBATIM = 0, 1, 2, 3
#: The last slot type that each of them replaces.
REPLACED = (NAME, START, UNIT, -1)


def reading(kind: int, plain: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and slot types of the tokens as ``kind`` compares them; a type of -1
    is a literal."""
    slot = np.where(slot > REPLACED[kind], np.int8(-1), slot)
    return np.where(slot >= 0, _SLOT_HASH[slot], plain), slot


def literals(texts: list[str], memo: Tokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The texts' tokens without sentence ends, one after the other, their own
    hashes and slot types, and where each text's begin (and the last one's end)."""
    tokens: list[str] = []
    ends = [0]
    for text in texts:
        tokens.append("\n")  # a text begins a sentence
        tokens += TOKEN.findall(text)
        ends.append(len(tokens))
    rows = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
    kind = memo.kind[rows]
    before = np.concatenate([np.array([_END], np.int8), kind[:-1]])
    slot = np.full(len(rows), -1, np.int8)
    slot[memo.capital[rows]] = NAME
    slot[(slot == NAME) & (before == _END)] = START
    slot[memo.unit[rows] & (before == _NUM)] = UNIT
    slot[kind == _NUM] = NUM
    inside = kind != _END
    starts = np.concatenate([[0], np.cumsum(inside)])[ends]
    at = np.flatnonzero(inside)
    return [tokens[i] for i in at], memo.hash[rows[at]], slot[at], starts


def windows(hashes: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` with at least half literals,
    those across the border of two texts included."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total += hashes[k : k + count] * (_M[k] if k < len(_M) else np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)))
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    literal = np.concatenate([[0], np.cumsum(slot < 0)])
    enough = 2 * (literal[size:] - literal[:-size]) >= size
    at = np.flatnonzero(enough)
    return at, total[at]


def _slots(tokens: list[str], slot: np.ndarray, start: int, size: int) -> list[str]:
    return [f"{min(int(slot[i]), NAME)}:{tokens[i].lower()}" for i in range(start, start + size) if slot[i] >= 0]


def _rows(key: list, columns: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([key, *columns], types)], ["id", "kind", "size", "pos", "total", "hash", "slots"])


_SCHEMA = "id bigint, kind int, size int, pos int, total int, hash bigint, slots array<string>"


def _item_windows(window: int, shortest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for batch in batches:
            key: list = []
            cols: list[list] = [[], [], [], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, plain, slots, _ = literals([text], memo)
                usable = False
                for kind in (TEMPLATE, TITLED, FOLDED, VERBATIM):
                    size = len(tokens) if kind == VERBATIM else min(window, len(tokens))
                    if not size or (kind == VERBATIM and usable) or (kind != VERBATIM and size < shortest):
                        continue
                    hashes, slot = reading(kind, plain, slots)
                    starts, values = windows(hashes, slot, size)
                    usable = usable or len(starts) > 0
                    for p, h in zip(starts.tolist(), values.view(np.int64).tolist()):
                        key.append(item)
                        for c, v in zip(cols, (kind, size, p, len(starts), h, _slots(tokens, slot, p, size))):
                            c.append(v)
            yield _rows(key, cols)

    return work


def _doc_windows(shared, sizes: list[tuple[int, int]], bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - bits)
        memo = Tokens()

        def found(docs: list, texts: list[str]) -> pa.RecordBatch:
            if len(memo) >= MEMO:
                memo.start()
            tokens, plain, slots, begins = literals(texts, memo)
            key: list = []
            cols: list[list] = [[], [], [], [], [], []]
            readings = {kind: reading(kind, plain, slots) for kind, _ in sizes}
            for kind, size in sizes:
                hashes, slot = readings[kind]
                starts, values = windows(hashes, slot, size)
                at = values >> shift
                hit = np.flatnonzero((bitmap[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                text = np.searchsorted(begins, starts[hit], "right") - 1
                whole = starts[hit] + size <= begins[text + 1]
                for p, h, t in zip(starts[hit][whole].tolist(), values[hit][whole].view(np.int64).tolist(), text[whole].tolist()):
                    key.append(docs[t])
                    for c, v in zip(cols, (kind, size, p - int(begins[t]), 0, h, _slots(tokens, slot, p, size))):
                        c.append(v)
            return _rows(key, cols)

        for batch in batches:
            docs: list = []
            texts: list[str] = []
            long = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                texts.append(text.as_py())
                long += len(texts[-1])
                if long >= 4 * BLOCK:  # about BLOCK tokens at most
                    yield found(docs, texts)
                    docs, texts, long = [], [], 0
            yield found(docs, texts)

    return work


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          window: int = WINDOW, coverage: float = COVERAGE, shortest: int = SHORTEST, bits: int = BITMAP) -> DataFrame:
    """``(doc_id, item_id, matched, total, coverage, reparameterised)`` for every
    document that leaks an item.

    Items shorter than the window are searched by one window of their own length.
    A pair has the counts of the first reading in which it leaks; an item that is
    searched verbatim has 1 of 1.
    Null ids, and null or empty texts on either side, match nothing. Rows that
    repeat an id count as one document or item. Empty tables give no rows.
    ``reparameterised`` says that a replaced value differs from the item's.
    """
    spark = docs.sparkSession
    items = durable(
        benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text"))
        .where("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
        .mapInArrow(_item_windows(window, shortest), _SCHEMA)
    )
    # The bitmap is put together by Spark: one word of 64 bits a row, OR-ed.
    cell = F.expr(f"shiftrightunsigned(hash, {64 - bits})")
    words = items.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 63 AS INT))")).alias("b")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words.w.to_numpy(np.int64)] = words.b.to_numpy(np.int64)
    sizes = sorted((r[0], r[1]) for r in items.select("kind", "size").distinct().collect())
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    found = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .where("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
        .mapInArrow(_doc_windows(shared, sizes, bits), _SCHEMA)
        .select(F.col("id").alias("doc_id"), "kind", F.col("size"), F.col("pos").alias("dpos"), "hash", F.col("slots").alias("dslots"))
    )
    met = found.join(items.select(F.col("id").alias("item_id"), "kind", "size", F.col("pos").alias("ipos"), "total", "hash", F.col("slots").alias("islots")), ["kind", "size", "hash"])
    met = met.where("size(dslots) = size(islots)").withColumn("offset", F.col("dpos") - F.col("ipos"))
    # an alignment has no more windows than the item
    aligned = met.groupBy("kind", "doc_id", "item_id", "offset").agg(F.collect_set(F.struct("ipos", "islots", "dslots")).alias("w"), F.max("total").alias("total"))
    openers = ", ".join(f"'{NAME}:{w}'" for w in sorted(OPENERS))
    # a slot pair: the item's value and the document's, both with their type
    aligned = aligned.withColumn("pairs", F.expr("array_distinct(flatten(transform(w, x -> arrays_zip(x.islots, x.dslots))))"))
    # every break has a changed value in it, which copies don't have
    aligned = aligned.withColumn("broken", F.expr(f"""IF(NOT exists(pairs, p -> p.islots <> p.dslots), CAST(array() AS array<string>), transform(filter(pairs, p ->
        exists(pairs, q -> q.islots = p.islots AND q.dslots <> p.dslots OR q.dslots = p.dslots AND q.islots <> p.islots AND p.islots LIKE '{NAME}:%')
        OR p.islots <> p.dslots AND (p.islots IN ({openers}) OR p.dslots IN ({openers}))), p -> p.islots))"""))
    kept = aligned.withColumn("w", F.expr("filter(w, x -> NOT arrays_overlap(x.islots, broken))")).where("size(w) > 0")
    joined = kept.groupBy("kind", "doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("w.ipos")))).cast("bigint").alias("matched"),
        F.max("total").cast("bigint").alias("total"),
        F.bool_or(F.expr("exists(w, x -> x.islots <> x.dslots)")).alias("reparameterised"),
    )
    share = F.col("matched") / F.col("total")
    reached = joined.where(share >= coverage).groupBy("doc_id", "item_id").agg(F.min_by(F.struct("matched", "total", "reparameterised"), "kind").alias("r"))
    return reached.select("doc_id", "item_id", "r.*").select("doc_id", "item_id", "matched", "total", F.round(share, 4).alias("coverage"), "reparameterised")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that leak an item. Rows with a null id, and
    null or empty texts, stay; of rows that repeat an id all go if one leaks. An empty table on
    either side removes nothing. Extra columns pass through untouched."""
    return without(docs, leaks(docs, benchmark, id_col, **options).select("doc_id"), id_col)
