"""Language identification by words first, backing off to character n-grams.

Training counts the words of a bounded sample of labelled documents. A word that
the model knows scores its smoothed log frequency in each language. A word it
doesn't know scores the mean over those of its character n-grams of the longest
length that has any known one, with the word's borders marked: first 5-grams,
then 4-grams and so on. A word with no known n-gram at all is not recognised and
scores nothing. A document's score for a language is the sum over its words.

Scores are integers (millionths of a nat), so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, durable, without

#: Bound on the labelled documents that train each language.
TRAIN_DOCS = 400
#: Most frequent words, and n-grams of each length, kept per language.
TOP_WORDS = 20_000
TOP_GRAMS = 10_000
LONGEST = 5
#: Nats per word that an n-gram's evidence is lower than a whole word's.
BACKOFF = 400_000
#: A document is rejected below this mean lead per word (millionths of a nat) of
#: the best language over the second, or if fewer words than this share are recognised.
MIN_LEAD = 50_000
MIN_KNOWN = 0.5
#: Words whose scores a Python worker remembers, beyond those of one chunk.
MEMO = 400_000
#: Characters of text that are scored at once, but for a longer document, and new words.
CHUNK, NEW = 1 << 18, 1 << 13


@dataclass
class Model:
    """``units[0]`` numbers the words, ``units[n]`` the n-grams; ``logp`` has a row
    of scores by language for each number."""

    langs: list[str]
    units: list[dict[str, int]] = field(default_factory=lambda: [{} for _ in range(LONGEST + 1)])
    logp: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    def score(self, word: str) -> np.ndarray | None:
        """Scores by language, or None for a word that isn't recognised."""
        known = self.units[0].get(word)
        if known is not None:
            return self.logp[known]
        marked = f"<{word}>"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            find = self.units[n].get
            hits = [g for g in [find(marked[i : i + n]) for i in range(len(marked) - n + 1)] if g is not None]
            if hits:
                return np.floor(self.logp[hits].sum(axis=0) / len(hits)).astype(np.int64) - BACKOFF
        return None


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Grams:
    """A model's n-grams as sorted whole numbers, to look up those of many words at once.
    Each character of the model's has a number from 1, and a gram those of its
    characters in ``bits`` bits each; other characters are 0, which no gram has."""

    logp: np.ndarray
    bits: int
    number: np.ndarray
    keys: list[np.ndarray]
    rows: list[np.ndarray]

    @staticmethod
    def of(model: Model) -> Grams | None:
        """None if the model has too many characters for 63 bits a gram."""
        points = [codepoints("".join(units)) for units in model.units[1:]]
        alphabet = np.unique(np.concatenate(points))
        bits = max(1, len(alphabet).bit_length())
        if bits * LONGEST > 63:
            return None
        number = np.zeros(0x110000, np.int32)
        number[alphabet] = np.arange(1, len(alphabet) + 1)
        found = Grams(model.logp, bits, number, [], [])
        for n, (units, each) in enumerate(zip(model.units[1:], points), 1):
            keys = found.packed(number[each].astype(np.int64), np.arange(0, len(each), n), n)
            order = np.argsort(keys)
            found.keys.append(keys[order])
            found.rows.append(np.fromiter(units.values(), np.int64, len(units))[order])
        return found

    def packed(self, numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The n-grams that begin ``at`` these places."""
        key = np.zeros(len(at), np.int64)
        for k in range(n):
            key = key << self.bits | numbers[at + k]
        return key

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``Model.score`` gives for words that aren't the model's: rows of
        scores, and which words are recognised."""
        numbers = self.number[codepoints("<" + "><".join(words) + ">")].astype(np.int64)
        long = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word, end = np.repeat(np.arange(len(words)), long), np.repeat(np.cumsum(long), long)
        scores, told = np.zeros((len(words), self.logp.shape[1]), np.int64), np.zeros(len(words), bool)
        at = np.arange(len(numbers))
        for n in range(LONGEST, 0, -1):
            keys = self.keys[n - 1]
            fits = at[at + n <= end[at]]
            if not len(keys) or not len(fits):
                continue
            key = self.packed(numbers, fits, n)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            of = word[fits[hit]]  # in order
            if not len(of):
                continue
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            sums = np.add.reduceat(self.logp[self.rows[n - 1][place[hit]]], starts, axis=0)
            scores[of[starts]] = np.floor(sums / np.diff(starts, append=len(of))[:, None]).astype(np.int64) - BACKOFF
            told[of] = True
            at = at[~told[word[at]]]
        return scores, told


class Scores(dict):
    """Word -> row of a table of scores (row 0: not recognised), remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.grams = Grams.of(model)
        self.start()

    def start(self) -> None:
        self.clear()
        self.table = np.zeros((4096, len(self.model.langs)), np.int64)
        self.used = 1

    def learn(self, words: list[str]) -> None:
        """Add those of the words that aren't there, many in one array operation."""
        new = [w for w in set(words) if w not in self]
        for at in range(0, len(new), NEW):
            self._add(new[at : at + NEW])

    def _add(self, new: list[str]) -> None:
        if self.grams is None:
            each = [self.model.score(w) for w in new]
            told = np.array([x is not None for x in each])
            scores = np.array([self.table[0] if x is None else x for x in each])
        else:
            rows = np.fromiter((self.model.units[0].get(w, -1) for w in new), np.int64, len(new))
            scores, told = self.model.logp[rows], rows >= 0
            if not told.all():
                at = np.flatnonzero(~told)
                scores[at], told[at] = self.grams.score([new[i] for i in at.tolist()])
        count = int(np.count_nonzero(told))
        used = self.used + count
        if used > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), used - len(self.table)), self.table.shape[1]), np.int64)])
        self.table[self.used : used] = scores[told]
        row = np.zeros(len(new), np.int64)
        row[told] = np.arange(self.used, used)
        self.used = used
        self.update(zip(new, row.tolist()))


def sample(docs: DataFrame, per_lang: int = TRAIN_DOCS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, text)`` of at most ``per_lang`` labelled documents a language,
    those with the smallest MD5 of their id; rows with a null are not used."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    # ids are chosen first, so that texts don't travel
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = keyed.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang)
    return keyed.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).select("lang", "text")


def counts(labelled: DataFrame, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> DataFrame:
    """``(n, unit, logp)`` of words (n = 0) and n-grams: the most frequent units of
    each language, with smoothed log frequencies in millionths in every language,
    as (lang, logp) pairs in the order of languages."""
    words = (
        labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("unit"))
        .groupBy("lang", "unit").agg(F.count("*").alias("c"))
    )
    marked = words.select("lang", F.concat(F.lit("<"), "unit", F.lit(">")).alias("m"), "c")
    # slices of an array of characters: substrings of a very long word would take
    # time in proportion to its length each
    sliced = F.expr("transform(sequence(1, length(m) - n + 1), i -> array_join(slice(chars, i, n), ''))")
    grams = marked.select("lang", "c", "m", F.split("m", "").alias("chars"), F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("m")))).alias("n"))
    grams = grams.select("lang", "c", "n", F.explode(sliced).alias("unit")).groupBy("n", "lang", "unit").agg(F.sum("c").alias("c"))
    units = words.select(F.lit(0).alias("n"), "lang", "unit", "c").unionByName(grams)
    totals = units.groupBy("n", "lang").agg(F.sum("c").alias("total"))
    order = Window.partitionBy("n", "lang").orderBy(F.desc("c"), "unit")
    top = units.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams))
    kept = top.select("n", "unit").distinct()
    size = kept.groupBy("n").agg(F.count("*").alias("size"))
    # every language has a total for every length, if only 0
    grid = size.crossJoin(words.select("lang").distinct()).join(totals, ["n", "lang"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    every = kept.join(grid, "n").join(units, ["n", "lang", "unit"], "left")
    logp = F.floor(F.log((F.coalesce("c", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("size"))) * 1e6 + 0.5).cast("bigint")
    return every.groupBy("n", "unit").agg(F.sort_array(F.collect_list(F.struct("lang", logp.alias("logp")))).alias("logp"))


def train(labelled: DataFrame, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> Model:
    """A model of ``(lang, text)`` rows. Its size is bounded by the two parameters
    and the number of languages, whatever the sample. A language without a word takes
    no part; no words at all give a model without languages."""
    table = durable(counts(labelled, top_words, top_grams))
    first = table.select("logp.lang").first()
    model = Model([] if first is None else first[0])
    rows = table.select("n", "unit", "logp.logp").orderBy("n", "unit").toArrow()
    for i, (n, unit) in enumerate(zip(rows.column("n").to_pylist(), rows.column("unit").to_pylist())):
        model.units[n][unit] = i
    if rows.num_rows:
        model.logp = rows.column("logp").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_lead: int = MIN_LEAD, min_known: float = MIN_KNOWN) -> DataFrame:
    """``(doc_id, lang_pred, score, lead, words, known, kept)`` for every row.

    ``lang_pred`` is the language of the highest score, the first by name among
    equals; ``lead`` the excess over the second (0 with one language). Null and
    empty texts, and texts without a recognised word, have a null language,
    score 0 and are not kept. Rows with a null or repeated id are scored like
    any other. Whole texts are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.units, model.logp))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        memo = Scores(model)
        find = WORD.findall

        def scored(keys: pa.Array, words: list[list[str]]) -> pa.RecordBatch:
            if len(memo) >= MEMO:
                memo.start()
            every = list(chain.from_iterable(words)) if model.langs else []
            memo.learn(every)
            many = np.fromiter(map(len, words), np.int64, len(words))
            known, score, lead = (np.zeros(len(words), np.int64) for _ in range(3))
            best = np.full(len(words), -1, np.int64)
            if every:
                rows = np.fromiter(map(memo.__getitem__, every), np.int64, len(every))
                some = many > 0
                starts = (np.cumsum(many) - many)[some]
                known[some] = np.add.reduceat(rows > 0, starts, dtype=np.int64)
                told = known > 0
                total = np.add.reduceat(memo.table[rows], starts, axis=0)[told[some]]
                best[told] = first = total.argmax(axis=1)
                each = np.arange(len(total))
                score[told] = total[each, first]
                if total.shape[1] > 1:
                    total[each, first] = np.iinfo(np.int64).min
                    lead[told] = score[told] - total.max(axis=1)
            kept = (known > 0) & (lead >= min_lead * known) & (known >= min_known * many)
            langs = pa.array([model.langs[k] if k >= 0 else None for k in best.tolist()], pa.string())
            return pa.RecordBatch.from_arrays(
                [keys, langs, *map(pa.array, (score, lead, many, known, kept))],
                ["doc_id", "lang_pred", "score", "lead", "words", "known", "kept"],
            )

        for batch in batches:
            words: list[list[str]] = []
            at, long = 0, 0
            for text in batch.column(1):
                text = text.as_py() or ""
                words.append(find(text.lower()))
                long += len(text)
                if long >= CHUNK:
                    yield scored(batch.column(0).slice(at, len(words)), words)
                    at, words, long = at + len(words), [], 0
            yield scored(batch.column(0).slice(at, len(words)), words)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, lang_pred string, score bigint, lead bigint, words bigint, known bigint, kept boolean")


def identify_trained_here(docs: DataFrame) -> DataFrame:
    """``identify`` with a model of a bounded sample of the table's own labels."""
    return identify(docs, train(durable(sample(docs))))


def keep_identified(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose language isn't identified. With one
    id on several rows, all stay if any of them is identified; rows with a null
    id go."""
    model = model or train(durable(sample(docs)))
    gone = identify(docs, model, id_col, text_col).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept AND doc_id IS NOT NULL")
    return without(docs.where(F.col(f"`{id_col}`").isNotNull()), gone.select("doc_id"), id_col)
