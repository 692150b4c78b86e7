"""Quality by co-training of a text view and a metadata view.

The text view sees which words a document has; the metadata view its source,
language and shape (length, lines, letters, symbols, repetition). Words and
shape are taken from every document once and written. Both views learn from all
labelled documents but those held out: the text view from the documents of either
class that hold a word, the metadata view from the classes' moments (a linear
discriminant). Over rounds, each view labels every unlabelled document of which it is
confident, and these join the other view's counts or moments, all summed where
the documents lie. Of either class they weigh a given part of its labelled
documents at most, so that many like ones don't drown these. At the end both views are
calibrated and combined on documents that were held out, and all are scored.

What comes to the driver is bounded: counts by ``UNITS`` hashed words, moments,
and a sample of labelled documents that fits a view's last few weights.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, durable, key_hash

#: About how many labelled documents (chosen by a hash of their id) fit the weights
#: of evidence and calibrate; all others that are labelled are counted only.
LABELLED = 16_000
ROUNDS = 2
#: Probability from which a view's label of a document is trusted.
CONFIDENT = 0.97
ENOUGH = 10
#: Most that all pseudo-labelled documents of a class weigh beside its labelled ones.
PSEUDO = 0.1
#: Documents that a word must be in to be used.
SEEN = 4
HELD_OUT = 0.25
KEEP = 0.5
MEMO = 400_000
#: Buckets of the one-hot source and language, and bits of a word's hash.
SOURCES, LANGS, BITS = 32, 8, 22
UNITS = 1 << BITS
#: Labels up to which they are sent to every task (16 MB).
FEW = 1_000_000
#: Word numbers that a task holds before it sums them.
HELD = 4_000_000


class Units(dict):
    """Word -> its number, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = unit(word)
        return value


def unit(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def shape(text: str, counts: Counter, source: str | None, lang: str | None) -> np.ndarray:
    """The metadata view's features."""
    n = len(text)
    words = sum(counts.values())
    lines = text.count("\n") + 1
    letters = sum(len(w) * c for w, c in counts.items())
    blanks = text.count(" ") + lines - 1
    low = text.lower()
    if len(low) == n:
        points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        upper = int(np.count_nonzero(points(text) != points(low)))
    else:  # a few capitals turn into two characters
        upper = sum(c != c.lower() for c in text)
    hot = np.zeros(SOURCES + LANGS)
    hot[zlib.crc32((source or "").encode()) % SOURCES] = 1
    hot[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    most = max(counts.values(), default=0)
    return np.concatenate([
        [1.0, math.log1p(n), math.log1p(words), math.log1p(n / lines), upper / max(1, letters), (n - letters - blanks) / max(1, n),
         len(counts) / max(1, words), math.sqrt(most / max(1, words)), letters / max(1, words) / 10.0, float(words == 0)],
        hot,
    ])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    w = np.ones(len(x)) if w is None else w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * len(x) * 1e-2 * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + (ridge * len(x) * 1e-2 + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Features of the text view.
WIDTH = 6


def evidence(o: np.ndarray) -> np.ndarray:
    """The text view's features of a document's log odds: their mean, that of the three
    worst, how far the worst falls below two bounds, and the number below the first."""
    if not len(o):
        return np.array([1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    worst = np.sort(o)[:3]
    return np.array([1.0, float(o.mean()), float(worst.mean()), max(0.0, -2.0 - float(worst[0])), max(0.0, -3.5 - float(worst[0])), math.log1p(np.count_nonzero(o < -2.0))])


def known(words: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log odds of the words that have any (the others' are NaN)."""
    o = odds[words]
    return o[~np.isnan(o)]


def word_odds(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Log of P(word | good) / P(word | bad), NaN for words of few documents."""
    odds = np.log((np.maximum(good, 0.0) + 0.5) / (n_good + 1.0)) - np.log((np.maximum(bad, 0.0) + 0.5) / (n_bad + 1.0))
    return np.where(good + bad >= SEEN, odds, np.nan)


#: Length of the metadata view's features.
META = 10 + SOURCES + LANGS


@dataclass
class Moments:
    """Number, sum and sum of products of each class's features (row 0: bad)."""

    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray

    @staticmethod
    def none() -> Moments:
        return Moments(np.zeros(2), np.zeros((2, META)), np.zeros((2, META, META)))

    def add(self, features: np.ndarray, label: np.ndarray) -> None:
        for c in (0, 1):
            own = features[label == c].astype(np.float64)
            self.n[c] += len(own)
            self.x[c] += own.sum(axis=0)
            self.xx[c] += own.T @ own

    def with_weighted(self, other: Moments) -> Moments:
        w = weights(self.n, other.n)
        return Moments(self.n + w * other.n, self.x + w[:, None] * other.x, self.xx + w[:, None, None] * other.xx)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.n, self.x.ravel(), self.xx.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Moments:
        return Moments(flat[:2], flat[2 : 2 + 2 * META].reshape(2, META), flat[2 + 2 * META :].reshape(2, META, META))


def weights(labelled: np.ndarray, pseudo: np.ndarray) -> np.ndarray:
    """Weight of a pseudo-labelled document of each class."""
    return np.minimum(1.0, PSEUDO * labelled / np.maximum(pseudo, 1.0))


def discriminant(m: Moments, ridge: float = 1e-3) -> np.ndarray:
    """Direction that separates the classes' means best, by their common covariance."""
    mean = m.x / m.n[:, None]
    within = sum(m.xx[c] - m.n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)) / m.n.sum()
    return np.linalg.solve(within + ridge * (np.diag(np.diag(within)) + 1e-3 * np.eye(META)), mean[1] - mean[0])


def trusted(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bounds on ``p`` below and above which labels are right for at least
    ``CONFIDENT`` of the held-out documents there, of which there must be
    ``ENOUGH``. A view that can't tell a class (toxic texts by their shape, say)
    so never vouches for the other."""
    out = []
    for q, right in ((1 - p, y == 0), (p, y == 1)):
        order = np.argsort(-q, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(q) + 1)
        fit = np.flatnonzero((share >= CONFIDENT) & (q[order] >= CONFIDENT))
        out.append(float(q[order][fit[-1]]) if len(fit) and fit[-1] + 1 >= ENOUGH else 2.0)
    return 1 - out[0], out[1]


@dataclass
class Model:
    #: Numbers of the words that have log odds, and these.
    units: np.ndarray
    odds: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    #: Calibration of each view (intercept, slope), then weights of intercept, both calibrated logits and the lower of them.
    fit_text: np.ndarray
    fit_meta: np.ndarray
    both: np.ndarray | None = None
    #: Probabilities up to which, and from which, each view's labels are trusted (rows: text, metadata).
    sure: np.ndarray | None = None

    def dense(self) -> np.ndarray:
        odds = np.full(UNITS, np.nan, np.float32)
        odds[self.units] = self.odds
        return odds

    def logits(self, odds: np.ndarray, words: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of both views; ``odds`` is ``dense()``."""
        z = np.array([evidence(known(w, odds)) @ self.text for w in words]) if len(words) else np.zeros(0)
        m = features.astype(np.float64) @ self.meta
        return self.fit_text[0] + self.fit_text[1] * z, self.fit_meta[0] + self.fit_meta[1] * m

    def combined(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return chance(np.c_[np.ones(len(t)), t, m, np.minimum(t, m)] @ self.both)


FEATURES = "doc_id bigint, words array<int>, shape array<float>"


def features(docs: DataFrame) -> DataFrame:
    """``FEATURES`` of every row of (doc_id, text, source, lang): the sorted numbers of
    its distinct words and the metadata view's features. Null texts count as
    empty. Whole texts are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Units()
        for batch in batches:
            words, shapes = [], []
            for text, source, lang in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3))):
                text = text.as_py() or ""
                counts = Counter(WORD.findall(text.lower()))
                words.append(np.unique(np.fromiter(map(number.__getitem__, counts), np.int32, len(counts))))
                shapes.append(shape(text, counts, source, lang).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float32()))], ["doc_id", "words", "shape"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(work, FEATURES)


def _lists(column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The lists, their values one after the other, and their lengths."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])], values[offsets[0] : offsets[-1]], np.diff(offsets)


def _shapes(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), META)


_TALLY = "unit int, good bigint, bad bigint, moments array<double>"


def tally(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """What both views learn from ``rows`` (doc_id, words, shape, y): numbers of good and bad
    documents by word, and with number -1 those whose words are counted, beside the moments. Labels are ``y``, or with a
    ``model`` those of which its views are confident: the metadata's for
    words, the text's for moments."""
    shared = None if model is None else rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if shared is None else shared.value
        odds = None if model is None else model.dense()
        moments = Moments.none()
        held: tuple[list, list] = ([], [])
        size = 0
        counted = np.zeros(2, np.int64)

        def summed() -> pa.RecordBatch:
            (bad, b), (good, g) = (np.unique(np.concatenate([np.zeros(0, np.int32), *h]), return_counts=True) for h in held)
            both = np.union1d(bad, good)
            n = np.zeros((2, len(both)), np.int64)
            n[0, np.searchsorted(both, bad)] = b
            n[1, np.searchsorted(both, good)] = g
            return pa.RecordBatch.from_arrays([pa.array(both, pa.int32()), pa.array(n[1]), pa.array(n[0]), pa.nulls(len(both), pa.list_(pa.float64()))], ["unit", "good", "bad", "moments"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, flat, lengths = _lists(batch.column(1))
            shapes = _shapes(batch.column(2))
            if model is None:
                by_text = by_meta = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            else:
                by_text, by_meta = (np.where(p >= hi, 1.0, np.where(p <= lo, 0.0, np.nan)) for p, (lo, hi) in zip(map(chance, model.logits(odds, words, shapes)), model.sure))
            moments.add(shapes, by_text)
            counted += [np.count_nonzero(by_meta == 0), np.count_nonzero(by_meta == 1)]
            each = np.repeat(by_meta, lengths)
            for c in (0, 1):
                held[c].append(flat[each == c])
                size += len(held[c][-1])
            if size >= HELD:
                yield summed()
                held, size = ([], []), 0
        yield summed()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(counted[1:]), pa.array(counted[:1]), pa.array([moments.flat()], pa.list_(pa.float64()))], ["unit", "good", "bad", "moments"])

    return rows.select("doc_id", "words", "shape", "y").mapInArrow(work, _TALLY)


def _learned(labelled: DataFrame, pseudo: DataFrame | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Moments, np.ndarray]:
    """Numbers of words with enough documents, these documents of either class
    (pseudo-labelled ones weighted), the moments, and the numbers of documents."""
    def moments(table: DataFrame) -> Moments:
        total = Moments.none().flat()
        for row in table.where("unit = -1").select("moments").toLocalIterator():  # one a task
            total = total + np.array(row[0])
        return Moments.of(total)

    base = moments(labelled)
    counts = labelled.where("unit >= 0").select("unit", "good", "bad")
    n = base.n
    m = base
    if pseudo is not None:
        more = moments(pseudo)
        m = base.with_weighted(more)
        docs = pseudo.where("unit = -1").agg(F.sum("bad"), F.sum("good")).first()
        others = np.array([docs[0] or 0, docs[1] or 0], float)
        w = weights(base.n, others)
        n = base.n + w * others
        extra = pseudo.where("unit >= 0").select("unit", (F.col("good") * float(w[1])).alias("good"), (F.col("bad") * float(w[0])).alias("bad"))
        counts = counts.select("unit", F.col("good").cast("double").alias("good"), F.col("bad").cast("double").alias("bad")).unionByName(extra)
    enough = counts.groupBy("unit").agg(F.sum("good").cast("float").alias("good"), F.sum("bad").cast("float").alias("bad")).where(F.col("good") + F.col("bad") >= SEEN).toArrow()
    units = enough.column("unit").to_numpy()
    order = np.argsort(units)
    return units[order], enough.column("good").to_numpy()[order].astype(float), enough.column("bad").to_numpy()[order].astype(float), m, n


def _fit_text(words: list[np.ndarray], y: np.ndarray, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the evidence; each document, which the counts (by word number)
    hold, is judged by the others' words."""
    x = np.empty((len(words), WIDTH))
    for i, (own, label) in enumerate(zip(words, y)):
        o = word_odds(good[own] - label, bad[own] - (1 - label), n[1] - label, n[0] - (1 - label))
        x[i] = evidence(o[~np.isnan(o)])
    return logistic(x, y)


def marked(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """``rows`` (``features`` of documents) with the label ``y`` of ``labels`` (doc_id, y), null
    without one, and the row's ``role``; written. They are joined this once: where the
    labels are at most ``FEW`` rows, by counting, they are broadcast.

    Null labels and ids are not used; a document labelled more than once counts as 0
    if any label is.
    """
    marks = durable(labels.where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("y").cast("int")).alias("y")))
    number = marks.count()
    share = min(1.0, labelled / max(1, number))
    at = key_hash(F.lit("held out"), F.col("doc_id")) / float(1 << 60)
    role = F.when(F.col("y").isNull(), "free").when(at < HELD_OUT * share, "held").when(at < share, "fit").otherwise("counted")
    return durable(rows.join(F.broadcast(marks) if number <= FEW else marks, "doc_id", "left").withColumn("role", role))


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """``fit`` of ``marked`` rows."""
    return fit(marked(rows, labels, labelled), rounds)


def fit(marked: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """A model of ``marked`` rows. Rows that repeat an id each count, but in the sample
    only the one whose words sort first. None if the sample lacks either class."""
    sample = marked.where("role IN ('held', 'fit')").groupBy("doc_id").agg(F.min(F.struct("words", "shape", "y", "role")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    sample = sample.combine_chunks()
    if not sample.num_rows:
        return None
    words, shapes = _lists(sample.column("words").chunk(0))[0], _shapes(sample.column("shape").chunk(0))
    y, held = sample.column("y").to_numpy().astype(float), sample.column("role").to_pandas().to_numpy() == "held"
    if any(len({*part}) < 2 for part in (y[held], y[~held])):
        return None
    fw, hw = ([w for w, h in zip(words, held) if h == own] for own in (False, True))
    hs, fy, hy = shapes[held], y[~held], y[held]

    base = durable(tally(marked.where("role IN ('fit', 'counted')")))
    free = marked.where("role = 'free'")
    pseudo = None
    for turn in range(rounds + 1):
        units, good, bad, moments, n = _learned(base, pseudo)
        by_unit = np.zeros((2, UNITS), np.float32)
        by_unit[0, units], by_unit[1, units] = bad, good
        text = _fit_text(fw, fy, by_unit[1], by_unit[0], n)
        model = Model(units, word_odds(good, bad, n[1], n[0]).astype(np.float32), text, discriminant(moments), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        # calibrated on documents that neither view has seen
        ht, hm = model.logits(model.dense(), hw, hs)
        model.fit_text, model.fit_meta = (logistic(np.c_[np.ones(len(hy)), z], hy, ridge=1e-4) for z in (ht, hm))
        model.sure = np.array([trusted(chance(c[0] + c[1] * z), hy) for c, z in ((model.fit_text, ht), (model.fit_meta, hm))])
        if turn < rounds:
            pseudo = durable(tally(free, model))
    lt, lm = (model.fit_text[0] + model.fit_text[1] * ht, model.fit_meta[0] + model.fit_meta[1] * hm)
    model.both = logistic(np.c_[np.ones(len(hy)), lt, lm, np.minimum(lt, lm)], hy, ridge=1e-4)
    return model


def score(rows: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """``(doc_id, p_text, p_meta, score, kept)`` for every row of ``features``.

    Rows with a null or repeated id are scored like any other. Without a model
    the scores are null and everything is kept.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        odds = None if model is None else model.dense()
        for batch in batches:
            if model is None or not batch.num_rows:
                none = pa.nulls(batch.num_rows, pa.float64())
                columns = [none, none, none, pa.array([True] * batch.num_rows, pa.bool_())]
            else:
                t, m = model.logits(odds, _lists(batch.column(1))[0], _shapes(batch.column(2)))
                p = np.round(model.combined(t, m), 6)
                columns = [pa.array(np.round(chance(t), 6)), pa.array(np.round(chance(m), 6)), pa.array(p), pa.array(p >= keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return rows.select("doc_id", "words", "shape").mapInArrow(work, "doc_id bigint, p_text double, p_meta double, score double, kept boolean")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  quality_col: str = "quality", toxic_col: str = "toxic", labelled: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """``score`` of every row of ``docs`` by a model of ``labels`` (good = quality 1
    and not toxic). Null and empty texts are scored as empty; rows with a null or repeated id
    like any other. Without labels of both classes scores are null and everything is kept. An
    empty table gives an empty one."""
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"))
    good = ((F.col(quality_col) == 1) & (F.col(toxic_col) == 0)).cast("int")
    rows = marked(features(named), labels.select(F.col(id_col).cast("bigint").alias("doc_id"), good.alias("y")), labelled)
    return score(rows, fit(rows, rounds))
