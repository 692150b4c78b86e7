"""Scorers: per-term contributions as column expressions.

The statistics of one (query, document, term): ``qf`` count in the query, ``tf``
in the document, ``cf`` in the corpus, ``nd`` documents with the term, ``nc``
documents, ``dl`` the document's length, ``dc`` the corpus's, ``avdl`` the mean.
A document's score is the sum over its terms; higher is better.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("qf", "tf", "cf", "nd", "nc", "dl", "dc", "avdl")


class Scorer:
    #: Whether terms that a document lacks add to its score.
    dense = True

    def contribution(self) -> Column:
        """Over columns named as in ``STATS``."""
        raise NotImplementedError

    def factors(self) -> tuple[Column, Column, Column] | None:
        """Where what ``sparse`` sums is a product: the factor of the posting (no ``qf`` in it),
        that of the query's term, and what a score has besides for each query term, of ``dl``."""
        return None

    def score(self, frame: DataFrame) -> DataFrame:
        """``(query_id, doc_id, score)`` from rows of statistics."""
        return frame.groupBy("query_id", "doc_id").agg(F.sum(self.contribution()).alias("score"))


def log10_or_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(F.log10(x))


@dataclass
class QlScorer(Scorer):
    """Query likelihood with Dirichlet smoothing; counts in the query don't matter.

    Only present terms need rows: a document's score is that of one without any
    of the terms, corrected for those that it has.
    """

    mu: float = 1500.0
    dense = False

    def contribution(self) -> Column:
        return log10_or_zero((F.col("tf") + self.mu * F.col("cf") / F.col("dc")) / (F.col("dl") + self.mu))

    def sparse(self) -> tuple[Column, Column, Column]:
        """Contribution of a present term beyond the absent one's, contribution of
        a query term to the base, and the finished score from sum, base, number
        of query terms and length."""
        if self.mu == 0:  # absent terms give log10(0), taken as 0
            return log10_or_zero(F.col("tf") / F.col("dl")), F.lit(0.0), F.col("gain")
        prior = self.mu * F.col("cf") / F.col("dc")
        return F.log10(F.col("tf") + prior) - F.log10(prior), F.log10(prior), F.col("base") - F.col("terms") * F.log10(F.col("dl") + self.mu) + F.col("gain")

    def factors(self) -> tuple[Column, Column, Column]:
        return self.sparse()[0], F.lit(1.0), F.lit(0.0) if self.mu == 0 else -F.log10(F.col("dl") + self.mu)


@dataclass
class Bm25Scorer(Scorer):
    """BM25 with query-term saturation; the inverse document frequency has no
    floor, so terms in over half of the documents count against."""

    k1: float = 1.2
    k2: float = 100.0
    b: float = 0.75
    dense = False

    def factors(self) -> tuple[Column, Column, Column]:
        c = F.col
        rarity = F.log10(F.lit(1.0) / ((c("nd") + 0.5) / (c("nc") - c("nd") + 0.5)))
        norm = F.lit(self.k1) * ((1 - self.b) + self.b * c("dl") / c("avdl"))
        return rarity * ((self.k1 + 1) * c("tf") / (norm + c("tf"))), (self.k2 + 1) * c("qf") / (self.k2 + c("qf")), F.lit(0.0)

    def contribution(self) -> Column:
        posting, query, _ = self.factors()
        return posting * query

    def sparse(self) -> tuple[Column, Column, Column]:
        return self.contribution(), F.lit(0.0), F.col("gain")


@dataclass
class ColumnScorer(Scorer):
    """A scorer from a function of no arguments that returns a column."""

    function: Callable[[], Column]
    dense: bool = True

    def contribution(self) -> Column:
        return self.function()

    def sparse(self) -> tuple[Column, Column, Column]:
        return self.contribution(), F.lit(0.0), F.col("gain")


@dataclass
class PandasScorer(Scorer):
    """A scorer from a Python function of a document's rows of statistics."""

    function: Callable[[pd.DataFrame], float]
    dense = True

    def score(self, frame: DataFrame) -> DataFrame:
        fn = self.function

        def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"query_id": [key[0]], "doc_id": [key[1]], "score": [float(fn(rows))]})

        kinds = dict(frame.dtypes)
        return frame.groupBy("query_id", "doc_id").applyInPandas(work, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
