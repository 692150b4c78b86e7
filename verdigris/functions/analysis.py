"""Text analysis as column expressions: tokenize, stop, stem.

Each strategy maps a column to a column, so that an analyzer is one projection
that Spark plans and compiles. ``Pandas*`` variants wrap arbitrary Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tokenizer:
    """Text column -> array of tokens."""

    name = "custom"

    def tokens(self, text: Column) -> Column:
        raise NotImplementedError

    def manifest(self) -> dict:
        return {"tokenizer": self.name}


@dataclass
class AlphanumericTokenizer(Tokenizer):
    """Maximal runs of ASCII letters and digits; anything else separates. Case is
    kept unless ``lowercase``, which is applied to the finished tokens."""

    lowercase: bool = False
    name = "alphanumeric"

    def tokens(self, text: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
        return F.transform(found, F.lower) if self.lowercase else found

    @staticmethod
    def is_tokenizable(char: Column) -> Column:
        """Whether a one-character string belongs to tokens; other lengths raise."""
        return F.when(F.length(char) == 1, char.rlike("^[A-Za-z0-9]$")).otherwise(F.raise_error(F.lit("one character expected")).cast("boolean"))

    def manifest(self) -> dict:
        return {"tokenizer": self.name, "lowercase": self.lowercase}


@dataclass
class PandasTokenizer(Tokenizer):
    """Any Python function from text to a list of tokens, in Arrow batches."""

    function: Callable[[str], list[str]]
    name: str = "pandas"

    def tokens(self, text: Column) -> Column:
        fn = self.function

        def work(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: list(fn(t)))

        return F.pandas_udf(work, "array<string>")(F.coalesce(text, F.lit("")))


class Stopper:
    """Drops tokens of a set, compared as they are (before stemming, with case).

    Small sets become a literal array; larger ones are the caller's to join.
    """

    def __init__(self, words: Iterable[str] = ()):
        self.words = frozenset(words)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Stopper:
        """One word a line, without surrounding white space."""
        lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("w")).distinct()
        return cls(r[0] for r in lines.where("w <> ''").collect())

    def is_stopword(self, word: Column) -> Column:
        return word.isin(sorted(self.words)) if self.words else F.lit(False)

    def kept(self, tokens: Column) -> Column:
        return F.filter(tokens, lambda t: ~t.isin(sorted(self.words))) if self.words else tokens

    def manifest(self) -> dict:
        return {"stopwords": sorted(self.words)}


class Stemmer:
    """Token column -> stem column, in one or more projections."""

    name = "custom"
    #: Whether the steps are expressions without Python, which may be applied inside an array.
    native = False

    def steps(self) -> list[Callable[[Column], Column]]:
        raise NotImplementedError

    def stem(self, token: Column) -> Column:
        for step in self.steps():
            token = step(token)
        return token

    def manifest(self) -> dict:
        return {"stemmer": self.name}


class NoStemmer(Stemmer):
    name = "none"
    native = True

    def steps(self) -> list[Callable[[Column], Column]]:
        return []


@dataclass
class PandasStemmer(Stemmer):
    """Any Python function from token to stem, in Arrow batches."""

    function: Callable[[str], str]
    name: str = "pandas"

    def steps(self) -> list[Callable[[Column], Column]]:
        fn = self.function

        def work(tokens: pd.Series) -> pd.Series:
            known = {t: fn(t) for t in tokens.unique()}
            return tokens.map(known)

        return [F.pandas_udf(work, "string")]


def _drop(word: Column, n: int) -> Column:
    return F.substring(word, 1, F.length(word) - n)


def plural(word: Column) -> Column:
    """First step: plurals. Vowels are a, e, i, o, u in lower case only."""
    return (
        F.when(~word.endswith("s") & ~word.endswith("ied"), word)
        .when(word.rlike("(us|ss)$"), word)
        .when(word.endswith("sses"), _drop(word, 2))
        .when(word.rlike("ie[ds]$"), F.concat(_drop(word, 3), F.when(F.length(word) > 4, "i").otherwise("ie")))
        .when(word.rlike("[aeiou].*[^aeiou]s$"), _drop(word, 1))
        .otherwise(word)
    )


def eed(word: Column) -> Column:
    """Second step, -eed and -eedly: the stem if a consonant follows a vowel before the suffix, else null."""
    return F.when(word.endswith("eed"), F.when(_drop(word, 3).rlike("[aeiou].*[^aeiou]"), _drop(word, 1))).when(
        word.endswith("eedly"), F.when(_drop(word, 5).rlike("[aeiou].*[^aeiou]"), _drop(word, 3))
    )


def _repair(part: Column) -> Column:
    twice = (F.length(part) >= 2) & (F.substring(part, -1, 1) == F.substring(part, -2, 1)) & ~F.substring(part, -1, 1).isin("l", "s", "z")
    return (
        F.when(part.rlike("(at|bl|iz)$"), F.concat(part, F.lit("e")))
        .when(twice, _drop(part, 1))
        .when(F.length(part) < 4, F.concat(part, F.lit("e")))
        .otherwise(part)
    )


def participle(word: Column) -> Column:
    """Second step, -ed, -edly, -ing and -ingly: the repaired stem if a vowel is left before the suffix, else null."""
    size = F.when(word.endswith("ed"), 2).when(word.endswith("ing"), 3).when(word.endswith("edly"), 4).when(word.endswith("ingly"), 5)
    part = F.substring(word, F.lit(1), F.length(word) - size)
    return F.when(size.isNotNull() & part.rlike("[aeiou]"), _repair(part))


def verbal(word: Column) -> Column:
    """Second step: -eed before -ed, whichever applies."""
    ends = [word.endswith(x) for x in ("ed", "ing", "edly", "ingly")]
    return F.when(~(ends[0] | ends[1] | ends[2] | ends[3]), word).otherwise(F.coalesce(eed(word), participle(word), word))


class PorterStemmer(Stemmer):
    """The first two steps of Porter's algorithm, case-sensitive. Stems once:
    it isn't idempotent."""

    name = "porter-1"
    native = True

    def steps(self) -> list[Callable[[Column], Column]]:
        return [plural, verbal]


@dataclass
class Analyzer:
    """Tokenizer, stopper and stemmer; fixed for the life of an index."""

    tokenizer: Tokenizer = field(default_factory=AlphanumericTokenizer)
    stopper: Stopper = field(default_factory=Stopper)
    stemmer: Stemmer = field(default_factory=PorterStemmer)

    def tokens(self, text: Column) -> Column:
        """Tokens left after stopping, in order."""
        return self.stopper.kept(self.tokenizer.tokens(text))

    def terms(self, df: DataFrame, text: str, *keep: str, head: str | None = None) -> DataFrame:
        """``keep`` columns with ``pos``, ``term`` and the document's length
        ``dl``, a row a token; positions count from 0 after stopping. With
        ``head``, every text has a row of this term at position -1 besides."""
        rows = df.select(*keep, self.tokens(F.col(text)).alias("__tokens"))
        size = F.size("__tokens").cast("bigint").alias("dl")
        if head is None:
            # outer, since for an inner one Spark would tokenize a second time, to
            # filter out texts without tokens beforehand
            rows = rows.select(*keep, size, F.posexplode_outer("__tokens").alias("pos", "term")).where("pos IS NOT NULL")
        else:
            rows = rows.select(*keep, size, F.posexplode(F.concat(F.array(F.lit(head)), "__tokens")).alias("pos", "term")).withColumn("pos", F.col("pos") - 1)
        # a projection a step, lest the steps' expressions multiply
        for step in self.stemmer.steps():
            rows = rows.withColumn("term", step(F.col("term")))
        # never null, which the planner would else have each join on terms check
        # by a filter that holds all steps at once
        term = F.coalesce("term", F.lit(""))
        return rows.withColumn("term", term if head is None else F.when(F.col("pos") < 0, head).otherwise(term))

    def lists(self, df: DataFrame, text: str, *keep: str, only: list[str] | None = None, positions: bool = True) -> DataFrame:
        """``keep`` columns with ``dl`` and ``lists``, a row a text: of each term, in order, its
        count ``tf`` and ``positions``; with ``only``, of these terms alone. A row is worked out by
        itself, so memory is that of one text. The stemmer must be ``native``."""
        stems = self.tokens(F.col(text))
        for step in self.stemmer.steps():
            stems = F.transform(stems, step)
        rows = df.select(*keep, stems.alias("__stems")).withColumn("dl", F.size("__stems").cast("bigint"))
        # terms are never null, and are sorted with their positions where these are wanted
        found = F.transform("__stems", lambda t: F.coalesce(t, F.lit("")))
        if positions:
            found = F.transform("__stems", lambda t, i: F.struct(F.coalesce(t, F.lit("")).alias("term"), i.alias("pos")))

        def term(x: Column) -> Column:
            return x["term"] if positions else x

        if only is not None:
            found = F.filter(found, lambda x: term(x).isin(only))

        def begins(s: Column) -> Column:
            return F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (term(F.get(s, i)) != term(F.get(s, i - 1))))

        def lists(h: Column) -> Column:
            def one(b: Column, j: Column) -> Column:
                end = F.coalesce(F.get(h["at"], j + 1), F.size(h["s"]))
                own = [F.transform(F.sequence(b, end - 1), lambda i: F.get(h["s"], i)["pos"]).alias("positions")] if positions else []
                return F.struct(term(F.get(h["s"], b)).alias("term"), (end - b).cast("bigint").alias("tf"), *own)

            return F.transform(h["at"], one)

        # held in arrays of one, so that each step is worked out once a row
        held = F.transform(F.array(F.sort_array(found)), lambda s: F.struct(s.alias("s"), begins(s).alias("at")))
        return rows.select(*keep, "dl", F.get(F.transform(held, lists), F.lit(0)).alias("lists"))

    def manifest(self) -> str:
        return json.dumps(self.tokenizer.manifest() | self.stopper.manifest() | self.stemmer.manifest(), sort_keys=True)
