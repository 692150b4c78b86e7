"""The inverted index as tables, built and changed by set operations.

``postings``  term, doc_id, tf, dl, positions: a row a term and document
``doc_stats`` doc_id, slug, num_terms: a row a document, empty ones too
``term_stats`` term, nd, cf; ``corpus`` nc, dc, avdl: one row

Every change gives a new index; statistics are derived anew from what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.analysis import Analyzer
from verdigris.sources.scratch import durable

POSTINGS = "term string, doc_id bigint, tf bigint, dl bigint, positions array<int>"
DOC_STATS = "doc_id bigint, slug string, num_terms bigint"


class DuplicateDocument(ValueError):
    pass


class MissingDocument(ValueError):
    pass


@dataclass
class SearchIndex:
    postings: DataFrame
    doc_stats: DataFrame
    analyzer: Analyzer
    #: Tables of a stored version; derived when missing.
    stored_term_stats: DataFrame | None = None
    stored_corpus: DataFrame | None = None
    #: Postings and documents (of term ``DOCUMENT``) as one pass gives them.
    rows: DataFrame | None = None
    #: What ``rows`` are made of: documents (doc_id, slug, __text) and their analyzer.
    source: tuple[DataFrame, Analyzer] | None = None

    @cached_property
    def term_stats(self) -> DataFrame:
        if self.stored_term_stats is not None:
            return self.stored_term_stats
        return self.counts.groupBy("term").agg(F.count("*").alias("nd"), F.sum("tf").alias("cf"))

    @property
    def counts(self) -> DataFrame:
        """Postings (term, doc_id, tf, dl) without positions, which needn't be made for them."""
        if self.source is not None:
            return _only_postings(_rows(*self.source, positions=False))
        return self.postings.select("term", "doc_id", "tf", "dl")

    @cached_property
    def corpus(self) -> DataFrame:
        """One row, whatever the index holds; the mean length of no documents is null."""
        if self.stored_corpus is not None:
            return self.stored_corpus
        return self.doc_stats.agg(F.count("*").alias("nc"), F.coalesce(F.sum("num_terms"), F.lit(0)).cast("bigint").alias("dc")).withColumn(
            "avdl", F.try_divide(F.col("dc").cast("double"), F.col("nc").cast("double"))
        )

    @property
    def num_docs(self) -> int:
        return self.corpus.first()["nc"]

    @property
    def num_terms(self) -> int:
        """Tokens in all documents, not the size of the vocabulary."""
        return self.corpus.first()["dc"]

    @property
    def vocabulary(self) -> DataFrame:
        return self.term_stats.select("term")

    def has_document(self, slug: str) -> bool:
        return not self.doc_stats.where(F.col("slug") == slug).isEmpty()

    def has_documents(self, slugs: DataFrame) -> DataFrame:
        """``slugs`` (a column slug) with ``present``."""
        known = self.doc_stats.select("slug", F.lit(True).alias("__known")).distinct()
        return slugs.join(known, "slug", "left").select("slug", F.coalesce("__known", F.lit(False)).alias("present"))

    def inverted_list(self, term: str, first_doc: int | None = None) -> DataFrame:
        """A term's postings in the order of documents, from ``first_doc`` on."""
        rows = self.postings.where(F.col("term") == term)
        if first_doc is not None:
            rows = rows.where(F.col("doc_id") >= first_doc)
        return rows.select("doc_id", "tf", "positions").orderBy("doc_id")

    def term_freq(self, term: str, doc_id: int) -> int:
        """Occurrences of a term in a document, 0 if there are none."""
        row = self.postings.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).agg(F.sum("tf")).first()
        return row[0] or 0

    def contains(self, term: str, doc_id: int) -> bool:
        return self.term_freq(term, doc_id) > 0

    def persist(self) -> SearchIndex:
        kept = SearchIndex(self.postings.persist(), self.doc_stats.persist(), self.analyzer)
        kept.stored_term_stats, kept.stored_corpus = kept.term_stats.persist(), kept.corpus.persist()
        return kept

    def unpersist(self) -> None:
        for table in (self.postings, self.doc_stats, self.term_stats, self.corpus):
            table.unpersist()

    def stored(self) -> SearchIndex:
        """The index with its tables written to the shared folder: what was built
        in one pass is read twice, and changes don't add to a growing plan."""
        if self.rows is not None:
            return _of_rows(durable(self.rows), self.analyzer)
        return SearchIndex(durable(self.postings), durable(self.doc_stats), self.analyzer)


def check_keys(docs: DataFrame) -> None:
    """Raise unless every row of ``docs`` (doc_id, slug) has an id of its own and a
    slug of its own. Reads these two columns alone."""
    if not docs.where("doc_id IS NULL OR slug IS NULL").isEmpty():
        raise ValueError("documents need an id and a slug")
    for key in ("doc_id", "slug"):
        twice = docs.groupBy(key).count().where("count > 1").limit(5).collect()
        if twice:
            raise DuplicateDocument(f"more than one document with {key} " + ", ".join(str(r[key]) for r in twice))


#: Term of the row that each document has of its own; no tokenizer gives it.
DOCUMENT = "\0"


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer | None = None, slug_col: str | None = None, check: bool = True) -> SearchIndex:
    """Index every row of ``df``. Ids are never reused.

    A null text is an empty document: it has statistics and no postings. Null
    or repeated ids and slugs raise (``check``, a job over these columns; without
    it they are the caller's to rule out). Texts move once, to be divided evenly
    by document; tokens are made and grouped where their document then lies.
    """
    analyzer = analyzer or Analyzer()
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(slug_col or id_col).cast("string").alias("slug"), F.col(text_col).alias("__text"))
    if check:
        check_keys(docs.select("doc_id", "slug"))
    return _of_source(docs, analyzer)


def _of_source(docs: DataFrame, analyzer: Analyzer) -> SearchIndex:
    rows = _rows(docs, analyzer)
    stats = docs.select("doc_id", "slug", F.size(analyzer.tokens(F.col("__text"))).cast("bigint").alias("num_terms"))
    return SearchIndex(_only_postings(rows), stats, analyzer, rows=rows, source=(docs, analyzer))


def _rows(docs: DataFrame, analyzer: Analyzer, only: list[str] | None = None, positions: bool = True) -> DataFrame:
    """Postings (with ``only``, of these terms alone) and a row of term ``DOCUMENT`` for each document."""
    docs = docs.repartition("doc_id")
    if analyzer.stemmer.native:
        own = F.struct(F.lit(DOCUMENT).alias("term"), F.lit(0).cast("bigint").alias("tf"), *[F.array(F.lit(-1)).alias("positions")] * positions)
        lists = analyzer.lists(docs, "__text", "doc_id", "slug", only=only, positions=positions)
        rows = lists.select("doc_id", "slug", "dl", F.inline(F.concat(F.array(own), "lists")))
    else:  # Python can't be applied inside an array
        tokens = analyzer.terms(docs, "__text", "doc_id", "slug", head=DOCUMENT)
        if only is not None:
            tokens = tokens.where(F.col("term").isin([*only, DOCUMENT]))
        rows = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("slug").alias("slug"))
    return rows.select("doc_id", "term", "tf", "dl", *["positions"] * positions, F.when(F.col("term") == DOCUMENT, F.col("slug")).alias("slug"))


def _only_postings(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("term") != DOCUMENT).select("term", "doc_id", "tf", "dl", *[c for c in ("positions",) if c in rows.columns])


def _of_rows(rows: DataFrame, analyzer: Analyzer) -> SearchIndex:
    """Of rows that were stored."""
    docs = rows.where(F.col("term") == DOCUMENT).select("doc_id", "slug", F.col("dl").alias("num_terms"))
    return SearchIndex(_only_postings(rows), docs, analyzer)


#: Terms asked for, or documents removed, that are sent to every task at most; of terms, those that a plan names.
FEW, NAMED = 500_000, 1_000


def narrowed(index: SearchIndex, terms: DataFrame, few: int = FEW) -> SearchIndex:
    """The index with the postings of ``terms`` (a column term) alone, without
    positions, and the statistics of the whole. Unless the index is a stored one
    its tables are written, so that texts are analysed once whatever is asked."""
    asked = durable(terms.select("term").distinct())
    size = asked.count()
    if size <= min(few, NAMED):
        return narrowed_to(index, [r["term"] for r in asked.collect()])
    words = asked.unionByName(asked.sparkSession.range(1).select(F.lit(DOCUMENT).alias("term")))
    return _narrow(index, lambda rows: rows.join(F.broadcast(words) if size <= few else words, "term", "left_semi"))


def narrowed_to(index: SearchIndex, words: list[str]) -> SearchIndex:
    """``narrowed`` to words that are known."""
    rows = None if index.source is None else _rows(*index.source, words, positions=False)
    return _narrow(index, lambda rows: rows.where(F.col("term").isin([*words, DOCUMENT])), rows)


def _narrow(index: SearchIndex, of: Callable[[DataFrame], DataFrame], rows: DataFrame | None = None) -> SearchIndex:
    if index.stored_term_stats is not None and index.stored_corpus is not None:
        return SearchIndex(of(index.postings), index.doc_stats, index.analyzer, of(index.term_stats), index.corpus)
    if index.rows is not None:
        if rows is None:
            rows = of(index.rows if index.source is None else _rows(*index.source, positions=False))
        return _of_rows(durable(rows.select("doc_id", "term", "tf", "dl", "slug")), index.analyzer)
    return SearchIndex(durable(of(index.postings).select("term", "doc_id", "tf", "dl")), durable(index.doc_stats), index.analyzer)


def empty_index(spark, analyzer: Analyzer | None = None) -> SearchIndex:
    return SearchIndex(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], DOC_STATS), analyzer or Analyzer())


def clear(index: SearchIndex) -> SearchIndex:
    return SearchIndex(index.postings.limit(0), index.doc_stats.limit(0), index.analyzer)


def remove_documents(index: SearchIndex, slugs: DataFrame, check: bool = True) -> SearchIndex:
    """The index without the documents named in ``slugs`` (a column slug)."""
    named = slugs.select("slug").distinct()
    if check:
        missing = named.join(index.doc_stats, "slug", "left_anti").limit(5).collect()
        if missing:
            raise MissingDocument("no such document: " + ", ".join(str(r["slug"]) for r in missing))
    gone = durable(index.doc_stats.join(named, "slug", "left_semi").select("doc_id"))
    if gone.count() <= FEW:
        gone = F.broadcast(gone)

    def left(table: DataFrame) -> DataFrame:
        return table.join(gone, "doc_id", "left_anti").select(*table.columns)

    if index.source is not None:
        docs, analyzer = index.source
        return replace(_of_source(left(docs), analyzer), analyzer=index.analyzer)
    return SearchIndex(left(index.postings), left(index.doc_stats), index.analyzer, rows=None if index.rows is None else left(index.rows))


def add_documents(index: SearchIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slug_col: str | None = None, allow_overwrite: bool = False) -> SearchIndex:
    """The index with the rows of ``df``. A slug that is indexed already is an
    error, or with ``allow_overwrite`` is replaced. So is an id under which
    another slug is indexed, which can't be replaced."""
    new = build_index(df, id_col, text_col, index.analyzer, slug_col)
    slugs = new.doc_stats.select("slug")
    if allow_overwrite:
        index = remove_documents(index, slugs, check=False)
    else:
        known = index.doc_stats.join(slugs, "slug", "left_semi").limit(5).collect()
        if known:
            raise DuplicateDocument("already indexed: " + ", ".join(str(r["slug"]) for r in known))
    taken = index.doc_stats.join(new.doc_stats.select("doc_id"), "doc_id", "left_semi").limit(5).collect()
    if taken:
        raise DuplicateDocument("ids of other documents: " + ", ".join(f"{r['doc_id']} ({r['slug']})" for r in taken))
    rows = None if index.rows is None or new.rows is None else index.rows.unionByName(new.rows)
    return SearchIndex(index.postings.unionByName(new.postings), index.doc_stats.unionByName(new.doc_stats), index.analyzer, rows=rows)


def with_analyzer(index: SearchIndex, analyzer: Analyzer) -> SearchIndex:
    """For later additions and queries; what is indexed stays as it is."""
    return replace(index, analyzer=analyzer)
