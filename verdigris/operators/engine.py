"""A search engine of one object, for interactive use.

Additions and removals are gathered and applied in bulk when something is asked
of the index; use ``build_index`` and ``search`` for whole tables.
"""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple

from pyspark.sql import SparkSession

from verdigris.functions.analysis import Analyzer, Stemmer, Stopper, Tokenizer
from verdigris.functions.scoring import QlScorer, Scorer
from verdigris.operators.index import DuplicateDocument, MissingDocument, SearchIndex, add_documents, clear, remove_documents
from verdigris.operators.search import search_one
from verdigris.sources import files, store


#: Characters of new texts that are gathered before they are indexed.
GATHERED = 1 << 26


class SearchResult(NamedTuple):
    slug: str
    score: float


class SearchEngine:
    """``filepath`` is a JSON file (ends in .json) or the folder of a native store;
    either may not exist yet. Nothing is stored before ``commit``."""

    def __init__(self, spark: SparkSession, filepath: str | Path, tokenizer: Tokenizer | None = None, stopper: Stopper | None = None,
                 stemmer: Stemmer | None = None, scorer: Scorer | None = None, native: bool = False):
        self.spark, self.native = spark, native
        self._path = str(filepath) if native else store.check_json_path(str(filepath))
        given = {k: v for k, v in (("tokenizer", tokenizer), ("stopper", stopper), ("stemmer", stemmer)) if v is not None}
        self.analyzer = Analyzer(**given)
        self.scorer = scorer or QlScorer()
        self._index = store.load(spark, self._path, self.analyzer if given else None) if native else store.import_json(spark, self._path, self.analyzer)
        self.analyzer = self._index.analyzer
        self._new: dict[str, str] = {}
        self._size = 0
        self._gone: set[str] = set()

    @property
    def filepath(self) -> str:
        return self._path

    @property
    def index(self) -> SearchIndex:
        """The index with all changes so far."""
        if self._gone:
            slugs = self.spark.createDataFrame([(s,) for s in self._gone], "slug string")
            self._index = remove_documents(self._index, slugs, check=False)
            self._gone = set()
        if self._new:
            rows = files.with_ids(self.spark.createDataFrame(list(self._new.items()), "slug string, text string"))
            self._index = add_documents(self._index, rows, slug_col="slug", allow_overwrite=True).stored()
            self._new, self._size = {}, 0
        return self._index

    @property
    def num_docs(self) -> int:
        return self.index.num_docs

    @property
    def num_terms(self) -> int:
        return self.index.num_terms

    def has_document(self, slug: str) -> bool:
        return slug in self._new or slug not in self._gone and self._index.has_document(slug)

    def index_string(self, text: str, slug: str, allow_overwrite: bool = False) -> None:
        if self.has_document(slug) and not allow_overwrite:
            raise DuplicateDocument(f"already indexed: {slug}")
        self._new[slug] = text
        self._size += len(text)
        if self._size > GATHERED:
            _ = self.index

    def index_file(self, path: str | Path, slug: str, encoding: str | None = None, allow_overwrite: bool = False) -> None:
        row = files.read_documents(self.spark, str(path), encoding).first()
        self.index_string(row["text"], slug, allow_overwrite)

    def remove_document(self, slug: str) -> None:
        if not self.has_document(slug):
            raise MissingDocument(f"no such document: {slug}")
        self._new.pop(slug, None)
        self._gone.add(slug)

    def clear_all_data(self) -> None:
        self._index, self._new, self._size, self._gone = clear(self._index), {}, 0, set()

    def search(self, query: str, k: int | None = None, scorer: Scorer | None = None) -> list[SearchResult]:
        return [SearchResult(r["slug"], r["score"]) for r in search_one(self.index, query, scorer or self.scorer, k).collect()]

    def commit(self) -> None:
        if self.native:
            store.save(self.index, self._path)
            self._index = store.load(self.spark, self._path, self.analyzer)
        else:
            store.export_json(self.index, self._path)
