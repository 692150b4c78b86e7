import math

import pytest
from pyspark.sql import functions as F

from verdigris.functions.scoring import Bm25Scorer, ColumnScorer, PandasScorer, QlScorer
from verdigris.operators import index as I
from verdigris.operators import search as S
from verdigris.operators.engine import SearchEngine

DOCS = [
    ("1", "APPLE BANANA CARROT DRAGONFRUIT EGGPLANT FIG"),
    ("2", "AIRPLANE BALL CACTUS DOVE EAR FISH GOAT HAMBURGER ICECREAM JUICE"),
    ("3", "APPLE CARROT CACTUS"),
]
WANT = {
    ("APPLE CACTUS", "ql"): [("3", -1.951698937), ("1", -1.956172778), ("2", -1.958476729)],
    ("APPLE CACTUS", "bm25"): [("2", -0.179367074), ("1", -0.226730507), ("3", -0.565443764)],
    ("FIG", "ql"): [("1", -1.275020799)],
    ("FIG", "bm25"): [("1", 0.226730507)],
    ("FIG FIG APPLE", "ql"): [("1", -2.251736259), ("3", -2.255470791)],
    ("FIG FIG APPLE", "bm25"): [("1", 0.222284811), ("3", -0.282721882)],
    ("ZZZ", "ql"): [],
    ("", "bm25"): [],
}


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(int(s), t) for s, t in DOCS], "doc_id bigint, text string")
    return I.build_index(df).persist()


@pytest.mark.parametrize(("query", "name"), WANT)
def test_scores(index, query, name):
    scorer = QlScorer() if name == "ql" else Bm25Scorer()
    want = WANT[query, name]
    dense = ColumnScorer(scorer.contribution)
    for s in (scorer, dense):
        got = [(r.slug, r.score) for r in S.search_one(index, query, s).collect()]
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(math.isclose(g[1], w[1], abs_tol=1e-8) for g, w in zip(got, want))


def test_batch_equals_single(spark, index):
    asked = spark.createDataFrame(list(enumerate(sorted({q for q, _ in WANT}))), "query_id int, text string")
    batch = S.search(index, asked, Bm25Scorer(), k=2).orderBy("query_id", "rank").collect()
    for r in asked.collect():
        want = [tuple(x) for x in S.search_one(index, r.text, Bm25Scorer(), k=2).collect()]
        assert [(b.slug, b.score) for b in batch if b.query_id == r.query_id] == want


def test_pandas_scorer(spark, index):
    native = S.scores(index, spark.createDataFrame([(0, "APPLE FIG")], "query_id int, text string"), ColumnScorer(lambda: F.col("tf") * 1.0 / F.col("nd")))
    python = S.scores(index, spark.createDataFrame([(0, "APPLE FIG")], "query_id int, text string"), PandasScorer(lambda rows: (rows.tf / rows.nd).sum()))
    assert {tuple(r) for r in native.collect()} == {tuple(r) for r in python.collect()}


def test_statistics(index):
    stats = {r.term: (r.nd, r.cf) for r in index.term_stats.collect()}
    assert len(stats) == 16
    assert {t for t, s in stats.items() if s == (2, 2)} == {"APPLE", "CARROT", "CACTUS"}
    assert math.isclose(index.corpus.first().avdl, 19 / 3)


def test_one_list(index):
    assert [(r.doc_id, r.tf, r.positions) for r in index.inverted_list("CACTUS").collect()] == [(2, 1, [2]), (3, 1, [2])]
    assert [r.doc_id for r in index.inverted_list("CACTUS", 3).collect()] == [3]
    assert (index.term_freq("FIG", 1), index.term_freq("FIG", 2), index.contains("FIG", 1), index.contains("ZZZ", 1)) == (1, 0, True, False)


def test_engine_counts_through_adds_and_removals(spark, tmp_path):
    engine = SearchEngine(spark, tmp_path / "index.json")
    assert (engine.num_docs, engine.num_terms) == (0, 0)
    for (slug, text), want in zip(DOCS, [(1, 6), (2, 16), (3, 19)]):
        engine.index_string(text, slug)
        assert (engine.num_docs, engine.num_terms) == want
    for slug, want in zip("132", [(2, 13), (1, 10), (0, 0)]):
        engine.remove_document(slug)
        assert not engine.has_document(slug)
        assert (engine.num_docs, engine.num_terms) == want
    engine.index_string("again", "1")
    assert engine.has_document("1")


def test_engine_guards(spark, tmp_path):
    engine = SearchEngine(spark, tmp_path / "index.json")
    engine.index_string("one two", "a")
    with pytest.raises(I.DuplicateDocument):
        engine.index_string("three", "a")
    engine.index_string("three", "a", allow_overwrite=True)
    assert (engine.num_docs, engine.num_terms) == (1, 1)
    with pytest.raises(I.MissingDocument, match="zz"):
        engine.remove_document("zz")
    engine.clear_all_data()
    assert not engine.has_document("a")
    assert engine.num_docs == 0
    assert engine.search("three") == []
    with pytest.raises(ValueError, match="json"):
        SearchEngine(spark, tmp_path / "index.txt")


@pytest.mark.parametrize("native", [False, True])
def test_engine_round_trip(spark, tmp_path, native):
    path = tmp_path / ("store" if native else "index.json")
    engine = SearchEngine(spark, path, native=native)
    for slug, text in DOCS:
        engine.index_string(text, slug)
    before = engine.search("APPLE CACTUS")
    engine.commit()
    again = SearchEngine(spark, path, native=native)
    assert again.search("APPLE CACTUS") == before
    again.index_string("APPLE", "4")  # after a search and a reload
    again.remove_document("2")
    assert (again.num_docs, again.num_terms) == (3, 10)
    again.commit()
    last = SearchEngine(spark, path, native=native)
    assert (last.num_docs, last.num_terms) == (3, 10)


def test_bulk_guards(spark, index):
    with pytest.raises(I.DuplicateDocument):
        I.add_documents(index, spark.createDataFrame([(3, "x")], "doc_id bigint, text string"))
    with pytest.raises(I.MissingDocument):
        I.remove_documents(index, spark.createDataFrame([("77",)], "slug string"))


def test_empty_and_null_documents_count(spark):
    index = I.build_index(spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id bigint, text string"))
    assert (index.num_docs, index.num_terms) == (3, 2)
    empty = I.empty_index(spark)
    assert (empty.num_docs, empty.num_terms) == (0, 0)
    assert S.search_one(empty, "a").collect() == []
    assert empty.corpus.first().avdl is None


def test_repeated_and_missing_keys(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "a c c")], "doc_id bigint, text string")
    with pytest.raises(I.DuplicateDocument):
        I.build_index(twice)
    with pytest.raises(ValueError):
        I.build_index(spark.createDataFrame([(None, "a")], "doc_id bigint, text string"))
    named = spark.createDataFrame([(1, "x", "a"), (2, "x", "b")], "doc_id bigint, slug string, text string")
    with pytest.raises(I.DuplicateDocument):
        I.build_index(named, slug_col="slug")


def test_id_of_another_slug(spark):
    base = I.build_index(spark.createDataFrame([(1, "x", "a")], "doc_id bigint, slug string, text string"), slug_col="slug")
    more = spark.createDataFrame([(1, "y", "b")], "doc_id bigint, slug string, text string")
    for overwrite in (False, True):
        with pytest.raises(I.DuplicateDocument):
            I.add_documents(base, more, slug_col="slug", allow_overwrite=overwrite)


def test_stored_tables_equal_the_lazy_ones(spark):
    rows = [(1, "one", "lines line a"), (2, "two", None), (3, "three", ""), (4, "four", "a a a")]
    index = I.build_index(spark.createDataFrame(rows, "doc_id bigint, slug string, text string"), slug_col="slug")
    kept = index.stored()
    for table in ("postings", "doc_stats", "term_stats", "corpus"):
        lazy, stored = getattr(index, table), getattr(kept, table)
        assert sorted(map(str, lazy.collect())) == sorted(map(str, stored.select(*lazy.columns).collect()))
    assert kept.num_docs == 4 and not kept.has_document("five")


def test_late_rebinding(spark):
    from verdigris.functions.analysis import Analyzer, NoStemmer

    index = I.build_index(spark.createDataFrame([(1, "hoping")], "doc_id bigint, text string"))
    assert [r.slug for r in S.search_one(index, "hoping").collect()] == ["1"]
    bare = I.with_analyzer(index, Analyzer(stemmer=NoStemmer()))
    assert S.search_one(bare, "hoping").collect() == []
    assert [r.slug for r in S.search_one(bare, "hope").collect()] == ["1"]
    more = I.add_documents(bare, spark.createDataFrame([(2, "hoping")], "doc_id bigint, text string"))
    assert [r.slug for r in S.search_one(more, "hoping").collect()] == ["2"]


def test_many_terms_are_joined(spark, index, monkeypatch):
    asked = spark.createDataFrame([(0, "APPLE CACTUS"), (1, "FIG")], "query_id int, text string")
    want = sorted(map(tuple, S.scores(index, asked, Bm25Scorer()).collect()))
    monkeypatch.setattr(S, "FEW", 0)
    assert sorted(map(tuple, S.scores(index, asked, Bm25Scorer()).collect())) == want
