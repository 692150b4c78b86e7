import pytest

from verdigris.functions.analysis import Analyzer, PandasStemmer
from verdigris.operators import index as I


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "gaps gap a a gap"), (2, "a the"), (3, "the"), (4, ""), (5, None), (100, "of of gaps")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def index(docs):
    return I.build_index(docs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_row_by_row(index):
    """Neither tokens nor postings are gathered by a task, which holds one text."""
    assert "Aggregate" not in plan(index.postings) and "Aggregate" not in plan(index.counts)
    assert plan(index.term_stats).count("keys=[term") > 0 and "keys=[doc_id" not in plan(index.term_stats)


def test_removal_leaves_out_texts(spark, index):
    gone = spark.createDataFrame([("3",), ("100",)], "slug string")
    left = I.remove_documents(index, gone)
    assert "Aggregate" not in plan(left.postings)
    assert sorted(map(str, left.postings.collect())) == sorted(map(str, index.postings.where("doc_id NOT IN (3, 100)").collect()))
    assert left.num_docs == index.num_docs - 2


def test_equals_what_python_stems(docs, index):
    """A stemmer that can't be applied inside an array gives the same rows."""
    other = I.build_index(docs, analyzer=Analyzer(stemmer=PandasStemmer(lambda t: "gap" if t == "gaps" else t)))
    assert sorted(map(str, index.postings.collect())) == sorted(map(str, other.postings.collect()))
    assert sorted(map(str, index.counts.collect())) == sorted(map(str, other.postings.drop("positions").collect()))
