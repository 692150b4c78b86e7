import pytest
from pyspark.sql import functions as F

from verdigris.functions import analysis as A

TOKENS = [
    ("Weary with toil, I haste", False, "Weary with toil I haste"),
    ("mistress' eyes", False, "mistress eyes"),
    ("summer’s day?", False, "summer s day"),
    ("ouè_x1", False, "ou x1"),
    ("", False, ""),
    ("’é!", False, ""),
    ("The THE", True, "the the"),
    ("\u0130 \u212a", True, ""),
    (None, False, ""),
]

STEMS = """classes→class ties→tie cries→cri ies→ie cried→cri died→die gaps→gap gas→gas this→this yes→yes lines→lines s→s us→us ss→ss 99s→99s a1s→a1 xyzs→xyzs
rhythms→rhythms agreed→agree agreedly→agree indeed→indee feed→fee need→nee bed→bed sing→sing thing→thing being→bee falling→fall missing→miss adding→ad
seeing→se agreeing→agre oiling→oile illing→ille hoping→hope hopped→hop conflated→conflate troubled→trouble sized→size ating→ate hated→hate used→use
heeding→heed blessings→bless speedly→spee eedly→ee Ending→Ending USED→USED 1st→1st""".split()


@pytest.mark.parametrize("lower", [False, True])
def test_tokens(spark, lower):
    rows = [(i, text, want) for i, (text, low, want) in enumerate(TOKENS) if low == lower]
    df = spark.createDataFrame(rows, "i int, text string, want string")
    got = df.select("want", F.array_join(A.AlphanumericTokenizer(lower).tokens(F.col("text")), " ").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_stems(spark):
    pairs = [tuple(p.split("→")) for p in STEMS]
    df = spark.createDataFrame(pairs, "word string, want string")
    got = df.select("word", "want", A.PorterStemmer().stem(F.col("word")).alias("got")).collect()
    assert [(r.word, r.got) for r in got] == pairs


def test_tokenizable_rejects_strings(spark):
    df = spark.createDataFrame([("a",), ("_",)], "c string")
    assert [r[0] for r in df.select(A.AlphanumericTokenizer.is_tokenizable(F.col("c"))).collect()] == [True, False]
    with pytest.raises(Exception, match="one character"):
        spark.createDataFrame([("ab",)], "c string").select(A.AlphanumericTokenizer.is_tokenizable(F.col("c"))).collect()


def test_positions_follow_stopping(spark):
    df = spark.createDataFrame([(1, "the cat and the dogs")], "doc_id int, text string")
    terms = A.Analyzer(stopper=A.Stopper(["the"])).terms(df, "text", "doc_id").orderBy("pos").collect()
    assert [(r.pos, r.term, r.dl) for r in terms] == [(0, "cat", 3), (1, "and", 3), (2, "dog", 3)]


def test_stopwords_from_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text(" the \n\nof\nthe\n")
    stopper = A.Stopper.from_file(spark, str(tmp_path / "stop.txt"))
    assert stopper.words == {"the", "of"}
    got = spark.createDataFrame([("the",), ("The",)], "w string").select(stopper.is_stopword(F.col("w"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_python_hooks_agree_with_native(spark):
    import re

    df = spark.createDataFrame([(1, "Hoping, hopped"), (2, None)], "doc_id int, text string")
    native = A.Analyzer(stemmer=A.NoStemmer()).terms(df, "text", "doc_id").collect()
    hooked = A.Analyzer(A.PandasTokenizer(lambda t: re.findall("[A-Za-z0-9]+", t)), stemmer=A.PandasStemmer(lambda w: w)).terms(df, "text", "doc_id").collect()
    assert native == hooked
