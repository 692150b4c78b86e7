import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import make_words, sentence  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHING = ["fp", "h", "leaf", "__gone", "__source", "__below", "__doc", "__leaf", "shard", "tokens", "words", "n", "id", "component", "rep", "y", "kept", "bytes", "length"]


@pytest.fixture(scope="session")
def hostile_rows():
    rng = random.Random(5)
    words = make_words(1)
    text = sentence(rng, words, 60)
    rows = [
        (1, text, "en", "a", 10),
        (1, text, "en", "a", 10),  # a repeated row
        (2, text, "en", "b", 10),  # a copy
        (3, text + " Extra", "en", None, 10),
        (4, None, "en", "a", 10),
        (5, "", None, "a", None),
        (6, "   \n\t ", "en", "a", 3),
        (None, sentence(rng, words, 40), "en", "a", 10),
        (7, "!!! ??? ...", "de", "a", 3),
        (8, sentence(rng, words, 200_000), "en", "long", 10),
        (9, sentence(rng, words, 50), None, None, None),
        (9, sentence(rng, words, 50), "fr", "b", 1),  # a repeated id with another text
        (10, "x" * 100_000, "en", "a", 100_000),
        (11, "İ \U0001f600 日本語 текст", "xx", "c", 5),
        (None, None, None, None, None),
    ]
    rows += [(20 + i, sentence(rng, words, 30), "en", "a", 10) for i in range(10)]
    return rows


@pytest.fixture(scope="session")
def hostile(spark, hostile_rows, tmp_path_factory):
    df = spark.createDataFrame(hostile_rows, DOCS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    path = str(tmp_path_factory.mktemp("hostile") / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
