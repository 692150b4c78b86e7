import pytest

from verdigris.functions.analysis import AlphanumericTokenizer, Analyzer, NoStemmer, PandasTokenizer, Stopper
from verdigris.operators.index import build_index
from verdigris.operators.search import search_one
from verdigris.sources import files, plays, store
from verdigris.streaming.ingest import ingest, open_ingested

PLAY = "ACT I\nSCENE I. a foo\nCHORUS.\nbar ACT II PROLOGUE.\nzz SCENE 2 qq EPILOGUE.\nend"


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "1.txt").write_text("first\nline")
    (tmp_path / "a" / "b" / "2.txt").write_text("second")
    got = files.read_documents(spark, str(tmp_path / "a"), pattern="*.txt", slug=r"(\d+)\.txt$")
    assert sorted((r.slug, r.text) for r in got.collect()) == [("1", "first\nline"), ("2", "second")]


def test_encoding(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("été".encode("latin-1"))
    assert files.read_documents(spark, str(tmp_path / "x.txt"), "ISO-8859-1").first().text == "été"


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.load(spark, path).num_docs == 0
    df = spark.createDataFrame([(1, "The cats"), (2, "dogs")], "doc_id bigint, text string")
    analyzer = Analyzer(AlphanumericTokenizer(True), Stopper(["the"]), NoStemmer())
    first = store.save(build_index(df, analyzer=analyzer), path)
    opened = store.load(spark, path)
    assert opened.analyzer.manifest() == analyzer.manifest()
    assert [r.slug for r in search_one(opened, "CATS").collect()] == ["1"]
    store.save(build_index(df.limit(0), analyzer=analyzer), path)
    assert store.load(spark, path).num_docs == 0
    assert store.load(spark, path, version=first).num_docs == 2
    with pytest.raises(store.AnalyzerMismatch):
        store.load(spark, path, Analyzer())
    assert store.vacuum(spark, path) == [first]
    store.save(build_index(df, analyzer=Analyzer(PandasTokenizer(str.split))), path)
    with pytest.raises(store.AnalyzerMismatch):
        store.load(spark, path)


def test_stored_terms_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save(build_index(spark.createDataFrame([(1, "cat dog")], "doc_id bigint, text string")), path)
    plan = search_one(store.load(spark, path), "cat")._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan


def test_json_shape(spark, tmp_path):
    import json

    path = str(tmp_path / "i.json")
    store.export_json(build_index(spark.createDataFrame([(7, "b a b")], "doc_id bigint, text string")), path)
    assert json.load(open(path)) == {
        "doc_data": {"7": {"slug": "7", "num_terms": 3}},
        "index": [{"term": "a", "posting_list": [{"doc_id": 7, "postings": [1]}]}, {"term": "b", "posting_list": [{"doc_id": 7, "postings": [0, 2]}]}],
    }
    assert store.import_json(spark, str(tmp_path / "none.json")).num_docs == 0
    open(path, "w").write("{broken")
    with pytest.raises(Exception):  # noqa: B017
        store.import_json(spark, path).num_docs  # noqa: B018


def test_lists_as_json(spark):
    index = build_index(spark.createDataFrame([(7, "b a b"), (8, "b")], "doc_id bigint, text string"))
    rows = store.lists_to_json(index)
    assert dict(tuple(r) for r in rows.collect())["b"] == '{"term":"b","posting_list":[{"doc_id":7,"postings":[0,2]},{"doc_id":8,"postings":[0]}]}'
    assert {(r.term, r.doc_id, r.tf) for r in store.lists_from_json(rows).collect()} == {(r.term, r.doc_id, r.tf) for r in index.postings.collect()}


def test_command(spark, tmp_path, monkeypatch):
    (tmp_path / "book.txt").write_text("THE SONNETS list THE SONNETS\n 1\n\nFrom THE END\n\nFIRST PLAY\nACT I\nSCENE I. a b\n*** END OF THE PROJECT GUTENBERG EBOOK x")
    (tmp_path / "titles.txt").write_text("FIRST PLAY\n")
    monkeypatch.setattr("sys.argv", ["plays", str(tmp_path / "book.txt"), str(tmp_path / "titles.txt"), str(tmp_path / "out")])
    plays.main()
    assert spark.read.parquet(str(tmp_path / "out" / "plays")).first().text == "a b\n"
    assert spark.read.parquet(str(tmp_path / "out" / "sonnets")).count() == 1


def test_sections(spark):
    got = plays.sections(spark.createDataFrame([("p", PLAY)], "title string, text string")).orderBy("pos").collect()
    assert [(r.act, r.name, r.text) for r in got] == [("I", "I", "a foo\nCHORUS.\nbar "), ("II", "PROLOGUE", "zz "), ("II", "2", "qq "), ("II", "EPILOGUE", "end")]


def test_front_matter(spark):
    books = [
        ("with prologue", "with prologue\nContents\nACT I\nSCENE I. x\nPROLOGUE.\nhello ACT I\nSCENE I. y"),
        ("without", "without\nContents\nACT I\nSCENE I. toc\nACT I\nSCENE I. real"),
        ("A POEM: ONE", "A POEM: ONE\n some lines "),
    ]
    got = plays.parse_plays(spark.createDataFrame(books, "title string, text string")).collect()
    assert sorted((r.title, r.act, r.name, r.text) for r in got) == sorted([
        ("with prologue", "", "PROLOGUE", "hello "), ("with prologue", "I", "I", "y"), ("without", "I", "I", "real"), ("A POEM: ONE", "", "", "some lines"),
    ])


def test_whole_book(spark, tmp_path):
    text = "THE SONNETS list THE SONNETS\n 1\n\nFrom\n\n2 When THE END\n\nFIRST PLAY\nACT I\nSCENE I. a b\nSECOND, PLAY\nACT II\nSCENE V. c\n*** END OF THE PROJECT GUTENBERG EBOOK x"
    both = plays.split_book(spark.createDataFrame([(text,)], "text string"))
    assert [(r.number, r.text) for r in plays.parse_sonnets(both).collect()] == [(1, "From"), (2, "When")]
    titles = spark.createDataFrame([(0, "FIRST PLAY"), (1, "SECOND, PLAY")], "idx int, title string")
    scenes = plays.parse_plays(plays.slice_plays(both, titles))
    got = plays.paths(scenes).collect()
    assert sorted((r.folder, r.file, r.text) for r in got) == [("first-play", "ACT-I-SCENE-I.txt", "a b\n"), ("second-play", "ACT-II-SCENE-V.txt", "c\n")]
    plays.write_scenes(scenes, str(tmp_path / "scenes"))
    assert spark.read.parquet(str(tmp_path / "scenes")).count() == 2


def test_same_path_keeps_the_last(spark):
    rows = spark.createDataFrame([("T", 1, "I", "I", "old"), ("T", 2, "I", "I", "new")], "title string, pos int, act string, name string, text string")
    assert [r.text for r in plays.paths(rows).collect()] == ["new"]


def test_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    assert open_ingested(spark, path).num_docs == 0
    for text in ("old words here", "new words"):
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(source)
        ingest(stream, path, str(tmp_path / "cp")).awaitTermination(120)
    index = open_ingested(spark, path)
    assert (index.num_docs, index.num_terms) == (1, 2)
    assert [r.slug for r in search_one(index, "new").collect()] == ["1"]


def test_vacuum_spares_what_is_being_written(spark, tmp_path):
    path = str(tmp_path / "store")
    index = build_index(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))
    first = store.save(index, path)
    (tmp_path / "store" / "v-unfinished").mkdir()
    store.save(index, path)
    assert store.vacuum(spark, path) == [first]
    assert (tmp_path / "store" / "v-unfinished").exists()


def test_scope_deletes_what_it_wrote(spark):
    from pathlib import Path

    from verdigris.sources import scratch

    where = Path(scratch.fresh_path(spark)).parent
    before = {p.name for p in where.iterdir()} if where.exists() else set()
    with scratch.scope(spark):
        inner = scratch.durable(spark.range(3))
        kept = scratch.durable(inner, outlives=True)
    assert kept.count() == 3
    assert len({p.name for p in where.iterdir()} - before) == 1
