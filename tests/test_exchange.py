import json

from verdigris.operators.index import build_index
from verdigris.sources import store


def rows(index):
    return sorted((r.term, r.doc_id, r.tf, r.dl, tuple(r.positions)) for r in index.postings.collect())


def test_lists_go_on_over_several_lines(spark, tmp_path):
    """A list longer than a batch is one list of the file, and its lines are read side by side."""
    index = build_index(spark.createDataFrame([(i, f"all d{i} {'twice all' * (i % 2)}") for i in range(25)] + [(99, None)], "doc_id bigint, text string"))
    path = str(tmp_path / "i.json")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    store.export_json(index, path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    file = json.load(open(path))
    lists = {x["term"]: x["posting_list"] for x in file["index"]}
    assert len(file["index"]) == len(lists) and [p["doc_id"] for p in lists["all"]] == list(range(25))
    assert len(file["doc_data"]) == 26
    back = store.import_json(spark, path)
    assert rows(back) == rows(index)
    assert back.num_docs == 26
    plan = back.postings._jdf.queryExecution().toString()
    assert "Format: Text" in plan or "FileScan text" in plan  # by lines, which many tasks can read
    assert sum(line.count('"term":"all"') for line in open(path)) > 1


def test_files_of_other_writers_and_broken_ones(spark, tmp_path):
    index = build_index(spark.createDataFrame([(7, "b a b"), (8, "b")], "doc_id bigint, text string"))
    path = str(tmp_path / "i.json")
    store.export_json(index, path)
    text = open(path).read()
    for i, other in enumerate((json.dumps(json.loads(text)), json.dumps(json.loads(text), indent=1))):
        (tmp_path / f"other{i}.json").write_text(other)
        assert rows(store.import_json(spark, str(tmp_path / f"other{i}.json"))) == rows(index)
    store.export_json(build_index(spark.createDataFrame([], "doc_id bigint, text string")), path)
    assert json.load(open(path)) == {"doc_data": {}, "index": []}
    assert store.import_json(spark, path).num_docs == 0
    for cut in range(20, len(text) - 1, 23):
        (tmp_path / f"cut{cut}.json").write_text(text[:cut])
        try:
            store.import_json(spark, str(tmp_path / f"cut{cut}.json")).postings.count()
        except Exception:  # noqa: BLE001, S112
            continue
        raise AssertionError(f"cut to {cut}")
