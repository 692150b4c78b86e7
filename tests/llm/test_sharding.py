import os

import duckdb
import pytest

from verdigris.llm import sharding as K
from verdigris.llm.sql import sharding_sql


def brute(rows, target):
    """Recursive k-d splits of points (doc_id, bytes, *dims)."""
    span = [max(1, max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows)) for d in range(4)]

    def split(rows, leaf):
        total = sum(r[1] for r in rows)
        wide = [(max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows)) / span[d] * K.SCALES[d] for d in range(4)]
        if total <= target or max(wide) == 0:
            return {r[0]: leaf for r in rows}
        d = wide.index(max(wide))
        values = sorted({r[2 + d] for r in rows})
        seen, cut = 0, values[-2]
        for v in values[:-1]:
            seen += sum(r[1] for r in rows if r[2 + d] == v)
            if 2 * seen >= total:
                cut = v
                break
        return split([r for r in rows if r[2 + d] <= cut], 2 * leaf) | split([r for r in rows if r[2 + d] > cut], 2 * leaf + 1)

    return split(rows, 1)


@pytest.mark.parametrize("target", [5_000, 60_000])
def test_brute_force_and_sql(spark, sf, target):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    points = [tuple(r) for r in K.points(docs).collect()]
    got = {r.doc_id: r.leaf for r in K.shard(docs, target).collect()}
    assert got == brute(points, target)
    path = f"{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert {r[0]: r[3] for r in con.execute(sharding_sql(target, 14)).fetchall()} == got


def test_leaves_reach_the_target(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = K.shard(docs, 30_000).groupBy("leaf").agg({"bytes": "sum", "doc_id": "count"}).collect()
    assert len(sizes) > 8
    assert all(r["sum(bytes)"] <= 30_000 or r["count(doc_id)"] == 1 for r in sizes)


def test_equal_documents_divide_by_hash(spark):
    df = spark.createDataFrame([(i, "x" * 100, "en", "a") for i in range(64)], "doc_id bigint, text string, lang string, source string")
    sizes = [r[0] for r in K.shard(df, 1_000).groupBy("leaf").agg({"bytes": "sum"}).select("sum(bytes)").collect()]
    assert max(sizes) <= 1_000
    one = spark.createDataFrame([(1, "x" * 100, "en", "a")] * 64, "doc_id bigint, text string, lang string, source string")
    assert {r.leaf for r in K.shard(one, 1_000).collect()} == {1}


def test_documents_find_their_shard_where_they_lie(spark, tmp_path):
    rows = [(i, "wörd " * (1 + i * i % 37), f"l{i % 3}" if i % 11 else None, f"s{i % 5}" if i % 7 else "") for i in range(600)]
    # ids that repeat in other leaves get the smallest
    more = [(i, "x" * 400, "zz", "s9") for i in range(0, 30, 3)]
    path = str(tmp_path / "docs")
    schema = "doc_id bigint, text string, lang string, source string"
    for name, given in (("once", rows), ("again", rows + more)):
        spark.createDataFrame(given, schema).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        leaves = {}
        for r in K.shard(docs, 1_000).collect():
            leaves.setdefault(r.doc_id, []).append(r.leaf)
        assert len({x for v in leaves.values() for x in v}) > 30
        out = K.add_shards(docs, 1_000)
        got = [(r.doc_id, r.shard) for r in out.collect()]
        assert len(got) == len(given)
        assert all(shard == min(leaves[i]) for i, shard in got)
        if name == "once":
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan
        else:
            assert any(len(set(v)) > 1 for v in leaves.values())


def test_hostile(hostile, empty):
    got = K.shard(hostile, 2_000).collect()
    assert len(got) == hostile.count()
    out = K.add_shards(hostile, 2_000)
    assert sorted(out.columns) == sorted(hostile.columns)  # its own column shard is replaced
    rows = out.collect()
    assert len(rows) == hostile.count()
    assert all((r.shard is None) == (r.doc_id is None) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert K.shard(empty).count() == 0
    assert K.add_shards(empty).columns == [*empty.columns, "shard"]
