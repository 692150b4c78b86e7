import hashlib
import re

import pytest
from test_decontaminate import brute as brute_leaks
from test_sharding import brute as brute_tree
from test_simhash import brute as brute_classes

import corpus_pipeline as P
from verdigris.llm import langid as L
from verdigris.llm import mixing as M
from verdigris.llm import sharding as K


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's result, written and read as the next one's input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_stages(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "sharding"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "shard"]


def test_each_stage_against_brute_force(spark, sf, stages):
    raw, identified, unique, clean, mixed, sharded = stages
    model = L.train(L.sample(raw))
    want = []
    for r in raw.collect():
        scores = [s for s in map(model.score, re.findall(r"[^\W_]+", r.text.lower())) if s is not None]
        totals = sorted(sum(int(s[k]) for s in scores) for k in range(len(model.langs)))
        if scores and totals[-1] - totals[-2] >= L.MIN_LEAD * len(scores):
            want.append(r.doc_id)
    assert ids(identified) == sorted(want)

    classes = brute_classes([(r.doc_id, r.text) for r in identified.collect()])
    assert ids(unique) == sorted(i for i, (c, _) in classes.items() if i == c)

    rows = [(r.doc_id, r.text) for r in unique.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    near = [x for x in rows if any(w in x[1].lower() for w in {" ".join(t.lower().split()[k : k + 3]) for _, t in items for k in range(0, len(t.split()) - 2, 3)})]
    leaky = {p[0] for p in brute_leaks(near, items)}
    assert ids(clean) == sorted(i for i, _ in rows if i not in leaky)

    kept = {r.doc_id for r in M.mix(clean, shares=(0.6,)).collect()}
    assert ids(mixed) == sorted(kept)
    order = {}
    for r in clean.collect():
        h = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        order.setdefault(r.source, []).append((h, r.doc_id))
    for source in order.values():  # a source's kept documents are those of the lowest hashes
        flags = [i in kept for _, i in sorted(source)]
        assert flags == sorted(flags, reverse=True)

    leaves = brute_tree([tuple(r) for r in K.points(mixed).collect()], K.TARGET)
    assert {r.doc_id: r.shard for r in sharded.collect()} == leaves


def test_run(spark, sf, stages):
    got = P.run(spark, sf)
    assert got.columns == stages[-1].columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_hostile(spark, sf, hostile, empty):
    for _, stage in P.STAGES:
        out = stage(spark, hostile, sf)
        assert [c for c in out.columns if c != "shard"] == [c for c in hostile.columns if c != "shard"]
        out.write.format("noop").mode("overwrite").save()
        assert stage(spark, empty, sf).count() == 0
