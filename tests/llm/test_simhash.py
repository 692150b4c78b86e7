import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from llm_data import make_words, sentence
from verdigris.llm import simhash as S
from verdigris.llm.graph import components, unite


def brute_print(text):
    words = set(re.findall(r"[^\W_]+", (text or "").lower()))
    total = [0] * 128
    for w in words:
        h = int.from_bytes(hashlib.md5(w.encode()).digest(), "big")
        for b in range(128):
            total[b] += 1 if h >> (127 - b) & 1 else -1
    bits = [int(t > 0) for t in total]
    return (int("".join(map(str, bits[:64])), 2), int("".join(map(str, bits[64:])), 2)) if words else None


def brute(rows):
    """doc_id -> (class, links), by comparing every document with every other."""
    prints = sorted({(i, brute_print(t)) for i, t in rows if i is not None}, key=str)
    parent = {i: i for i, _ in prints}
    links = dict.fromkeys(parent, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (a, p) in enumerate(prints):
        for b, q in prints[x + 1 :]:
            if p and q and (p[0] ^ q[0]).bit_count() <= S.RADIUS and (p[1] ^ q[1]).bit_count() <= S.CONFIRM:
                links[a] += 1
                links[b] += 1
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {i: (root(i), links[i]) for i in parent}


def corpus(n=220, seed=3):
    rng = random.Random(seed)
    words = make_words(2, 900)
    rows = []
    while len(rows) < n:
        base = sentence(rng, words, rng.randint(4, 250)).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            rows.append((len(rows), " ".join(rng.choice(words) if rng.random() < 0.04 else w for w in base)))
        if rng.random() < 0.2:
            rows.append((len(rows), " ".join(base).upper()))
    return rows


def found(df, **options):
    rows = S.near_duplicates(df, **options).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    return {r.doc_id: (r.class_id, r.links) for r in rows}


def test_classes_and_links_equal_brute_force_for_any_shard(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert sum(n for _, n in want.values()) > 100
    for shard in (S.SHARD, 15, 3):
        assert found(df, shard=shard) == want


def test_contained_texts_are_linked_whatever_their_sizes(spark):
    rng = random.Random(1)
    words = make_words(4, 900)
    rows = []
    for i in range(0, 120, 2):
        base = rng.sample(words, 200)
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + rng.sample(words, rng.randint(20, 120))))]
    want = brute(rows)
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == want
    sizes = dict((i, len(set(t.split()))) for i, t in rows)
    assert any(got[i + 1][0] == i and sizes[i + 1] > 1.25 * sizes[i] for i in range(0, 120, 2))


@pytest.mark.parametrize("radius", [3, 10, 14])
@pytest.mark.parametrize("chunk", [S.CHUNK, 50])
def test_search_in_memory_is_exact(radius, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 25, dtype=np.uint64)
    points = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 6), dtype=np.uint64), axis=1) for c in centres])
    others = points[::3] ^ np.uint64(5)
    near = lambda x, y: (int(x) ^ int(y)).bit_count() <= radius
    for scan in (0, 1 << 23):
        got = [p for i, j in S.near_in_memory(points, points, radius, True, scan) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == [(i, j) for i in range(len(points)) for j in range(i) if near(points[i], points[j])]
        got = [p for i, j in S.near_in_memory(points, others, radius, False, scan) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == [(i, j) for i in range(len(points)) for j in range(len(others)) if near(points[i], others[j])]


@pytest.mark.parametrize("radius", range(16))
def test_blocks_lose_no_pair(radius):
    for bits in (4, 10, 13):
        found = S.blocks(radius, bits)
        assert sum(most + 1 for _, _, most in found) > radius
        assert all(a + width <= b for (a, width, _), (b, _, _) in zip(found, [*found[1:], (64, 0, 0)]))


def test_comparisons_are_bounded_in_size_and_exact(monkeypatch):
    monkeypatch.setattr(S, "CELLS", 64)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    want = {(i, j) for i in range(300) for j in range(i) if (int(points[i]) ^ int(points[j])).bit_count() <= 10}
    got = [p for i, j in S.near_in_memory(points, points, 10, True, 0) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(want) and set(got) == want


def test_few_shards_meet_in_a_larger_table(spark, monkeypatch):
    def meet(radius):
        return lambda key, group: pd.DataFrame({"node": [key[0]], "links": [len(group)], "a": [key[1]], "b": [key[2]]})

    monkeypatch.setattr(S, "_meet", meet)
    n = 300_000
    nodes = S.durable(spark.range(n).selectExpr("id AS node", "id AS rep", "xxhash64(id) AS fp", "xxhash64(id, 1) AS chk", "1L AS copies"))
    meetings = S.linked(nodes).collect()
    assert sum(r.links for r in meetings) <= 6 * n
    assert max(r.links for r in meetings) <= 2 * S.SHARD


def test_unite():
    root = np.arange(10)
    unite(root, np.array([9, 5, 5, 2]), np.array([5, 7, 3, 4]))
    unite(root, np.array([4]), np.array([3]))
    assert root.tolist() == [0, 1, 2, 2, 2, 2, 6, 2, 8, 2]


def test_one_of_each_group_stays(spark):
    rows = corpus(seed=8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in S.drop_near_duplicates(df).collect())
    assert kept == sorted(i for i, (c, _) in brute(rows).items() if i == c)


def test_hostile(spark, hostile, hostile_rows, empty):
    assert found(hostile) == brute([(i, t) for i, t, *_ in hostile_rows])
    left = S.drop_near_duplicates(hostile)
    assert left.columns == hostile.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert ids.count(1) == 2
    assert not {2, 3} & set(ids)
    assert ids.count(None) == 2
    assert {4, 5, 6, 7, 8, 9, 10, 11} <= set(ids)
    assert S.near_duplicates(empty).count() == 0
    assert S.drop_near_duplicates(empty).columns == empty.columns


def test_all_alike_and_a_long_chain(spark):
    same = spark.createDataFrame([(i, "one and the same text") for i in range(500)], "doc_id bigint, text string")
    assert found(same, shard=10) == {i: (0, 499) for i in range(500)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(None, 3), (5, 5), (100, 101)], "a bigint, b bigint")
    got = {(r.id, r.component) for r in components(chain, "a", "b").collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
