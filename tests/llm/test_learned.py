"""Embedding near-duplicates and co-training."""

import random

import numpy as np
import pandas as pd
import pytest
from llm_data import make_words, sentence

from verdigris.llm import cotraining as Q
from verdigris.llm import embeddings as E


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)], "vec_id bigint, embedding array<float>")


def cloud(seed=0, groups=(2, 3, 60, 150), alone=500, dim=32, noise=0.03):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((alone, dim))]
    for size in groups:
        x.append(rng.standard_normal(dim) + noise * rng.standard_normal((size, dim)))
    x = np.concatenate(x)
    return x[rng.permutation(len(x))]


def near(x, threshold=E.THRESHOLD):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    return s


def classes(s):
    root = np.arange(len(s))
    while True:
        up = np.minimum(root, np.where(s, root[None, :], len(s)).min(axis=1))
        if (up == root).all():
            return root
        root = up


@pytest.mark.parametrize("small", [False, True])
def test_recall(spark, small):
    x = cloud()
    options = {"run": 97, "tile": 40, "window": 4} if small else {}
    rows = E.near_duplicates(vectors(spark, x), **options).collect()
    s = near(x)
    links, want = np.zeros(len(x), int), s.sum(axis=1)
    for r in rows:
        links[r.vec_id] = r.links
    assert len(rows) == len(x)
    assert (links <= want).all()
    assert links.sum() >= 0.98 * want.sum() > 24_000
    root = classes(s)
    assert sum(r.class_id == root[r.vec_id] for r in rows) >= 0.98 * len(rows)


def test_recall_near_the_threshold(spark):
    x = cloud(seed=2, groups=(2,) * 200, alone=2000, noise=0.3)
    got = {r.vec_id: r.links for r in E.near_duplicates(vectors(spark, x)).collect()}
    want = near(x.astype(np.float32).astype(np.float64)).sum(axis=1)
    assert want.sum() > 100
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.9 * want.sum()


def test_borders_of_short_and_missing_parts():
    assert E.reaches({0: 5, 1: 2, 4: 3, 5: 9}, 4) == [(1, 0, 0), (4, 1, 0), (4, 0, 2), (5, 4, 0), (5, 1, 3)]
    assert E.reaches({3: 7}, 4) == []


def test_no_pair_is_lost_between_parts(spark):
    """One pass with a window as wide as the table compares every pair, in however many runs."""
    x = cloud(seed=3, groups=(2, 9, 30), alone=30)
    df = vectors(spark, x)
    for run in (4, 11, 1000):
        got = {r.vec_id: (r.class_id, r.links) for r in E.near_duplicates(df, passes=1, window=len(x), run=run, tile=7).collect()}
        s = near(x)
        assert got == {i: (c, n) for i, (c, n) in enumerate(zip(classes(s).tolist(), s.sum(axis=1).tolist()))}


def test_copies_are_counted_and_not_listed(spark):
    x = np.repeat(np.random.default_rng(1).standard_normal((2, 8)), [400, 1], axis=0)
    x[-1] = x[0] + 0.01
    got = E.near_duplicates(vectors(spark, x)).collect()
    assert {tuple(r) for r in got} == {(i, 0, 400) for i in range(401)}


@pytest.mark.parametrize("count", [1, 500, 10_000, 500_000, 2_000_000, 10**9])
def test_modelled_recall_at_every_size(count):
    passes, window = E.plan(count)
    assert passes >= E.PASSES and E.WINDOW <= window <= E.WIDEST
    assert 1 - (1 - E.linked(count, window, E.THRESHOLD)) ** passes >= 0.9
    for fixed in (E.plan(count, window=2), E.plan(count, passes=6)):
        assert 1 - (1 - E.linked(count, fixed[1], E.THRESHOLD)) ** fixed[0] >= 0.9


def test_recall_of_isolated_pairs_among_many():
    """The passes as they run in one task, without Spark."""
    rng = np.random.default_rng(4)
    n, pairs = 100_000, 2_000
    x = rng.standard_normal((n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, 16))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[-pairs:] = 0.902 * x[:pairs] + np.sqrt(1 - 0.902**2) * side
    rows = pd.DataFrame({"vec_id": np.arange(n), "v": list(x.astype(np.float32)), "part": 0})
    passes, window = E.plan(n)
    found = set()
    for number in range(passes):
        (keyed,) = E._keys(number, E.BITS)(iter([rows]))
        ordered = keyed.sort_values(["key", "vec_id"])
        ids = ordered.vec_id.to_numpy()
        for i, j in E._near(E.unit(ordered.v), window, 0.9):
            found.update(zip(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
    assert sum((i, n - pairs + i) in found for i in range(pairs)) >= 0.9 * pairs


def test_embeddings_hostile(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (1, one), (2, one), (3, [2.0, 4.0, 6.0]), (None, one), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [float("nan"), 1.0, 1.0]),
            (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (11, [1e30, 2e30, 3e30]), (12, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "1 AS key", "1 AS part", "1 AS dim")
    got = {r.vec_id: (r.class_id, r.links) for r in E.near_duplicates(df).collect()}
    near = {1: (1, 3), 2: (1, 3), 3: (1, 3), 11: (1, 3)}
    assert got == {i: near.get(i, (i, 0)) for i in range(1, 13)}
    assert E.near_duplicates(df.limit(0)).count() == 0
    assert E.near_duplicates(df.limit(1)).count() == 1
    twice = vectors(spark, [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0]], [5, 6, 5, 8])
    assert {tuple(r) for r in E.near_duplicates(twice).collect()} == {(5, 5, 2), (6, 5, 1), (8, 5, 1)}


LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    words = make_words(7, 500)
    rude = make_words(8, 8, "zxq")
    docs, labels = [], []
    for i in range(1600):
        kind = rng.choice(["good"] * 6 + ["junk", "rude"])
        ws = sentence(rng, words, rng.randint(20, 120)).split()
        if kind == "rude":
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(rude)
        if kind == "junk":
            ws = [w + "!!###" for w in ws]
        docs.append((i, " ".join(ws), "en", rng.choice("abc"), 0))
        labels.append((i, int(kind != "junk"), int(kind == "rude")))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, LABELS)


def test_held_out_quality(judged):
    docs, labels = judged
    got = Q.score_quality(docs, labels.where("doc_id < 1000")).join(labels, "doc_id").where("doc_id >= 1000").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in got if r.quality == 0 or r.toxic == 1]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def taught(docs, labels, **options):
    return Q.train(Q.durable(Q.features(docs)), labels, **options)


@pytest.mark.xfail(reason="open: of 60 held-out labels an eighth are rude texts, which the metadata view can't see, so it proves nothing and the odds stay")
def test_views_teach_each_other(judged):
    docs, labels = judged
    few = labels.where("doc_id < 240")
    good = few.selectExpr("doc_id", "int(quality = 1 AND toxic = 0) AS y")
    before, after = taught(docs, good, rounds=0), taught(docs, good)
    assert not np.array_equal(before.odds, after.odds)
    assert not np.array_equal(before.meta, after.meta)


def test_bounds_hold(judged):
    docs, labels = judged
    good = labels.selectExpr("doc_id", "quality AS y")
    assert taught(docs, good, labelled=300) is not None
    assert taught(docs, good, labelled=1) is None


def test_only_proven_confidence_is_trusted():
    p, y = np.linspace(0, 1, 1001), np.ones(1001)
    assert Q.trusted(p, y) == (-1.0, Q.CONFIDENT)
    y[::10] = 0  # a tenth of the surest are wrong
    assert Q.trusted(p, y)[1] == 2.0
    y = (p > 0.5).astype(float)
    assert Q.trusted(p, y) == (pytest.approx(1 - Q.CONFIDENT), Q.CONFIDENT)


def plain(docs):
    """Words and shape of each document, one at a time."""
    from collections import Counter

    out = {}
    for d in docs.collect():
        counts = Counter(Q.WORD.findall((d.text or "").lower()))
        out[d.doc_id] = sorted({Q.unit(w) for w in counts}), Q.shape(d.text or "", counts, d.source, d.lang).astype(np.float32)
    return out


def totals(table):
    words, moments, docs = {}, 0, (0, 0)
    for r in table.collect():
        if r.unit >= 0:
            good, bad = words.get(r.unit, (0, 0))
            words[r.unit] = good + r.good, bad + r.bad
        else:
            moments, docs = moments + np.array(r.moments), (docs[0] + r.good, docs[1] + r.bad)
    return words, moments, docs


def test_a_round_equals_brute_force(judged):
    """Counts and moments of labelled documents, and those of the pseudo-labels of one round."""
    docs, labels = judged
    rows = Q.durable(Q.features(docs))
    own = plain(docs)
    y = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in labels.where("doc_id < 400").collect()}
    good = labels.where("doc_id < 400").selectExpr("doc_id", "int(quality = 1 AND toxic = 0) AS y")
    model = Q.train(rows, good, rounds=1)
    model.sure = np.array([[0.2, 0.8], [0.3, 0.7]])  # so that both views have something to say
    odds = dict(zip(model.units.tolist(), model.odds.tolist()))

    def expected(by_text, by_meta):
        words, m, n = {}, Q.Moments.none(), [0, 0]
        for key, (units, features) in own.items():
            if (t := by_text(key)) is not None:
                m.n[t] += 1
                m.x[t] += features
                m.xx[t] += np.outer(features.astype(float), features.astype(float))
            if (c := by_meta(key)) is not None:
                n[c] += 1
                for u in units:
                    pair = words.setdefault(u, [0, 0])
                    pair[1 - c] += 1
        return {u: tuple(p) for u, p in words.items()}, m.flat(), (n[1], n[0])

    got = totals(Q.tally(rows.join(good, "doc_id")))
    want = expected(y.get, y.get)
    assert got[0] == want[0] and got[2] == want[2] and np.allclose(got[1], want[1])

    def view(key, which):
        units, features = own[key]
        o = np.array([odds[u] for u in units if u in odds])
        t = model.fit_text[0] + model.fit_text[1] * (Q.evidence(o) @ model.text)
        m = model.fit_meta[0] + model.fit_meta[1] * (features.astype(float) @ model.meta)
        return (t, m)[which]

    def sure(which):
        def label(key):
            if key in y:
                return None
            p = Q.chance(view(key, which))
            lo, hi = model.sure[which]
            return 1 if p >= hi else 0 if p <= lo else None

        return label

    free = rows.join(good, "doc_id", "left").where("y IS NULL")
    got, want = totals(Q.tally(free, model)), expected(sure(0), sure(1))
    assert got[2] == want[2] and sum(got[2]) > 0
    assert got[0] == want[0] and np.allclose(got[1], want[1])

    scored = {r.doc_id: r for r in Q.score(rows, model).collect()}
    for key in own:
        t, m = view(key, 0), view(key, 1)
        p = Q.chance(model.both @ np.array([1.0, t, m, min(t, m)]))
        r = scored[key]
        assert max(abs(r.p_text - Q.chance(t)), abs(r.p_meta - Q.chance(m)), abs(r.score - p)) < 2e-6
        assert r.kept == (r.score >= Q.KEEP)


def test_quality_hostile(spark, hostile, hostile_rows, empty):
    labels = spark.createDataFrame([(20 + i, i % 2, 0) for i in range(10)] + [(1, None, 1), (None, 1, 0), (2, 1, None), (20, 1, 0)], LABELS)
    got = Q.score_quality(hostile, labels).collect()
    assert len(got) == len(hostile_rows)
    got = Q.score_quality(hostile, labels.limit(0)).collect()
    assert all(r.score is None and r.kept for r in got)
    assert Q.score_quality(empty, labels).count() == 0


def test_long_and_empty_texts_are_scored(spark, judged, hostile):
    docs, labels = judged
    model = taught(docs, labels.selectExpr("doc_id", "int(quality = 1 AND toxic = 0) AS y"))
    got = {r.doc_id: r.score for r in Q.score(Q.features(hostile), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
