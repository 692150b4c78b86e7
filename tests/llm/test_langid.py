import random

import pytest
from llm_data import make_words, sentence

from verdigris.llm import langid as L

LETTERS = {"aa": "abcdeilmnorst", "bb": "bdfghkopuvwxyz", "cc": "aeiouklmnprß"}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    words = {lang: make_words(i, 600, letters) for i, (lang, letters) in enumerate(LETTERS.items())}
    rows = []
    for i in range(300):
        lang = rng.choice(list(LETTERS))
        # a third of the words were never seen in training
        text = " ".join(rng.choice(words[lang]) + (rng.choice(LETTERS[lang]) * 2 if rng.random() < 0.3 else "") for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(table):
    model = L.train(L.sample(table.where("doc_id < 200")))
    rest = table.where("doc_id >= 200")
    got = L.identify(rest, model).join(rest, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert sum(r.kept for r in got) >= 0.97 * len(got)


def test_words_come_first_then_longer_grams(table):
    model = L.train(L.sample(table))
    word = next(iter(model.units[0]))
    assert list(model.score(word)) == list(model.logp[model.units[0][word]])
    unseen = "qq" + word[1:] + "qq"
    assert unseen not in model.units[0]
    marked = f"<{unseen}>"
    for n in range(L.LONGEST, 0, -1):
        rows = [model.units[n][g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in model.units[n]]
        if rows:
            want = [sum(int(model.logp[r][k]) for r in rows) // len(rows) - L.BACKOFF for k in range(len(model.langs))]
            break
    assert list(model.score(unseen)) == want
    assert model.score("日本") is None or "<" in model.units[1]


def test_new_words_are_scored_together(table, monkeypatch):
    model = L.train(L.sample(table))
    rng = random.Random(9)
    words = [*list(model.units[0])[:50], "", "a", "日本", "aü日本ß", "q" * 5_000, "\U0001f600x", "\ud800a"]
    words += ["".join(rng.choice("abcdeinorstß日") for _ in range(rng.randint(1, 12))) for _ in range(2_000)]
    want = {w: model.score(w) for w in words}
    one_by_one = L.Model.score
    monkeypatch.setattr(L.Model, "score", None)
    memo = L.Scores(model)
    assert memo.grams is not None
    memo.learn(words)
    # a model of too many characters is asked word by word
    monkeypatch.setattr(L.Model, "score", one_by_one)
    monkeypatch.setattr(L.Grams, "of", lambda model: None)
    other = L.Scores(model)
    other.learn(words)
    for w in set(words):
        assert (memo[w] == 0) == (other[w] == 0) == (want[w] is None)
        if want[w] is not None:
            assert list(memo.table[memo[w]]) == list(other.table[other[w]]) == list(want[w])


def test_brute_force(table):
    model = L.train(L.sample(table))
    for r in L.identify(table, model).join(table, "doc_id").limit(40).collect():
        totals = [0] * len(model.langs)
        for w in L.WORD.findall(r.text.lower()):
            for k, v in enumerate(model.score(w)):
                totals[k] += int(v)
        best = max(range(len(totals)), key=lambda k: (totals[k], -k))
        assert (r.lang_pred, r.score) == (model.langs[best], totals[best])
        assert r["lead"] == totals[best] - max(t for k, t in enumerate(totals) if k != best)


def test_sample_is_bounded(table):
    assert L.sample(table, per_lang=7).groupBy("lang").count().where("count <> 7").count() == 0


def test_hostile(spark, table, hostile, hostile_rows, empty):
    model = L.train(L.sample(hostile))
    got = L.identify(hostile, model).collect()
    assert len(got) == len(hostile_rows)
    by_id = {r.doc_id: r for r in got}
    for i in (4, 5, 6, 7):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].kept) == (None, 0, False)
    assert by_id[8].words == 200_000
    kept = L.keep_identified(hostile)
    assert kept.columns == hostile.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {4, 5, 6, 7, None} & set(ids)
    assert L.identify(empty, model).count() == 0
    assert L.identify_trained_here(empty).count() == 0
    assert L.keep_identified(empty).count() == 0
    nothing = L.train(L.sample(empty))
    assert {r.lang_pred for r in L.identify(table, nothing).collect()} == {None}
