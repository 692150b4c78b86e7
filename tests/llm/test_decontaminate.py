import random
import re
from collections import defaultdict

import pytest

from verdigris.llm import decontaminate as D

ITEM = "Maria buys 12 apples and 3 kg of sugar at the market, then sells 12 apples to her neighbour for 5 dollars each before lunch."
OTHER = "a short passage about rivers flowing from high mountains down into the wide warm sea"
PADDING = "Some other words come first in this text. "


def item(text=ITEM, i=1):
    return (i, text)


def find(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return D.leaks(d, b, **options)


CASES = {
    "verbatim": (ITEM, True, False),
    "within": (PADDING * 30 + ITEM + " And more follows here." * 30, True, False),
    "other case and marks": (PADDING + ITEM.replace(",", " --").replace("lunch.", "lunch!"), True, False),
    "new numbers, names and units": ("Maria buys 40 apples and 7 lb of sugar at the market, then sells 40 apples to her neighbour for 9 euros each before lunch.", True, True),
    "numbers that don't correspond": ("Maria buys 40 apples and 40 kg of sugar at the market, then sells 41 apples to her neighbour for 40 dollars each before lunch.", False, None),
    "half": (" ".join(ITEM.split()[:17]) + " and nothing else of it follows", True, False),
    "a fragment": (" ".join(ITEM.split()[:9]) + " and nothing else of it follows", False, None),
    "clean": (PADDING * 10, False, None),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    text, leaked, changed = CASES[name]
    got = find(spark, [(1, text)], [item()]).collect()
    assert len(got) == leaked
    if leaked:
        assert got[0].reparameterised == changed
        assert got[0].coverage >= 0.5


def test_names_are_slots(spark):
    a = "Yesterday in Paris the driver asked Anna whether the train to Lyon would leave on time or later than that."
    b = "Yesterday in Rome the driver asked Berta whether the train to Milan would leave on time or later than that."
    assert find(spark, [(1, b)], [item(a)]).first().reparameterised
    mixed = "Yesterday in Rome the driver asked Rome whether the train to Milan would leave on time or later than that."
    assert find(spark, [(1, mixed)], [item(a)], coverage=0.95).count() == 0


def test_items_without_a_usable_window_are_found_verbatim(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2 + 9?"), (2, "Compute 48 * 17 + 365 - 12 / 4 + 9 * 8."), (3, "Name three primes."), (4, "Add " + " + ".join(map(str, range(100, 180))) + ".")]
    docs = [(10 + i, PADDING + text.upper() + " And more follows.") for i, text in items] + [(1, PADDING + "What is 12 + 7 * 3 - 4 / 2 + 8?"), (2, "Name four primes.")]
    got = {(r.doc_id, r.item_id, r.coverage, r.reparameterised) for r in find(spark, docs, items).collect()}
    assert got == {(10 + i, i, 1.0, False) for i, _ in items}


def test_verbatim_passages_match_wherever_they_stand_in_any_case(spark):
    question = "What is the capital of France?"
    docs = [(1, "Quiz question: " + question), (2, question.lower()), (3, 'they asked "' + question + '"'), (4, "Quiz question: Where is the capital of France?"), (5, ITEM.lower()), (6, question)]
    got = {(r.doc_id, r.item_id) for r in find(spark, docs, [item(question, 1), item(ITEM, 2)]).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 2), (6, 1)}


def test_values_may_coincide_and_one_clash_costs_its_windows_alone(spark):
    asked = "A farmer has 3 red apples and 5 green pears in a basket under the old tree, and she wants to share all of it with 2 friends by 9 in the morning."
    same = asked.replace("3", "4").replace("5", "4")
    clash = asked.replace("3", "4") + " Then 3 come."
    twice = asked.replace("2 friends", "3 friends")
    apart = twice.replace("3 red", "6 red").replace("3 friends", "7 friends").replace("5 green", "8 green")
    docs = [(1, same), (2, clash), (3, apart)]
    got = {(r.doc_id, r.item_id, r.reparameterised, r.coverage == 1) for r in find(spark, docs, [(1, asked), (2, twice)]).collect()}
    assert got >= {(1, 1, True, True), (2, 1, True, True), (3, 2, True, False)}


def test_names_that_begin_sentences_are_slots(spark):
    items = [(1, "Tom had 5 red apples."), (2, "Tom had 5 red apples and gave some of them to the poor children. Maria counted what was left after that day.")]
    docs = [(1, "Anna had 9 red apples."), (2, items[1][1].replace("Tom", "Anna").replace("5", "9").replace("Maria", "Lucy")), (3, "We had 9 red apples."), (4, "The poor had 9 green apples.")]
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in find(spark, docs, items).collect()}
    assert got == {(1, 1, True), (2, 2, True), (2, 1, True)}


def test_verbatim_copies_of_any_item_are_found(spark):
    items = [(1, "Alice has 3 apples."), (2, "What is 3 + 4 * 5 - 6?"), (3, "Tom had 5 red apples."), (4, ITEM)]
    docs = [(i, PADDING + t + " More.") for i, t in items] + [(9, "Alice has 4 apples. What is 3 + 4 * 5 - 7?")]
    assert {(r.doc_id, r.item_id) for r in find(spark, docs, items).collect()} == {(i, i) for i, _ in items}


def tokens_of(text):
    """(token, slot type) by the rules as written: 0 number, 1 unit, 2 name, 3 capital at a start, None."""
    out, before = [], "end"
    for tok in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?\n]+", text):
        if tok[0] in ".!?\n":
            before = "end"
        elif tok[0] in "0123456789":
            out.append((tok, 0))
            before = "num"
        else:
            name = tok[0] != tok[0].lower() and (len(tok) == 1 or tok != tok.upper())
            out.append((tok.lower(), 1 if before == "num" and tok.lower() in D.UNITS else (3 if before == "end" else 2) if name else None))
            before = "word"
    return out


def brute(docs, items, coverage=D.COVERAGE):
    """Every document with every item, window by window; no hash and no join."""
    shown = [{0, 1, 2}, {0, 1, 2, 3}, {0, 1}, set()]
    view = lambda tokens, kind: [("\0", min(s, 2), w) if s in shown[kind] else (w,) for w, s in tokens]
    shape = lambda window: [x[:2] if len(x) == 3 else x for x in window]
    rows = lambda pairs: {i: tokens_of(t) for i, t in pairs if i is not None and t}
    found = set()
    documents = rows(docs)
    for i, item in rows(items).items():
        size = min(D.WINDOW, len(item))
        usable = {k: [p for p in range(len(item) - size + 1) if 2 * sum(len(x) == 1 for x in view(item, k)[p : p + size]) >= size] if size >= D.SHORTEST else [] for k in range(3)}
        if not any(usable.values()) and item:
            usable, size = {3: [0]}, len(item)
        for j, doc in documents.items():
            for kind, starts in sorted(usable.items()):
                b, d = view(item, kind), view(doc, kind)
                met = defaultdict(list)
                for p in starts:
                    for q in range(len(d) - size + 1):
                        if shape(d[q : q + size]) == shape(b[p : p + size]):
                            met[q - p].append(p)
                spots = set()
                for off, at in met.items():
                    pairs = {(b[k][1], b[k][2], d[k + off][2]) for p in at for k in range(p, p + size) if len(b[k]) == 3}
                    bad = {(t, x) for t, x, y in pairs for u, v, z in pairs if t == u and ((x == v and y != z) or (t == 2 and x != v and y == z))}
                    bad |= {(t, x) for t, x, y in pairs if t == 2 and x != y and {x, y} & D.OPENERS}
                    spots |= {p for p in at if not any(len(b[k]) == 3 and (b[k][1], b[k][2]) in bad for k in range(p, p + size))}
                if starts and len(spots) >= coverage * len(starts):
                    found.add((j, i, len(spots), len(starts)))
                    break
    return found


def test_brute_force(spark):
    docs = [(k, text) for k, (text, _, _) in enumerate(CASES.values())] + [(90, OTHER + " " + ITEM + " " + OTHER), (91, ITEM + " " + ITEM.replace("12", "13")), (92, "one two three four five")]
    items = [item(), item(OTHER, 2), (3, "one two three four five"), (4, "too short an"), (5, "1 2 3 4 5 6 7 8 9"), (6, OTHER + " and rivers")]
    got = {(r.doc_id, r.item_id, r.matched, r.total) for r in find(spark, docs, items).collect()}
    assert got == brute(docs, items)
    assert (92, 3, 1, 1) in got


def test_brute_force_on_random_texts(spark):
    rng = random.Random(11)
    words = ["the", "red", "apples", "Tom", "Anna", "Rome", "had", "of", "The", "What", "is", "kg", "m", "3", "4", "5.5", "NASA", ".", "?", "in", "tree", "under", "every"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 9, 14, 30]))) for i in range(30)] + [(30, "3 4 5.5 kg 3 4 4 m 3")]
    docs = [(i, text(rng.choice([0, 4, 40]))) for i in range(20)]
    for i, t in items:  # altered copies, several in a document
        changed = " ".join(rng.choice(["3", "4", "5.5"]) if w in "345.5" and rng.random() < 0.5 else rng.choice(["Tom", "Anna", "Rome"]) if w in ("Tom", "Anna", "Rome") else w for w in t.split())
        docs.append((100 + i, f"{text(3)} {changed} {text(5)} {t}"))
    got = {(r.doc_id, r.item_id, r.matched, r.total) for r in find(spark, docs, items).collect()}
    assert got == brute(docs, items)
    assert len(got) > 40


def test_small_bitmap_changes_nothing(spark):
    docs = [(k, text) for k, (text, _, _) in enumerate(CASES.values())]
    assert find(spark, docs, [item()], bits=8).collect().__len__() == find(spark, docs, [item()]).count()


def test_hostile(spark, hostile, empty):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "!!!")], "item_id bigint, text string")
    docs = hostile.unionByName(hostile.limit(1).selectExpr(*[f"'{ITEM}' AS text" if c == "text" else "77L AS doc_id" if c == "doc_id" else c for c in hostile.columns]))
    got = D.leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(77, 1, 1.0)]
    left = D.drop_leaks(docs, items)
    assert left.columns == docs.columns
    assert left.count() == hostile.count()
    assert D.leaks(empty, items).count() == 0
    assert D.leaks(docs, items.limit(0)).count() == 0
    assert D.drop_leaks(docs, items.limit(0)).count() == docs.count()
