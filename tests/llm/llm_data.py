"""Small made-up texts for the tests."""

import random


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def make_words(seed, n=400, letters="abcdefghijklmnopqrstuvwxyz"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n)]
