"""Common substrings and subsequences against plain versions, and on long texts."""

import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tabulon.functions import similarity as sim


def plain_substring(a, b):
    return next((a[i : i + n] for n in range(min(len(a), len(b)), 0, -1) for i in range(len(a) - n + 1) if a[i : i + n] in b), "")


def test_substrings_as_all_tried():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert sim.longest_common_substring(a, b) == plain_substring(a, b)


def test_substrings_of_long_texts(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    shared = word(300)
    rows = [(word(2000) + shared + word(2700), word(3000) + shared + word(1700)), ("a" * 5000, "a" * 4999 + "b"), (None, "a"), ("", "a")]
    began = time.time()
    got = spark.createDataFrame(rows, "a string, b string").select(sim.common_substring(F.col("a"), F.col("b")).alias("n"), sim.common_substring_text(F.col("a"), F.col("b")).alias("t")).collect()
    assert time.time() - began < 30
    assert shared in got[0].t and got[0].n == len(got[0].t) < 340
    assert [(r.n, r.t) for r in got[1:]] == [(4999, "a" * 4999), (None, None), (0, "")]


def within(s, t):
    it = iter(t)
    return all(c in it for c in s)


def plain_subsequence(texts):
    short = min(texts, key=len)
    return next(n for n in range(len(short), -1, -1) if any(all(within(c, t) for t in texts) for c in combinations(short, n)))


@pytest.mark.parametrize("most", [0, 3, 50_000])
def test_subsequences_as_all_tried(most):
    rng = random.Random(3)
    for _ in range(150):
        texts = ["".join(rng.choice("abcd"[: rng.randint(2, 4)]) for _ in range(rng.randint(1, 10))) for _ in range(rng.randint(1, 5))]
        got = sim.common_subsequence_of(texts, most)
        assert all(within(got, t) for t in texts) and len(got) == plain_subsequence(texts)
    assert sim.common_subsequence_of(["abc", ""]) == sim.common_subsequence_of([]) == []


def test_subsequences_of_long_texts():
    rng = random.Random(4)
    a, b = (["".join(rng.choice("abcdefgh"))[0] for _ in range(5000)] for _ in range(2))
    began = time.time()
    got = sim.common_subsequence_of([a, b])
    assert len(got) == sim.common_subsequence("".join(a), "".join(b)) and within(got, a) and within(got, b)
    base = [rng.choice("abcdefghij") for _ in range(90)]
    texts = [[c for c in base if rng.random() < 0.9] for _ in range(4)]
    got = sim.common_subsequence_of(texts)
    assert all(within(got, t) for t in texts) and len(got) >= 55
    assert time.time() - began < 20
