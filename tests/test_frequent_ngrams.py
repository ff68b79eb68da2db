"""The most frequent runs are found without counting all runs; the same as by counting all."""

import random
from collections import Counter

import pytest

from tabulon.operators import corpus


@pytest.mark.parametrize("low, high, n, few, odd", [(1, 3, 40, 1000, []), (1, 3, 5000, 1000, []), (1, 3, 40, 3, []), (2, 4, 30, 1000, []), (1, 2, 25, 1000, [["a b", "w1"], ["a", "b"]] * 30), (3, 3, 10, 1000, [])])
def test_as_by_counting_all(spark, low, high, n, few, odd):
    rng = random.Random(5)
    rows = [[f"w{int(60 * rng.random() ** 3)}" for _ in range(rng.randint(0, 30))] for _ in range(200)] + [["x"], [], ["w0"] * 20] + odd
    counts = Counter(" ".join(t[i : i + k]) for t in rows for k in range(low, high + 1) for i in range(len(t) - k + 1))
    want = [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]
    df = spark.createDataFrame([(t,) for t in rows], "t array<string>")
    assert sorted(r.term for r in corpus.frequent_ngrams(df, "t", low, high, n, few).collect()) == sorted(want)


def test_rare_runs_are_not_counted(spark, monkeypatch):
    rows = [["a", "b", f"x{i}", f"y{i}", "a", "b"] for i in range(50)]
    df, kept = spark.createDataFrame([(t,) for t in rows], "t array<string>"), []
    real = corpus.written
    monkeypatch.setattr(corpus, "written", lambda df, name="step": kept.append(real(df, name)) or kept[-1])
    assert {r.term for r in corpus.frequent_ngrams(df, "t", 1, 3, 2).collect()} == {"a", "a b"}
    assert [k.count() for k in kept] == [102, 1, 0]
