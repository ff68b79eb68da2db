"""Given n-grams leave other runs out before they are counted; the same counts without that."""

from collections import Counter

import pytest

from tabulon.operators import tfidf


@pytest.mark.parametrize("ordered", [True, False])
def test_other_runs_are_left_out_early(spark, ordered):
    texts = [["a", "b", "a", "1:a", ""], ["b", "a"], [], ["ab", None, "a"], ["a", "b", "b", "a"]]
    grams = [["a", "b"], ["b", "a"], ["a"], ["ab"], ["1:a", ""], [None, "a"], ["a", None], ["x", "y", "z"]]
    docs, given = spark.createDataFrame([(t,) for t in texts], "t array<string>"), spark.createDataFrame([(g,) for g in grams], "g array<string>")
    key = tuple if ordered else lambda g: tuple(sorted(g, key=str))
    met = Counter(key(t[i : i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
    for few in (0, 100):
        out = tfidf.given_ngrams(docs, "t", given, "g", ordered, few)
        assert {tuple(r.gram): r.n for r in out.collect()} == {tuple(g): met[key(g)] for g in grams}
        assert ("LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()) == (few > 0)


@pytest.mark.parametrize("ordered", [True, False])
def test_runs_meet_given_grams_as_numbers(spark, ordered):
    """Other runs are never made as rows: no run is exploded. Texts cut into slices of a few tokens give the same counts."""
    texts = [[str(i * j % 7) for j in range(1, 40)] for i in range(30)] + [None, [], ["0"]]
    grams = [["0"], ["1", "2"], ["2", "1"], ["6", "5", "4"], ["3", "3", "3", "3"], ["9", "1"]]
    docs, given = spark.createDataFrame([(t,) for t in texts], "t array<string>"), spark.createDataFrame([(g,) for g in grams], "g array<string>")
    key = tuple if ordered else lambda g: tuple(sorted(g))
    met = Counter(key(t[i : i + n]) for t in texts if t for n in (1, 2, 3, 4) for i in range(len(t) - n + 1))
    out = tfidf.given_ngrams(docs, "t", given, "g", ordered)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r.gram): r.n for r in out.collect()} == {tuple(g): met[key(g)] for g in grams}
    found = Counter()
    for r in tfidf._met_runs(docs, "t", grams, ordered, some=50).collect():
        found[key(r.run)] += r.n
    assert {tuple(g): found[key(g)] for g in grams} == {tuple(g): met[key(g)] for g in grams}
