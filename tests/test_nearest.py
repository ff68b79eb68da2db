"""Nearest strings with and without blocking, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions.similarity import jaro_winkler
from tabulon.operators.nearest import nearest, nearest_jaro_winkler, part_features


@pytest.mark.parametrize("direct", [0, 500])
def test_blocking_is_exact(spark, direct):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 9))) for _ in range(60)]

    def edited(w):
        w = list(w)
        for _ in range(draw.randint(0, 4)):
            i = draw.randint(0, len(w))
            w[i : i + draw.randint(0, 1)] = draw.choice(["", "a", "b", "x"])
        return "".join(w)

    targets = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "t string, o int")
    values = spark.createDataFrame([(edited(draw.choice(words)),) for _ in range(150)] + [(None,), ("",), ("a",)], "v string")
    got = {r.value: (r.target, r.distance) for r in nearest(values, "v", targets, "t", "o", direct=direct).collect()}
    pairs = values.where("v is not null").distinct().crossJoin(targets).select("v", F.struct(F.levenshtein("v", "t").alias("d"), "o", "t").alias("b"))
    want = {r.v: (r.b.t, r.b.d) for r in pairs.groupBy("v").agg(F.min("b").alias("b")).collect()}
    assert got == want


def best(value, targets):
    return min((round(1 - jaro_winkler(value, t), 9), o, t) for t, o in targets)


@pytest.mark.parametrize("scores", [(), (0.9, 0.75), (0.99, 0.5)])
def test_jaro_winkler_as_all_pairs(spark, scores):
    draw = random.Random(7)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(draw.randint(1, n)))
    words = [word("abcdef", 9) for _ in range(120)] + [word("abMNé", 30) for _ in range(40)] + ["same", "same", "aaaaaaaa"]
    targets = [(w, k) for k, w in enumerate(words)]
    values = [word("abcdef", 9) for _ in range(150)] + [word("abMNé xyz", 25) for _ in range(60)] + words[:20] + ["zzz", "", "a", "q"]
    got = nearest_jaro_winkler(spark.createDataFrame([(v,) for v in [*values, None]], "v string"), "v", spark.createDataFrame([*targets, (None, 0)], "t string, o int"), "t", "o", scores)
    want = {v: best(v, targets) for v in values}
    assert {r.value: (r.distance, r.target) for r in got.collect()} == {v: (d, t) for v, (d, _, t) in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_jaro_winkler_without_targets_and_with_an_empty_one(spark):
    values = spark.createDataFrame([("",), ("ab",)], "v string")
    find = lambda rows: {r.value: (r.target, r.distance) for r in nearest_jaro_winkler(values, "v", spark.createDataFrame(rows, "t string, o int"), "t", "o").collect()}
    assert find([]) == {"": (None, None), "ab": (None, None)}
    assert find([("x", 1), ("", 2)]) == {"": ("", 0.9), "ab": ("x", 1.0)}
    assert find([("x", 3), ("y", 2)]) == {"": ("y", 1.0), "ab": ("y", 1.0)}


def test_jaro_winkler_over_a_large_dictionary(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(5, 12)))
    targets = [(word(), k) for k in range(100_000)]
    values = []
    for k in range(12):
        w = list(targets[k * 8000][0])
        w[draw.randrange(len(w))] = draw.choice("abcxyz")
        values.append("".join(w))
    got = nearest_jaro_winkler(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame(targets, "t string, o int"), "t", "o")
    assert {r.value: (r.distance, r.target) for r in got.collect()} == {v: (b[0], b[2]) for v in values for b in [best(v, targets)]}


def test_part_features_by_both_distances(spark):
    values = spark.createDataFrame([("serum",), ("blod",)], "v string")
    parts = {"system": spark.createDataFrame([("blood", 1), ("serum", 2)], "text string, ord int")}
    got = {r.value: r for r in part_features(values, "v", parts, {"lv": nearest, "jw": nearest_jaro_winkler}).collect()}
    assert got["serum"].system_lv == got["serum"].system_jw == "serum" and got["serum"].system_jw_dist == 0
    assert got["blod"].system_lv == "blood" and got["blod"].system_lv_dist == 1 and got["blod"].system_jw == "blood"


def test_jaro_winkler_of_names_that_differ_in_their_digits(spark):
    """Blocks on both sides and two passes, against all pairs; a tenth of the names of 0.1 GB."""
    targets = [(f"Supplier#{k:09d}", k) for k in range(600)]
    values = [f"Customer#{k:09d}" for k in range(0, 9000, 61)]
    got = nearest_jaro_winkler(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame(targets, "t string, o int"), "t", "o", block=50, other=200)
    assert {r.value: (r.distance, r.target) for r in got.collect()} == {v: (b[0], b[2]) for v in values for b in [best(v, targets)]}


def test_jaro_winkler_looks_at_few_pairs(monkeypatch):
    from tabulon.operators import jaro

    compared, plain = [], jaro.scores
    monkeypatch.setattr(jaro, "scores", lambda a, x, *rest: compared.append(len(x)) or plain(a, x, *rest))
    values, targets = [f"Customer#{k:09d}" for k in range(0, 90_000, 45)], [f"Supplier#{k:09d}" for k in range(6000)]
    d, at = jaro.closest(values, targets, (0.9, 0.75))
    assert sum(compared) < len(values) * len(targets) / 30
    for k in range(0, 2000, 400):
        assert (d[k], at[k]) == min((round(1 - jaro_winkler(values[k], t), 9), i) for i, t in enumerate(targets))
