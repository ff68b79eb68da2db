"""Chance agreement and draws against plain sums."""

import math
import random

from pyspark.sql import functions as F

from tabulon.operators import cluster, profile, sampling


def plain(x, y, n):
    g = math.lgamma
    fixed = g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1)
    return sum(k / n * math.log(n * k / (x * y)) * math.exp(fixed - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(n - x - y + k + 1)) for k in range(max(1, x + y - n), min(x, y) + 1))


def test_expected_share():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 400)
        x, y = rng.randint(1, n), rng.randint(1, n)
        assert math.isclose(cluster.expected_share(x, y, n), plain(x, y, n), rel_tol=1e-7, abs_tol=1e-11)
    x, y, n = 40_000, 70_000, 200_000
    assert math.isclose(cluster.expected_share(x, y, n), plain(x, y, n), rel_tol=1e-3, abs_tol=1e-9)
    assert abs(cluster.expected_share(10**9, 2 * 10**9, 4 * 10**9)) < 1e-6  # a large table takes a moment, not an hour


def test_group_counts_and_maxima_with_null_keys(spark):
    rows = [(k % 3 or None, k % 5, float(k % 7)) for k in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, x double")
    sizes, top = {}, {}
    for a, b, x in rows:
        sizes[a, b] = sizes.get((a, b), 0) + 1
        top[a, b] = max(top.get((a, b), x), x)
    got = profile.with_group_count(df, ["a", "b"]).collect()
    assert len(got) == 100 and all(r.n_group == sizes[r.a, r.b] for r in got)
    assert sorted(map(str, map(tuple, profile.at_group_max(df, ["a", "b"], "x").collect()))) == sorted(str(r) for r in rows if r[2] == top[r[0], r[1]])


def test_weighted_choice(spark):
    weights = spark.createDataFrame([("aa", 5), ("ab", 0), ("b", 3), ("c", 2)], "v string, w long")
    keys = spark.range(5000)
    out = sampling.weighted_choice(weights, "v", "w", keys, "id")
    counts = {r.v: r["count"] for r in out.groupBy("v").count().collect()}
    assert sum(counts.values()) == 5000 and "ab" not in counts
    assert abs(counts["aa"] - 2500) < 150 and abs(counts["b"] - 1500) < 150
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    u = {r.id: r.u for r in keys.select("id", sampling.uniform(0, "id").alias("u")).collect()}
    assert all(r.v == ("aa" if u[r.id] < 0.5 else "b" if u[r.id] < 0.8 else "c") for r in out.collect())
    assert out.select(F.count_distinct("id")).first()[0] == 5000
