"""Splits leave rows where they are and cut every class as a ranking of all its rows does."""

import hashlib

import pytest

from tabulon.operators import running, sampling


def plain(rows, ratio, seed):
    """The keys of the train rows."""
    groups = {}
    for key, label in rows:
        groups.setdefault(label, []).append(key)
    digest = lambda k: hashlib.md5("|".join([str(seed), *([] if k is None else [str(k)])]).encode()).hexdigest()
    out = []
    for keys in groups.values():
        keys.sort(key=lambda k: (digest(k), k is not None, k))
        out += keys[: int(ratio * len(keys))]
    return sorted(out, key=str)


@pytest.mark.parametrize("ratio, seed", [(0.8, 0), (0.5, 3), (0.0, 1), (1.0, 2)])
def test_split_as_ranked(spark, ratio, seed):
    rows = [(i, ["a", "b", None][i % 3] if i % 100 else "rare") for i in range(3000)] + [(-1, "one"), (None, "a")]
    df = spark.createDataFrame(rows, "id long, c string")
    got = sampling.split(df, "id", ratio, "c", seed)
    assert got.columns == ["id", "c", "part"] and got.count() == len(rows)
    assert sorted((r.id for r in got.where("part = 'train'").collect()), key=str) == plain(rows, ratio, seed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan.lower()


def test_rows_of_one_key_at_the_cut(spark):
    df = spark.createDataFrame([(7, "a")] * 10 + [(i, "b") for i in range(10)], "id long, c string")
    got = {(r.c, r.part): r["count"] for r in sampling.split(df, "id", 0.5, "c").groupBy("c", "part").count().collect()}
    assert got == {(c, p): 5 for c in "ab" for p in ("train", "test")}


def test_weighted_choice_is_the_same_in_one_part_and_in_many(spark, monkeypatch):
    weights = spark.createDataFrame([(f"v{i:03d}", i % 5) for i in range(300)], "v string, w long")
    keys = spark.range(400)
    draws = []
    for rows in (200_000, 40):
        monkeypatch.setattr(running, "ROWS_A_PART", rows)
        draws.append(sorted(map(tuple, sampling.weighted_choice(weights, "v", "w", keys, "id").collect())))
    assert len(draws[0]) == 400 and draws[0] == draws[1]
