"""Links are made once; the nearest rows are those of a full ranking."""

import numpy as np
import pytest

from tabulon.operators import metric


@pytest.mark.parametrize("kind", ["plain", "copies", "offset", "huge", "few"])
def test_nearest_against_all_pairs(kind):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(7 if kind == "few" else 900, 8))
    if kind == "copies":
        y[100:700] = y[100]
    y = y + 1e4 if kind == "offset" else y * 1e20 if kind == "huge" else y
    others = np.sort(rng.permutation(5000)[: len(y)])
    x, own = np.concatenate([y[:5], y[-1:] + 0.01]), np.concatenate([others[:5], [9999]])
    got = list(zip(*metric._nearest(x, y, own, others, 10), strict=True))
    for r in range(len(x)):
        d = np.round(metric._distances(x[r : r + 1], y)[0] if kind == "huge" else np.sqrt(((x[r] - y) ** 2).sum(1)), 9)
        want = sorted((d[j], j) for j in range(len(y)) if others[j] != own[r])[:10]
        assert [j for i, j, _ in got if i == r] == [j for _, j in want]


def test_links_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(20)], "a long, b long, weight double").mapInPandas(count, "a long, b long, weight double")
    assert metric.single_linkage(edges, 3).select("cluster").distinct().count() == 3
    assert made.value == 20
