"""Labels of the nearest rows by cosine, against plain Python over all pairs."""

import math
import random

from tabulon.operators.cluster import knn_agreement


def test_agreement_in_blocks_as_all_pairs(spark):
    draw = random.Random(3)
    vectors = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    vectors += [vectors[0]] * 12 + [[0.0] * 4] + [None] * 2
    rows = [(k, v, None if k % 11 == 5 else k % 3) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")

    def cosine(x, y):
        dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
        norm = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
        return dot(x, y) / norm if norm else 0.0

    want = {}
    for q, x, label in rows:
        if q % 4 == 0:
            near = sorted((math.inf if x is None or y is None else round(1 - cosine(x, y), 9), k) for k, y, _ in rows if k != q)[:5]
            told = [rows[k][2] == label for _, k in near if label is not None and rows[k][2] is not None]
            want[q] = sum(told) / len(told) if told else None
    out = knn_agreement(df, "id", "v", "label", df.where("id % 4 = 0"), block=20)
    assert {r.id: r.agree for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "collect_list" not in plan  # pairs stay inside the tasks
