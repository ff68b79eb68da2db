"""Scores on the border of two classes do not go by the order of rows."""

import random

from tabulon.catalog import QUERIES


def test_a_mean_of_exactly_the_border(spark, tmp_path):
    draw, orders = random.Random(4), {}
    values = [k / 100 for k in range(11)] * 20
    while len(orders) < 2:
        draw.shuffle(values)
        total = 0.0
        for v in values:
            total += v
        orders.setdefault(total / len(values) * 18 < 0.9, list(values))
    rows = [(int(below), v, f, s) for below, own in orders.items() for v, f, s in zip(own, "AN" * 110, "FO" * 110, strict=True)]
    rows += [(2, 0.06, "A", "F")] * 9 + [(3, 0.0, "A", "F")] * 9 + [(4, 0.06, "A", "F")] * 4
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["class"]: r.n for r in QUERIES["performance_classes"](spark, str(tmp_path)).collect()}
    assert got == {"hard": 3, "easy": 1, "low": 1}
    assert {r["class"]: r.n_codes for r in QUERIES["case_report"](spark, str(tmp_path)).collect()} == got
