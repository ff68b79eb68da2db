"""Rows and entries meet pairs without a broadcast of theirs, however small their files are."""

import math
import re

import pytest

from tabulon.functions import similarity as sim
from tabulon.operators import pairs, tfidf


@pytest.mark.parametrize("table", [False, True])
def test_rows_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch, table):
    names = [(i, f"c{i % 4}", ["brass bolt", "steel nut", "copper cap"][i % 3], "red, blue") for i in range(400)] + [(400, "c1", None, "")]
    spark.createDataFrame(names, "id long, code string, name string, kind string").write.parquet(f"{tmp_path}/rows")
    rows, plans, write = spark.read.parquet(f"{tmp_path}/rows"), [], pairs.written if hasattr(pairs, "written") else None
    monkeypatch.setattr(pairs, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name), raising=False)
    found = pairs.candidate_pairs(rows, rows, "id", "code", k=2)
    if table:
        out = pairs.pair_table(found, rows, rows, "id", "code", ["name"], ["kind"], kinds=())
    else:
        out = pairs.pair_features(found, rows, rows, "id", "code", ["name"], ["kind"], sim.ratio_column)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = re.findall(r"BroadcastHashJoin \[(?:id|candidate)#.*", "\n".join(plans))
    assert [j for j in joins if "LeftSemi" not in j] == []  # the keys of pairs may be sent
    assert out.count() == 4 * 3 * 3 and out.select("id").distinct().count() == 12


def test_term_counts_of_many_texts_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    names = [(i, f"c{i % 4}", f"bolt {'abcdefgh'[i % 8]}x{'klmnopqr'[i // 8 % 8]}{'stuvwxyz'[i // 64]}", "red") for i in range(400)]
    spark.createDataFrame(names, "id long, code string, name string, kind string").write.parquet(f"{tmp_path}/rows")
    rows, plans, sizes, write = spark.read.parquet(f"{tmp_path}/rows"), [], {}, pairs.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(pairs, "written", watched)
    found = pairs.candidate_pairs(rows, rows, "id", "code", k=2)
    out = pairs.pair_features(found, rows, rows, "id", "code", ["name"], ["kind"], sim.ratio_column)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert re.findall(r"BroadcastHashJoin \[term#.*", "\n".join(plans)) == []
    assert sizes["words"] > 400 and sizes["weights"] <= 4 * 3 * 2 + 1  # 12 rows have pairs: two words each, and one kind


@pytest.mark.parametrize("form", [{}, {"sublinear": True, "smooth": False}, {"norm": False}])
def test_weights_of_some_texts_are_those_of_all(spark, form):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", None]), (3, ["c", "b"]), (4, []), (None, ["a"])], "id long, t array<string>")
    every = {(r.id, r.term): r.weight for r in tfidf.tfidf(docs, "id", "t", **form).collect() if r.id in (1, 2, 4)}
    some = tfidf.tfidf(docs, "id", "t", of=spark.createDataFrame([(1,), (2,), (2,), (4,), (9,), (None,)], "id long"), **form)
    got = {(r.id, r.term): r.weight for r in some.collect()}
    assert set(got) == set(every) == {(1, "a"), (1, "b"), (2, "b")} and all(math.isclose(got[k], every[k], rel_tol=1e-12) for k in got)
