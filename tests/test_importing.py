"""Imports, saved tables, cohorts, tables of pairs, and parts of ordered values, against plain Python."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from tabulon.catalog import QUERIES, SQL
from tabulon.functions.similarity import ratio_column
from tabulon.operators import encode, imports, pairs, running, sampling, tfidf
from tabulon.sources import files


def rows(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


@pytest.mark.parametrize("name", ["five_number", "weighted_median", "order_interval", "roc_auc", "fmax", "categorify", "weighted_choice", "interval_sample", "ranked_predictions"])
def test_many_parts_give_the_same_rows(spark, small, name, monkeypatch):
    monkeypatch.setattr(running, "ROWS_A_PART", 50)
    monkeypatch.setattr(running, "PARTS", 16)
    compare(spark, small, QUERIES[name], SQL[name])


def test_strings_of_one_prefix_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(running, "ROWS_A_PART", 20)
    df = spark.range(400).select(F.concat(F.lit("same-"), F.lpad("id", 4, "0")).alias("s")).union(spark.createDataFrame([(None,), ("é",), ("",), ("é",)], "s string"))
    edges = running.part_edges(df.where("s is not null").distinct(), "s")
    assert 10 < len(edges) <= 21
    sizes = running.in_parts(df.where("s is not null").distinct(), "s").groupBy("_part").count().collect()
    assert max(r["count"] for r in sizes) < 100
    want = sorted({r.s for r in df.collect() if r.s is not None}, key=str.encode)
    assert rows(encode.ordinals(df, "s"), "ordinal", "s") == list(enumerate(want))


def test_no_rows_have_no_parts(spark):
    for t in ("string", "double"):
        empty = spark.createDataFrame([], f"k int, v {t}")
        assert running.part_edges(empty, "v") == []
        assert running.ranked_by(empty, ["k"], "v", []).count() == 0
    assert running.running_sums(spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0)], "k int, v double"), [], "v", ["k"]).select("v", "run_k", "all_k").distinct().count() == 2


def test_import_of_odd_texts(spark, tmp_path):
    path = f"file://{tmp_path}/import"
    data = [(1, "A", 'one "two"|three', "x"), (2, "A", "line\nbreak ONE", None), (3, None, None, "x"), (4, "B", "12", "12"), (5, "B", "12", "high"), (6, "A", "line\nbreak ONE", "x"), (7, "C", "gone", "x"), (8, "A", "% % ONE", "x")]
    df = spark.createDataFrame(data, "id int, site string, name string, value string")
    sites = df.where("site <> 'C'").select("site").union(spark.createDataFrame([("A",)], "site string"))
    imports.import_source(df, "site", ["name"], path, value="value", named=["name"], sites=sites, most=0.3)
    # a null site is no site of the table of sites
    assert rows(imports.read_import(spark, path, "records"), "id", "site", "name", "value") == [(1, "A", "ONE TWO THREE", "x"), (2, "A", "LINE\nBREAK ONE", None), (4, "B", "", "12"), (5, "B", "HIGH", "high"), (6, "A", "LINE\nBREAK ONE", "x"), (8, "A", "% ONE", "x")]
    told = rows(imports.read_import(spark, path, "cleaned"), "text", "Site", "Original", "Cleaned")
    assert told == sorted([("name", "A", "% % ONE", "%"), ("name", "A", 'ONE "TWO"|THREE', "TWO THREE"), ("name", "A", "LINE\nBREAK ONE", "LINE\nBREAK"), ("name", "B", "", ""), ("name", "B", "HIGH", "")])
    counts = {(s, t): (n, round(p, 6)) for s, t, n, p in rows(imports.read_import(spark, path, "word_counts"), "Site", "Term", "Count", "Percent")}
    assert counts[("A", "ONE")] == (3, round(300 / 7, 6)) and counts[("A", "%")] == (1, round(100 / 7, 6)) and counts[("B", "HIGH")] == (1, 100.0)
    assert rows(imports.read_import(spark, path, "discarded"), "Site", "DiscardedName") == [("A", "ONE"), ("B", "HIGH")]
    imports.import_source(df.limit(0), "site", ["name"], f"{path}-empty")
    assert all(imports.read_import(spark, f"{path}-empty", n).isEmpty() for n in ("records", *imports.OUTPUTS))


def test_a_failed_write_is_not_taken_for_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part-0.parquet").write_bytes(b"half a file")
    one = spark.createDataFrame([(1,)], "a int")
    assert rows(files.load_or_make(spark, path, lambda: one)) == [(1,)]
    assert rows(files.load_or_make(spark, path, lambda: 1 / 0)) == [(1,)]
    with pytest.raises(Exception):  # noqa: B017
        files.load_or_make(spark, f"{path}2", lambda: one.select(F.raise_error(F.lit("broken")).alias("a")))
    assert rows(files.load_or_make(spark, f"{path}2", lambda: one)) == [(1,)]
    files.load_or_make(spark, f"{path}3", lambda: one.limit(0))
    assert files.load_or_make(spark, f"{path}3", lambda: one).isEmpty()
    assert rows(files.load_or_make(spark, f"{path}3", lambda: one, again_if_empty=True)) == [(1,)]


def test_controls_are_no_cases(spark):
    pool = spark.range(1000).select("id", (F.col("id") % 3).alias("x"))
    cases = pool.where("id % 50 = 0").select("id", F.lit("yes").alias("code"))
    out = sampling.with_controls(cases, pool, "id", times=2)
    assert out.groupBy("control").count().orderBy("control").collect() == [(0, 20), (1, 40)]
    assert out.where("control = 1 and (id % 50 = 0 or code is not null or x is null)").isEmpty()
    assert out.select("id").distinct().count() == 60
    with pytest.raises(ValueError, match="980"):
        sampling.with_controls(cases, pool, "id", times=50)


def test_given_ngrams_against_plain_counting(spark):
    docs = [["a", "b", "a", "b"], ["b", "a"], [], None, ["c"]]
    grams = [["a"], ["a", "b"], ["b", "a"], ["b", "a", "b"], ["z"], [], ["a", "b"]]
    d, g = spark.createDataFrame([(x,) for x in docs], "t array<string>"), spark.createDataFrame([(x,) for x in grams], "g array<string>")
    for ordered in (True, False):
        like = (lambda x: x) if ordered else sorted
        want = {}
        for x in grams:
            if x:
                want[tuple(x)] = sum(like(t[i : i + len(x)]) == like(x) for t in docs if t for i in range(len(t) - len(x) + 1))
        assert {tuple(r.gram): r.n for r in tfidf.given_ngrams(d, "t", g, "g", ordered).collect()} == want
    assert tfidf.given_ngrams(d, "t", g.where("size(g) = 0"), "g").isEmpty()


def test_table_of_pairs(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet")
    texts, parts = part.select("p_partkey", "p_name"), part.select("p_brand", "p_type")
    made = pairs.candidate_pairs(part.select("p_partkey", "p_brand"), part.select("p_brand"), "p_partkey", "p_brand", per_code=1, k=2)
    features = pairs.pair_features(made, texts, parts, "p_partkey", "p_brand", ["p_name"], ["p_type"], ratio_column)
    out = pairs.pair_table(made, texts, parts, "p_partkey", "p_brand", ["p_name"], ["p_type"], ratio_column, test=True)
    name = [c for c in features.columns if c.endswith("_sdist")][0]
    assert rows(out, "p_partkey", "assignment", name) == rows(features, "p_partkey", "candidate", name)
    assert rows(out.select("label").distinct()) == [(-1,)] and {"t_p_name", "d_p_type"} <= set(out.columns)
    only = pairs.pair_table(made, texts, parts, "p_partkey", "p_brand", ["p_name"], ["p_type"], ratio_column, kinds=("tfidf",))
    assert [c for c in only.columns if c.endswith(("_sdist", "_tfidf"))] == [name.replace("_sdist", "_tfidf")]


def test_ranked_predictions_flag_doubt_and_cut(spark):
    df = spark.createDataFrame([("a", 1, 0, 0.9), ("a", 2, 1, 0.99), ("a", 3, 0, 0.95), ("a", 4, 0, 0.95), ("b", 5, 1, 0.1)], "code string, id int, label int, score double")
    out = pairs.ranked_predictions(df, "code", ["id"], "label", "score", top=3)
    assert rows(out, "code", "place", "id", "doubtful") == [("a", 1, 3, False), ("a", 2, 4, False), ("a", 3, 1, False), ("b", 1, 5, True)]
