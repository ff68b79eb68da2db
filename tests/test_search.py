import random

import pytest
from oracle import compare
from pyspark.sql import functions as F

from tabulon.catalog import QUERIES, SQL
from tabulon.operators import search, steps, tfidf


def corpus(spark, n, seed, words=60):
    rng = random.Random(seed)
    texts = [" ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string"), texts


def weights_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r.term] = r.weight
    return out


@pytest.mark.parametrize("k, first", [(1, 1), (3, 2), (7, 1)])
def test_best_codes_as_all_pairs(spark, k, first):
    entries, _ = corpus(spark, 150, 1)
    rows, _ = corpus(spark, 80, 2, words=90)
    count = lambda df: tfidf.term_counts(df.select("id", F.split("text", " ").alias("t")), "id", "t")
    model = search.fit_terms(count(entries), "id")
    codes, own = search.weigh(count(entries), model, "id"), search.weigh(count(rows), model, "id")
    want, dictionary = set(), weights_of(codes)
    for q, terms in weights_of(own).items():
        scored = [(-round(sum(w * d.get(t, 0.0) for t, w in terms.items()), 9), c) for c, d in dictionary.items()]
        want |= {(q, c, round(-s, 6), i + 1) for i, (s, c) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])}
    got = search.best_codes(own, "id", search.build_index(codes, "id"), k, first)
    assert {(r.id, r.code, round(r.score, 6), r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_model_on_unseen_texts(spark, tmp_path):
    entries = spark.createDataFrame([("a", "iron blood"), ("b", "iron serum"), ("c", "zinc")], "code string, text string")
    tokens = lambda c: F.split(c, " ")
    counts = tfidf.term_counts(entries.select("code", tokens(F.col("text")).alias("t")), "code", "t")
    search.save_model(search.fit_terms(counts, "code"), f"file://{tmp_path}/m")
    model = search.load_model(spark, f"file://{tmp_path}/m")
    index = search.build_index(search.weigh(counts, model, "code"), "code", f"file://{tmp_path}/i")
    rows = spark.createDataFrame([(1, "serum iron unknown"), (2, "unknown"), (3, None), (4, ""), (5, "zinc zinc"), (6, "zinc zinc")], "id long, text string")
    found = search.find_codes(rows, "id", "text", tokens, model, index, 2).orderBy("id", "rank").collect()
    assert [(r.id, r.code, r["rank"]) for r in found] == [(1, "b", 1), (1, "a", 2), (5, "c", 1), (6, "c", 1)]
    assert [round(r.score, 6) for r in found if r.id > 1] == [1.0, 1.0]
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (5, "c"), (6, None)], "id long, own string")
    rates = search.hit_rates(search.find_codes(rows, "id", "text", tokens, model, index, 2), truth, "id", "own", 2).orderBy("k").collect()
    assert [(r.k, r.n, r.hits) for r in rates] == [(1, 3, 1), (2, 3, 2)]
    assert search.find_codes(rows.limit(0), "id", "text", tokens, model, index).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(50)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = steps.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.root for r in got.collect()} == {x: find(x) for x in root}


@pytest.mark.parametrize("name", ["code_search", "code_search_hits", "item_search"])
def test_queries(spark, name):
    compare(spark, "/root/testdata/sf0.01", QUERIES[name], SQL[name])


def test_small_index_in_every_task(spark):
    """The same rows as by the general way, with nothing shuffled, keys that repeat and texts without known terms among them."""
    entries, _ = corpus(spark, 40, 1)
    rows, _ = corpus(spark, 300, 2, words=90)
    rows = rows.union(rows.limit(20)).union(spark.createDataFrame([(900, None), (901, ""), (902, "zz")], rows.schema))
    tokens = lambda c: F.split(c, " ")
    counts = tfidf.term_counts(entries.select("id", tokens(F.col("text")).alias("t")), "id", "t")
    model = search.fit_terms(counts, "id")
    index = search.build_index(search.weigh(counts, model, "id"), "id")
    few, general = (search.find_codes(rows, "id", "text", tokens, model, index, 3, cells) for cells in (4_000_000, 0))
    assert few.dtypes == general.dtypes
    plain = lambda df: sorted((r.id, r["rank"], r.code, round(r.score, 7)) for r in df.collect())
    assert plain(few) == plain(general)
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
