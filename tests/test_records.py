"""Files of records, folds and data sets, ingest over several batches, models, and values given in advance."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import similarity as sim
from tabulon.functions import text as tx
from tabulon.operators import corpus, encode, metrics, models, predicates, profile
from tabulon.sources import files
from tabulon.streaming.ingest import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_arff(spark, tmp_path):
    (tmp_path / "r.arff").write_text("% note\n@relation r\n@attribute n numeric\n@attribute kind {p,q}\n@data\n1.5,p\n?,q\n\n2,?\n")
    assert sorted(map(tuple, files.read_arff(spark, f"file://{tmp_path}/r.arff").collect()), key=str) == [(1.5, "p"), (2.0, None), (None, "q")]


def test_folds_of_methods(spark, tmp_path):
    for name, value in (("train-a-0", 1), ("test-a-0", 2), ("test-a-1", 3), ("train-b-0", 4), ("test-b-0", 5)):
        (tmp_path / "deep" / name[-3]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "deep" / name[-3] / f"{name}.csv").write_text(f"id,score\n{value},0.5\n")
    base = f"file://{tmp_path}/deep"
    found = files.find_files(spark, base, "*.csv")
    assert found.count() == 5 and files.find_files(spark, base, "train*").count() == 2
    assert rows(files.match_folds(found).select("method", "fold")) == [("a", 0), ("b", 0)]
    tests = files.read_methods(spark, base, "id int, score double")
    assert rows(tests.select("id", "method", "fold")) == [(2, "a", 0), (3, "a", 1), (5, "b", 0)]
    assert rows(files.random_fold(tests).groupBy("method").count()) == [("a", 1), ("b", 1)]
    both = files.prior_and_posterior(tests, tests.withColumn("score", F.lit(0.7)), ["id", "method", "fold"])
    assert rows(both.select("id", "prior", "posterior")) == [(2, 0.5, 0.7), (3, 0.5, 0.7), (5, 0.5, 0.7)]


def test_saved_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    make = lambda: spark.createDataFrame([("k", "some words")], "code string, document string")
    assert rows(corpus.load_corpus(spark, path, make)) == [("k", "some words")]
    assert rows(corpus.load_corpus(spark, path, lambda: None)) == [("k", "some words")]


def test_choice_of_corpus(spark):
    df = spark.createDataFrame([("r1", "c", "x y"), ("r2", "c", "z")], "id string, code string, text string")
    given = spark.createDataFrame([("g", "doc")], "id string, document string")
    merged = spark.createDataFrame([("c", "all")], "code string, document string")
    pick = lambda *a: rows(corpus.choose_corpus(*a))
    assert pick(given, df, "id", ["text"], "code", merged) == [("g", "doc")]
    assert pick(None, df, "id", ["text"], "code", merged) == [("r1", "X Y"), ("r2", "Z")]
    assert pick(None, df, "id", None, "code", merged) == [("c", "all")]
    assert pick(None, df, "id", None, "code", None) == [("c", "X Y Z")]


def test_made_up_records(spark):
    made = files.sample_records(spark, 300)
    assert made.count() == 300 and rows(made) == rows(files.sample_records(spark, 300).repartition(5))
    assert 0 < made.where("code is null").count() < 60 and made.where("code like '%-%'").count() > 20


def test_arff_with_quotes(spark, tmp_path):
    (tmp_path / "q.arff").write_text("@attribute 'long name' numeric\n@ATTRIBUTE \"b c\" string\n@attribute d {x,'y z'}\n@data\n1.5,'q,r','y z'\n-2 , \"it, 's\" ,x\n?,'don\\'t',?\n3,plain text,\n")
    out = files.read_arff(spark, f"file://{tmp_path}/q.arff")
    assert out.columns == ["long name", "b c", "d"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1.5, "q,r", "y z"), (-2.0, "it, 's", "x"), (None, "don't", None), (3.0, "plain text", None)], key=str)


def test_ingest_over_batches(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    batches = [[(1, "a"), (2, "a"), (3, "b"), (4, None)], [(1, "a"), (5, "a"), (6, "a"), (7, "b"), (8, "b"), (9, None)], [(5, "a"), (10, "c")]]
    for batch in batches:
        spark.createDataFrame(batch, "id int, code string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, "id int, code string", target, f"file://{tmp_path}/check", "id", "code", top_up=3).awaitTermination()
    got = spark.read.parquet(target)
    assert got.select("id").distinct().count() == got.count()
    assert rows(got.groupBy("code").count()) == [("a", 3), ("b", 3), ("c", 1), ("unknown", 1)]


def test_upsert_leaves_nothing_beside(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(path)
    files.upsert(spark, path, spark.createDataFrame([(1, "b")], "k int, v string"), ["k"])
    assert rows(spark.read.parquet(path)) == [(1, "b")] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


@pytest.mark.parametrize(
    "values,weights,answer",
    [
        ([7, 1, 2, 4, 10], [1, 1 / 3, 1 / 3, 1 / 3, 1], 7), ([7, 1, 2, 4, 10], [1, 1, 1, 1, 1], 4), ([7, 1, 2, 4, 10, 15], [1, 1 / 3, 1 / 3, 1 / 3, 1, 1], 8.5), ([1, 2, 4, 7, 10, 15], [1 / 3, 1 / 3, 1 / 3, 1, 1, 1], 8.5),
        ([0, 10, 20, 30], [30, 191, 9, 0], 10), ([1, 2, 3, 4, 5], [10, 1, 1, 1, 9], 2.5), ([30, 40, 50, 60, 35], [1, 3, 5, 4, 2], 50), ([2, 0.6, 1.3, 0.3, 0.3, 1.7, 0.7, 1.7, 0.4], [2, 2, 0, 1, 2, 2, 1, 6, 0], 1.7),
    ],
)
def test_weighted_medians(spark, values, weights, answer):
    """Values and answers are fixed."""
    df = spark.createDataFrame([(float(v), float(w)) for v, w in zip(values, weights, strict=True)], "v double, w double")
    assert profile.weighted_median(df, [], "v", "w").first()[0] == pytest.approx(answer)


def test_interval(spark):
    df = spark.createDataFrame([(x,) for x in (0.92, 0.75, 0.78, 0.89, 0.99, 0.98)], "x double")
    r = profile.order_interval(df, [], "x").first()
    assert (r.low, r.high, r.median) == (0.75, 0.99, pytest.approx(0.905)) and r.mean == pytest.approx(0.885)


def test_common_strings(spark):
    """Sequences and answers are fixed."""
    cases = [(["666222054263314443712", "5432127413542377777", "6664664565464057425"], "54442"), (["abacbdab", "bdcaba", "cbacaa"], "baa"), (["a", None], "")]
    df = spark.createDataFrame(cases, "t array<string>, want string")
    assert df.where(sim.common_subsequence_column(F.col("t")) != F.col("want")).count() == 0
    parts = spark.createDataFrame([("MICROALBUMIN", "ALBUMIN"), ("abxcd", "cdyab"), ("", "x")], "a string, b string")
    assert [r[0] for r in parts.select(sim.common_substring_text(F.col("a"), F.col("b"))).collect()] == ["ALBUMIN", "ab", ""]


def test_predicates(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a.b (c)",), ("axb c",)], "t string")
    hits = lambda text: [r[0] for r in df.where(F.expr(text)).collect()]
    assert hits(predicates.search_text(["t"], ["50%"])) == ["50% off"]
    assert hits(predicates.search_text(["t"], ["a.b (c)"], "regex")) == ["a.b (c)"]
    assert hits(predicates.search_text(["t"], ["500 OFF"], exact=True)) == ["500 off"]
    with pytest.raises(ValueError):
        predicates.search_text(["t"], ["x"], "other")


def test_texts(spark):
    df = spark.createDataFrame([("North Clinic: blood test", "25000"), ("Northern blood", "41001")], "t string, k string")
    assert [r[0] for r in df.select(tx.clean_tag(F.col("t"), ["north clinic"])).collect()] == ["BLOOD TEST", "NORTHERN BLOOD"]
    assert [r[0] for r in df.select(tx.codes_of(["clinic"], F.col("t"), F.col("k"))).collect()] == ["250.00", None]
    told = files.import_records(spark.createDataFrame([("7", "Glucose", "x/y z"), ("Sodium", "3", "a")], "name string, value string, note string"), "name", "value", ["note"])
    assert [(r[0], r[2]) for r in told.collect()] == [("Glucose", "X Y Z"), ("Sodium", "A")]


def test_scaling_and_joins(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 7.0)], "k int, a double, b double")
    assert not encode.needs_scaling(df, ["a"]) and encode.needs_scaling(df, ["a", "b"])
    assert profile.join_all(df, df.select("k", F.col("a").alias("c")), "k").count() == 2
    with pytest.raises(ValueError):
        profile.join_all(df, df.where("k = 1").select("k"), "k")


def test_class_scores(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 20 == 0, "rare").when(F.col("id") % 100 == 7, "few").otherwise("common").alias("code"), ((F.col("id") % 20 == 0).cast("double") * 50 + F.col("id") % 13).alias("x"))
    got = {r.code: (r.n_pos, r.total, r.fmax) for r in models.class_scores(df, "id", "code", ["x"], ["rare", "few", "none"]).collect()}
    assert got["few"] == (4, 4, -1.0) and got["none"] == (0, 0, -1.0)
    assert got["rare"][:2] == (20, 220) and got["rare"][2] > 0.99


def test_linear_models(spark):
    df = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - F.col("b"))
    best = models.elastic_net_search(df, "id", ["a", "b"], "y", [0.0, 1.0], [0.5]).first()
    assert best.penalty == 0.0 and best.rmse < 1e-3
    curve = models.learning_curve(df.withColumn("z", (F.col("a") > 3).cast("int")), "id", ["a", "b"], "z", [0.5, 1.0]).collect()
    assert [r.n for r in curve] == sorted(r.n for r in curve) and curve[-1].test_auc == pytest.approx(1.0)


def test_threshold_classifier(spark, tmp_path):
    df = spark.createDataFrame([(0.9, 0.4), (0.2, None)], "a double, b double")
    model = models.ThresholdClassifier(inputCols=["a", "b"], outputCol="hit")
    model.save(f"file://{tmp_path}/m")
    again = models.ThresholdClassifier.load(f"file://{tmp_path}/m")
    assert [r.hit for r in again.transform(df).collect()] == [1, 0] and again.positives(df) == 1


def test_estimates(spark):
    df = spark.createDataFrame([(1, 0.9, 0.9), (0, 0.8, 0.1), (1, 0.7, 0.8), (0, 0.1, 0.2)], "y int, s double, t double")
    r = metrics.compare_estimates(df.select("y", "s"), df.select("y", F.col("t").alias("s")), "y", "s").first()
    assert r.auc_before == 0.75 and r.auc_after == 1.0 and r.auc_gain == 0.25
    named = metrics.divide_methods(spark.createDataFrame([("lr.1",), ("rf",), ("x",)], "m string"), "m", {"linear": ["lr", "svm"], "tree": ["rf"]})
    assert [x.group for x in named.collect()] == ["linear", "tree", "other"]
