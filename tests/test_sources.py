import pytest
import gzip

from pyspark.sql import functions as F

from tabulon.functions import similarity as sim
from tabulon.operators import cluster, encode, models, pairs, profile, roles, sampling
from tabulon.operators.running import running_sums, values_at
from tabulon.sources import files
from tabulon.streaming.ingest import ingest, windowed_counts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code|mean\nx|1.5\ny|\n")
    assert rows(files.read_delimited(spark, f"file://{tmp_path}/a.csv", "code string, mean double", "|", ["code"])) == [("x",), ("y",)]
    out = f"file://{tmp_path}/out"
    files.write_delimited(spark.createDataFrame([("x", 1)], "a string, b int"), out, "|")
    assert rows(files.read_delimited(spark, out, "a string, b int", "|")) == [("x", 1)]


def test_folds(spark, tmp_path):
    for i in (0, 1):
        with gzip.open(tmp_path / f"validation-{i}.csv.gz", "wt") as f:
            f.write(f"id,label\n{i},1\n")
    assert rows(files.read_folds(spark, f"file://{tmp_path}/validation-*.csv.gz", "id int, label int")) == [(0, 1, 0), (1, 1, 1)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "acronyms").write_text("cbc\t1\tcomplete blood count\n")
    (tmp_path / "settings").write_text("# note\na = 1\nb=x=y\n\n")
    (tmp_path / "h.arff").write_text("@relation r\n@attribute kind {p, q}\n@attribute n numeric\n")
    (tmp_path / "words").write_bytes("caf\xe9 au  lait\n".encode("latin-1"))
    assert rows(files.read_acronyms(spark, f"file://{tmp_path}/acronyms")) == [("CBC", "COMPLETE BLOOD COUNT")]
    assert rows(files.read_properties(spark, f"file://{tmp_path}/settings")) == [("a", "1"), ("b", "x=y")]
    assert rows(files.read_nominals(spark, f"file://{tmp_path}/h.arff")) == [("kind", ["p", "q"])]
    assert files.read_tokens(spark, f"file://{tmp_path}/words").first()[0] == ["caf\xe9", "au", "lait"]


def test_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    files.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_ingest(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for batch in ([(1, "12-3"), (1, "12-3"), (2, None)], [(3, "request")]):
        spark.createDataFrame(batch, "id int, code string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, "id int, code string", target, f"file://{tmp_path}/check", "id", "code").awaitTermination()
    assert rows(spark.read.parquet(target).select("id", "code")) == [(1, "123"), (2, "unknown"), (3, "unknown")]


def test_ingest_keeps_its_state_without_the_target(spark, tmp_path):
    """A restarted stream knows keys and class sizes from its state: what it wrote may have been moved away."""
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for n, batch in enumerate([[(1, "1"), (2, "1"), (3, "2")], [(1, "1"), (4, "1"), (5, "1"), (6, "2"), (3, "9")], [(4, "1"), (5, "1"), (7, "2"), (8, "2"), (9, "3")]]):
        spark.createDataFrame(batch, "id int, code string").write.mode("append").parquet(source)
        ingest(spark, source, "id int, code string", f"{target}{n}", f"file://{tmp_path}/check", "id", "code", top_up=3).awaitTermination()
    sizes = [sorted((r.code, r["count"]) for r in spark.read.parquet(f"{target}{n}").groupBy("code").count().collect()) for n in range(3)]
    assert sizes == [[("1", 2), ("2", 1)], [("1", 1), ("2", 1)], [("2", 1), ("3", 1)]]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(target).count()


def test_windowed_counts(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    assert windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_running_sums(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, float(i * 7 % 1000), i) for i in range(1000)], "g int, o double, v long")
    got = {(r.g, r.o): (r.run_v, r.all_v) for r in running_sums(df, ["g"], "o", ["v"]).collect()}
    data = [(r.g, r.o, r.v) for r in df.collect()]
    assert got == {(g, o): (sum(v for h, p, v in data if h == g and p <= o), sum(v for h, _, v in data if h == g)) for g, o, _ in data}


def test_values_at(spark):
    df = spark.createDataFrame([(x,) for x in (0.92, 0.75, 0.78, 0.89, 0.99, 0.98, None)], "x double")
    assert tuple(values_at(df, [], "x", {"low": (0.05, False), "high": (0.95, False), "mid": (0.5, True)}).first()) == (0.75, 0.99, 0.905)
    assert profile.five_number(spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 7.0)], "x double"), [], "x").first()["q1"] == 1.75
    assert values_at(df.where("x > 5"), [], "x", {"low": (0.5, True)}).first()[0] is None


def test_hot_class(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)))
    parts = {(r.c, r.part): r["count"] for r in sampling.split(df, "id", 0.8, "c").groupBy("c", "part").count().collect()}
    assert parts[("hot", "train")] == 2320 and parts[("hot", "test")] == 580
    assert sampling.split(df, "id", 0.5).where("part = 'train'").count() == 1500
    assert sampling.bootstrap(df, "c", "id").groupBy("c").count().exceptAll(df.groupBy("c").count()).count() == 0


def test_subsequences():
    assert sim.common_subsequence("1234", "1224533324") == 4 and sim.common_subsequence("", "a") == 0
    assert sim.ratio("ABC", "ABC") == 1.0


def test_roles():
    columns = ["test_a", "test_b", "meta_x", "code", "z"]
    found = roles.by_prefix(columns, {"matching": ["test_"], "meta": ["meta_"], "target": ["code"]})
    assert found == {"matching": ["test_a", "test_b"], "meta": ["meta_x"], "target": ["code"], "other": ["z"]}
    assert roles.pair_names(["a"], ["x", "y"], "s") == [("a", "x", "a_x_s"), ("a", "y", "a_y_s")]
    assert roles.short_names(["test_a_long"], "test_", {"long": "L"}) == {"test_a_long": "a_L"}


def test_encode_columns(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i else None, f"v{i % 12}", None) for i in range(40)], "k int, a string, b string, c string")
    out = encode.encode_columns(df, ["a", "b", "c"])
    assert set(out.columns) == {"k", "a_a", "a_b", "a_unknown", *[f"b_{i}" for i in range(4)]}
    assert {r.k: (r.a_a, r.a_b, r.a_unknown) for r in out.collect()}[0] == (0, 0, 1)


def test_train_and_test(spark):
    df = spark.createDataFrame([(i, f"c{i % 4}") for i in range(20)], "k int, code string")
    scores = spark.createDataFrame([("c0", 0.95), ("c1", 0.5), ("c2", 1.0), ("c3", -1.0)], "code string, score double")
    train, test = pairs.train_and_test(df, scores, df, "k", "code")
    assert {r.code for r in train.collect()} == {"c0", "c2"} and {(r.code, r.label) for r in test.collect()} == {("c1", 1), ("c3", 1)}
    assert train.where("label = 0 and code = candidate").count() == 0


def test_gap_prefers_the_true_number(spark):
    far = [(i, [float(i % 3) * 50 + (i * 7 % 10) / 10, float(i % 3 == 1) * 80 + (i * 3 % 10) / 10]) for i in range(150)]
    gaps = dict(cluster.gap_statistic(spark.createDataFrame(far, "k int, v array<double>"), "k", "v", [1 + 1, 3]))
    assert gaps[3] > gaps[2]


def test_score_candidates(spark):
    df = spark.createDataFrame([(i, 10.0 * (i > 50) + i % 3, int(i > 50)) for i in range(100)], "k int, x double, label int")
    out = models.score_candidates(df, df, ["x"], "label").collect()
    assert all(r.confident == (r.label == 1) for r in out)
