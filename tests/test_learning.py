"""Trees, imputation, stacking against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from tabulon.catalog import QUERIES
from tabulon.operators import encode, models

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def tree(spark, small):
    rows = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", *NAMES, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rows, models.tree(rows.where("l_orderkey % 3 > 0"), NAMES, "y", 5)[0]


def walk(node, row):
    path, sides = [], []
    while node.subtreeDepth() > 0:
        split = node.split()
        left = row[NAMES[split.featureIndex()]] <= split.threshold()
        path.append(NAMES[split.featureIndex()])
        sides.append("left" if left else "right")
        node = node.leftChild() if left else node.rightChild()
    return tuple(path), tuple(sides), node.prediction()


def leaves(node, path=()):
    if node.subtreeDepth() == 0:
        return [(path, node.prediction())]
    step = (*path, NAMES[node.split().featureIndex()])
    return leaves(node.leftChild(), step) + leaves(node.rightChild(), step)


def test_lineage_of_leaves(spark, tree):
    _, model = tree
    got = models.lineage(models.tree_nodes(model, spark), NAMES).orderBy("leaf").collect()
    assert [(tuple(r.path), r.prediction) for r in got] == leaves(model._call_java("rootNode"))
    assert [r.leaf for r in got] == list(range(len(got))) and len(got) > 4


def test_paths_of_unseen_rows(spark, tree):
    rows, model = tree
    unseen = rows.where("l_orderkey % 3 = 0 and l_orderkey < 400")
    got = sorted((r.l_orderkey, *[r[c] for c in NAMES], tuple(r.path), tuple(r.sides), r.prediction) for r in models.row_paths(model, unseen, NAMES).collect())
    root = model._call_java("rootNode")
    assert got == sorted((r.l_orderkey, *[r[c] for c in NAMES], *walk(root, r)) for r in unseen.collect())
    counts = {(r.y, tuple(r.path)): r.n for r in models.path_counts(models.row_paths(model, unseen, NAMES), by="y").collect()}
    want = {}
    for r in unseen.collect():
        k = (r.y, walk(root, r)[0])
        want[k] = want.get(k, 0) + 1
    assert counts == want


def test_a_tree_of_one_leaf(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1)], "x double, y int")
    model, _ = models.tree(rows, ["x"], "y", 3)
    assert [(r.leaf, r.path) for r in models.lineage(models.tree_nodes(model, spark), ["x"]).collect()] == [(0, [])]
    assert models.row_paths(model, rows, ["x"]).count() == 3


def plain_imputation(x, rounds, ridge=1e-6):
    known = ~np.isnan(x)
    mean, std = np.nanmean(x, 0), np.nanstd(x, 0)
    std = np.where(std == 0, 1, std)
    z = np.where(known, (x - mean) / std, 0.0)
    for _ in range(rounds):
        new = z.copy()
        for j in range(x.shape[1]):
            own = known[:, j]
            if own.all():
                continue
            a = np.column_stack([np.ones(len(z)), np.delete(z, j, 1)])
            b = np.linalg.solve(a[own].T @ a[own] + ridge * own.sum() * np.eye(a.shape[1]), a[own].T @ ((x[own, j] - mean[j]) / std[j]))
            new[~own, j] = (a @ b)[~own]
        z = new
    return np.where(known, x, z * std + mean)


def test_chained_imputation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x = np.column_stack([x, x @ [1, 2, -1] + 0.1 * rng.normal(size=300), np.full(300, 7.0)])
    full = x.copy()
    x[rng.random(x.shape) < 0.15] = np.nan
    x[0] = np.nan
    names = list("abcde")
    df = spark.createDataFrame([(k, *[None if np.isnan(v) else float(v) for v in r], None) for k, r in enumerate(x)], "id int, " + ", ".join(f"{c} double" for c in [*names, "never"]))
    for rounds in (0, 1, 6):
        out = encode.impute_chained(df, [*names, "never"], rounds).orderBy("id").collect()
        got = np.array([[r[c] for c in names] for r in out], float)
        assert np.abs(got - plain_imputation(x, rounds)).max() < 1e-6
        assert all(r.never is None for r in out)
    gone = np.isnan(x[1:, 3])
    assert np.abs(got[1:, 3] - full[1:, 3])[gone].mean() < 0.7 * np.abs(np.nanmean(x[:, 3]) - full[1:, 3])[gone].mean()


def test_no_fold_feeds_its_own_level_two(spark):
    """Labels are noise: a learner that has seen a row knows it, one that has not is right half of the time."""
    rng = random.Random(6)
    df = spark.createDataFrame([(k, float(k), rng.randint(0, 1)) for k in range(300)], "id long, x double, y int")
    deep = DecisionTreeClassifier(maxDepth=20, maxBins=300, minInstancesPerNode=1)
    level = models.out_of_fold(df, "id", ["x"], "y", {"deep": deep, "flat": LogisticRegression()}, 4)
    hits = [(r.deep > 0.5) == (r.y == 1) for r in level.collect()]
    assert len(hits) == 300 and sum(hits) / 300 < 0.65
    seen = deep.copy({deep.getParam("labelCol"): "y", deep.getParam("featuresCol"): "v"})
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="v").transform(df)
    assert seen.fit(rows).transform(rows).where("prediction = y").count() > 270


def test_stack_and_curve(spark):
    rng = random.Random(8)
    rows = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(400)]
    df = spark.createDataFrame([(k, a, b, int(a * b + 0.3 * rng.gauss(0, 1) > 0)) for k, a, b in rows], "id long, a double, b double, y int")
    learners = {"tree": DecisionTreeClassifier(maxDepth=4, seed=1), "linear": LogisticRegression()}
    auc = {}
    for r in models.stacked_scores(df, "id", ["a", "b"], "y", learners, 3).collect():
        auc.setdefault(r.method, []).append(r.auc)
    mean = {m: sum(v) / len(v) for m, v in auc.items()}
    assert set(mean) == {"stack", "tree", "linear"} and all(len(v) == 3 for v in auc.values())
    assert mean["tree"] > 0.8 > mean["linear"] and mean["stack"] > mean["tree"] - 0.05
    model, level = models.stack(df, "id", ["a", "b"], "y", learners, 3)
    assert abs(model.coefficients[0]) > abs(model.coefficients[1]) and level.count() == 400
    curve = {r.penalty: r for r in models.validation_curve(df, "id", ["a", "b"], "y", [0.01, 10.0], 3).collect()}
    assert set(curve) == {0.01, 10.0} and all(0 <= r.train_auc <= 1 and 0 <= r.test_auc <= 1 for r in curve.values())


@pytest.mark.parametrize("name, n", [("tree_row_paths", 2), ("imputed_chained", 6000), ("stacked_scores", 12)])
def test_queries(spark, small, name, n):
    out = QUERIES[name](spark, small)
    assert out.count() >= n
    if name == "imputed_chained":
        assert out.where(" or ".join(f"{c} is null" for c in NAMES)).count() == 0


def gradient_descent(x, y, rounds=40000, rate=0.5):
    """A plain solver of the same problem."""
    n, up = len(y), y.sum()
    c = np.where(y > 0, n / (2 * up), n / (2 * (n - up)))
    z, w = np.column_stack([x, np.ones(n)]), np.zeros(x.shape[1] + 1)
    ridge = 1e-6 * n * np.append(np.ones(x.shape[1]), 0)
    for _ in range(rounds):
        w -= rate / n * (z.T @ (c * (1 / (1 + np.exp(-(z @ w))) - y)) + ridge * w)
    return w


def test_fit_as_a_plain_solver():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x @ [1.0, -0.5] + rng.normal(size=200) > 1).astype(float)
    assert np.abs(models.balanced_logistic(x, y) - gradient_descent(x, y)).max() < 1e-4
    p = rng.integers(0, 6, 60) / 5
    t = rng.integers(0, 2, 60).astype(float)
    assert models.best_f(t, p) == max(2 * t[p >= c].sum() / ((p >= c).sum() + t.sum()) for c in np.unique(p))


def test_rows_of_every_class_in_one_pass(spark):
    """Arcs of the ring: each code gets ten times its rows from others, none of its own, and no row twice."""
    df = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("code"))
    sizes = df.groupBy("code").agg(F.count("*").alias("n"))
    rows = models.class_rows(df, sizes, "id", "code", 10, 500).cache()
    got = {r.code: (r.own, r.other, r.ids) for r in rows.groupBy(F.col("_code").alias("code")).agg(F.count_if(F.col("_y") == 1).alias("own"), F.count_if(F.col("_y") == 0).alias("other"), F.count_distinct("id").alias("ids")).collect()}
    n = {r.code: r.n for r in sizes.collect()}
    assert set(got) == set(n) and rows.where("(_y = 1) <> (code = _code)").count() == 0
    for c, (own, other, ids) in got.items():
        assert ids == own + other and (own == n[c] if n[c] <= 500 else 400 < own < 600)
        want = min(20000 - n[c], 10 * min(n[c], 500))
        assert other == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_of_many_classes(spark):
    df = spark.range(6000).select("id", F.concat(F.lit("c"), F.col("id") % 40).alias("code")).withColumn("x", (F.col("code") == "c3").cast("double") * 5 + F.rand(3)).withColumn("z", F.rand(4))
    got = {r.code: r.fmax for r in models.class_scores(df, "id", "code", ["x", "z"], [f"c{k}" for k in range(40)]).collect()}
    assert len(got) == 40 and got["c3"] > 0.99 and sum(v > 0.5 for v in got.values()) == 1
