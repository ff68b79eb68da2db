"""Token similarity and pair features of whole tables against plain versions; clusters and trees against what defines them."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from tabulon.catalog import QUERIES
from tabulon.functions.similarity import longest_common_substring, ratio
from tabulon.operators import cluster, nearest, pairs
from tabulon.functions import similarity as sim


def tokens(text):
    return list(dict.fromkeys(t for t in (text or "").split(" ") if t))


def plain_similarity(a, b, kernel=ratio, least=0.8):
    x, y = tokens(a), tokens(b)
    cells = []
    for p in x:
        for q in y:
            if re.fullmatch("[0-9.]+", p):
                s = float(p == q)
            elif min(len(p), len(q)) == 1 and p[0] != q[0] or len(longest_common_substring(p, q)) / min(len(p), len(q)) < least:
                s = 0.0
            else:
                s = kernel(p, q)
            cells.append((-s, p, q))
    top = sorted(cells)[: max(1, len(y))]
    hits = [c for c in top if c[0] < 0]
    if not top or len(hits) == 1 and len(hits[0][1]) == 1:
        return 0.0
    return -sum(c[0] for c in top) / len(top)


def test_token_similarity_query(spark, small):
    out = QUERIES["token_similarity"](spark, small).collect()
    rows = spark.read.parquet(f"{small}/part.parquet").select("p_name", "p_type").distinct().collect()
    want = {(r.p_name, f"{r.p_name} {r.p_type.lower()}"): plain_similarity(r.p_name, f"{r.p_name} {r.p_type.lower()}") for r in rows}
    assert {(r.a, r.b) for r in out} == set(want)
    assert all(math.isclose(r.similarity, want[r.a, r.b], abs_tol=1e-9) for r in out)


def test_token_similarity_gates(spark):
    cases = [("iron 25", "iron 25 mg"), ("iron 2", "iron 3"), ("a b", "a c"), ("a", "a"), ("", "x"), (None, "x"), ("blood bloods", "blood"), ("microalbumin", "albumin"), ("i ron", "iron i")]
    df = spark.createDataFrame(cases, "a string, b string")
    for r in nearest.token_similarity(df, "a", "b", sim.ratio_column).collect():
        assert math.isclose(r.similarity, plain_similarity(r.a, r.b), abs_tol=1e-9), r


def plain_weights(texts):
    counts = {t: {w: t.split(" ").count(w) for w in t.split(" ")} for t in texts}
    df = {}
    for c in counts.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    out = {}
    for t, c in counts.items():
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[t] = {w: x / size for w, x in v.items()}
    return out


def test_pair_features_query(spark, small):
    rows = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_type")
    data = {r.p_partkey: r for r in rows.collect()}
    entry = {}
    for r in data.values():
        entry[r.p_brand] = max(entry.get(r.p_brand, ""), r.p_name)
    own = {k: {"p_name": r.p_name.upper(), "p_type": r.p_type.upper()} for k, r in data.items()}
    entry = {k: v.upper() for k, v in entry.items()}
    weights = plain_weights({t for v in own.values() for t in v.values()} | set(entry.values()))
    found = pairs.candidate_pairs(rows, rows, "p_partkey", "p_brand")
    got = pairs.pair_features(found, rows, rows, "p_partkey", "p_brand", ["p_name", "p_type"], ["p_name"], sim.ratio_column).collect()
    assert len(got) == found.count() == QUERIES["pair_features"](spark, small).count()
    for r in got:
        b = entry[r.candidate]
        for c in ("p_name", "p_type"):
            a = own[r.p_partkey][c]
            cosine = sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items())
            assert math.isclose(r[f"{c}_p_name_sdist"], plain_similarity(a, b), abs_tol=1e-9), (a, b)
            assert math.isclose(r[f"{c}_p_name_tfidf"], cosine, abs_tol=1e-9), (a, b)


def test_kmeans_rows_are_with_their_nearest_mean(spark, small):
    """A settled clustering: every row is nearest to the mean of its own cluster, but for a few that the last step would still move."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    own = {r.vec_id: r.cluster for r in QUERIES["kmeans_clusters"](spark, small).collect()}
    data = {r.vec_id: np.array(list(r.embedding), float) for r in rows.select("vec_id", "embedding").collect()}
    assert set(own) == set(data) and set(own.values()) == set(range(10))
    means = {c: np.mean([data[k] for k in own if own[k] == c], axis=0) for c in set(own.values())}
    right = sum(min(means, key=lambda c: ((data[k] - means[c]) ** 2).sum()) == own[k] for k in own)
    assert right > 0.9 * len(own)


def test_silhouettes_as_defined(spark):
    """Squared distances, as the evaluator has them, over all pairs."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    own = {r.id: r.cluster for r in cluster.kmeans(df, "v", 3).collect()}
    labels = np.array([own[k] for k in range(len(x))])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    score = []
    for i in range(len(x)):
        same = labels == labels[i]
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        score.append((b - a) / max(a, b))
    got = dict(cluster.silhouette_by_k(df, "v", [3, 5]))
    assert math.isclose(got[3], np.mean(score), abs_tol=1e-6) and got[3] > got[5]


def test_principal_components_as_eigenvectors(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    x = np.column_stack([a, 2 * a + 0.2 * rng.normal(size=200), rng.normal(size=200)])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double, c double")
    got = np.array([list(r.pc) for r in cluster.principal(df, ["a", "b", "c"], 2).orderBy("id").collect()])
    for ddof in (0, 1):
        z = (x - x.mean(0)) / x.std(0, ddof=ddof)
        vectors = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :2]
        if np.allclose(np.abs(got), np.abs(z @ vectors), atol=1e-6):
            return
    raise AssertionError("no such scaling")


def test_gap_is_greatest_at_the_true_number(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    gap = dict(cluster.gap_statistic(df, "id", "v", [1, 2, 3, 4]))
    assert max(gap, key=gap.get) >= 3 and gap[3] > gap[2] > gap[1]


def test_scored_pairs_query_has_probabilities_of_its_labels(spark, small):
    out = QUERIES["scored_pairs"](spark, small)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.where(F.col("confident") != (F.col("score") >= 0.85)).count() == 0
