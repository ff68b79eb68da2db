"""Hash tree and NBSVM against plain versions of them."""

import math
import zlib

import numpy as np
import xxhash

from tabulon.llm import hash_tree, nbsvm


def draw(doc, level, nodes):
    def score(node, weight):
        h = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42) if doc is not None else 42
        for x in (level, node):
            h = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), h)
        return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight

    return min((score(n, w), n) for n, w in nodes)[1]


def descend(doc, tree):
    parent = -1
    for level in range(3):
        parent = draw(doc, level, tree.children(level)[parent])
    return parent


def test_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()} | {-5: "", 1 << 61: "Grüße"}
    tree = hash_tree.Tree.regular(40)
    rows = hash_tree.shard_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tree).collect()
    got = {r.doc_id: (r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows}
    assert got == {d: (len(t.encode()) + 16, zlib.crc32(t.encode()), descend(d, tree), descend(d, tree.grown())) for d, t in texts.items()}


def test_weights():
    """Draws follow the weights, and a change of one weight moves rows only across the subtrees above it."""
    tree = hash_tree.Tree(tuple((i // 4, i // 2, i, 1.0 + i % 2) for i in range(8)))
    heavier = tree.reweighted(3, 6.0)
    before, after = [descend(d, tree) for d in range(4000)], [descend(d, heavier) for d in range(4000)]
    share = np.bincount(before, minlength=8) / 4000
    assert np.abs(share - np.array([1, 2] * 4) / 12).max() < 0.03
    # no row moves between shards of the region whose weight stayed
    assert not [1 for x, y in zip(before, after, strict=True) if x != y and x >= 4 and y >= 4]


def test_counts_and_hinge():
    """Log-count ratios by counting, and a solution of the dual that meets its optimality conditions."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    y = np.where([5 in r or 7 in r for r in rows], 1.0, -1.0)
    r = nbsvm.log_count_ratios(rows, y, 30)
    up = {f: sum(f in x for x, t in zip(rows, y, strict=True) if t > 0) for f in range(30)}
    down = {f: sum(f in x for x, t in zip(rows, y, strict=True) if t < 0) for f in range(30)}
    kinds = sum(up[f] + down[f] > 0 for f in range(30))
    for f in range(30):
        want = math.log((1 + up[f]) / (kinds + sum(up.values()))) - math.log((1 + down[f]) / (kinds + sum(down.values())))
        assert abs(r[f] - (want if up[f] + down[f] > 1 else 0)) < 1e-12
    w, bias = nbsvm.dual_coordinate_descent(rows, r, y, 1.0, 2000)
    values = [r[i] / np.linalg.norm(r[i]) for i in rows]
    upper = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def loss(w, bias):
        return (w @ w + bias * bias) / 2 + sum(u * max(0.0, 1 - t * (w[i] @ v + bias)) for i, v, t, u in zip(rows, values, y, upper, strict=True))

    best = loss(w, bias)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.05, 30), bias + rng.normal(0, 0.05)) > best - 1e-2


def test_scores(spark, small):
    """Scores of all rows from the fitted model, word by word in plain Python."""
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = nbsvm.fit(docs, labels)
    used, pair = np.frombuffer(model[0], np.int32).tolist(), np.frombuffer(model[1]).reshape(-1, 2)
    weight = {f: (float(np.float32(a)), float(np.float32(b))) for f, (a, b) in zip(used, pair, strict=True)}
    feature = nbsvm.Indicators(model[5])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in nbsvm.score(docs, model).collect():
        own = [weight.get(f, (0.0, 0.0)) for f in set(feature([texts[row.doc_id] or ""])[0].tolist())]
        norm = math.sqrt(sum(a * a for a, _ in own)) or 1.0
        m = sum(a * b for a, b in own) / norm + model[2]
        assert abs(row.score - 1 / (1 + math.exp(-(model[3] * m + model[4])))) < 1e-5


def test_whole_shape():
    """Words that differ only behind their first characters have different shapes."""
    a, b = nbsvm._shape("aA1" * 8 + "x"), nbsvm._shape("aA1" * 8 + "9")
    assert a != b and len(a) > 12


def test_rows_of_one_id_keep_to_the_bound(spark):
    """One labelled id on most rows: copies count once, and different texts are drawn to the bound."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 400)], "doc_id long, quality int")
    copies = spark.range(20000).selectExpr("7L as doc_id", "'the same text' as text")
    texts = spark.range(20000).selectExpr("9L as doc_id", "concat('text ', id) as text")
    rest = spark.range(1, 400).selectExpr("id as doc_id", "concat('own ', id) as text")
    assert nbsvm.train_rows(copies.union(rest), labels, "quality", 6000).count() <= 400
    got = nbsvm.train_rows(copies.union(texts).union(rest), labels, "quality", 6000)
    assert 2000 < got.count() <= 6600 and got.distinct().count() == got.count()
    assert got.where("crc32(cast(doc_id as string)) % 4 = 2").count() == 0
    assert nbsvm.train_rows(rest, labels, "quality", 6000).count() == nbsvm.train_rows(rest.union(rest), labels, "quality", 6000).count()
