import math
import random

import numpy as np
import pytest

from tabulon.catalog import QUERIES
from tabulon.operators import metric


def points(n, dims, seed, spread=0.25):
    rng = random.Random(seed)
    centers = [[rng.uniform(0, 4) for _ in range(dims)] for _ in range(5)]
    rows = [[c + rng.gauss(0, spread) for c in rng.choice(centers)] for _ in range(n)]
    return rows + rows[:10]  # some vectors repeat


def all_pairs(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def plain_dbscan(ids, x, eps, least):
    d = all_pairs(x)
    near = d <= eps
    core = near.sum(1) >= least
    first = {}
    for i, v in enumerate(map(tuple, x.tolist())):
        first.setdefault(v, ids[i])
        first[v] = min(first[v], ids[i])
    name, out = [None] * len(ids), {}
    for i in np.flatnonzero(core):
        if name[i] is None:
            todo, members = [i], {i}
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core):
                    if m not in members:
                        members.add(m)
                        todo.append(m)
            for m in members:
                name[m] = min(ids[q] for q in members)
    for i in range(len(ids)):
        if core[i]:
            out[ids[i]] = (name[i], True)
            continue
        some = [(d[i, j], first[tuple(x[j].tolist())], name[j]) for j in np.flatnonzero(near[i] & core)]
        out[ids[i]] = (min(some)[2] if some else None, False)
    return out


@pytest.mark.parametrize("eps, least, cells, block", [(0.2, 4, 6, 1000), (0.35, 3, 1, 40), (0.3, 5, 12, 25), (3.0, 2, 5, 60)])
def test_dbscan_as_all_pairs(spark, eps, least, cells, block):
    x = points(230, 3, 3)
    ids = list(range(7, 7 + len(x)))
    df = spark.createDataFrame([*zip(ids, x, strict=True), (1000, None)], "id long, v array<double>")
    got = {r.id: (r.cluster, r.core) for r in metric.dbscan(df, "id", "v", eps, least, cells, block=block).collect()}
    assert got.pop(1000) == (None, False)
    assert got == plain_dbscan(ids, np.array(x), eps, least)


def test_density_query_on_its_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([list(r.embedding) for r in rows], float), [r.vec_id for r in rows]
    eps = metric.usual_radius(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id", "embedding")
    got = {r.vec_id: (r.cluster, r.core) for r in QUERIES["density_clusters"](spark, small).collect()}
    assert got == plain_dbscan(ids, x, 0.95 * eps, 3)
    assert len({c for c, _ in got.values()}) > 2


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert metric.dbscan(df, "id", "v", 1.0, 2).count() == 0
    assert metric.spanning_forest(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_neighbours_recall_and_order(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = metric.cell_index(rows, "vec_id", "embedding", 16)
    asked = rows.where("vec_id % 20 = 0")
    got = {}
    for r in metric.neighbours(asked, rows, "vec_id", "embedding", index, 5).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour, r.distance)
    data = rows.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([list(r.embedding) for r in data], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = set(ids[np.lexsort((ids, d))[:5]].tolist())
        own = got[ids[i]]
        hits += len(want & {n for n, _ in own.values()})
        total += 5
        assert [own[k][1] for k in sorted(own)] == sorted(v for _, v in own.values())
        for n, v in own.values():
            assert math.isclose(v, d[ids == n][0], abs_tol=1e-6)
    print("recall at 5:", hits / total, "probes:", index[1], "of", len(index[0]))
    assert hits / total >= 0.9


def test_neighbours_in_blocks(spark):
    x = points(300, 4, 8)
    df = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    index = metric.cell_index(df, "id", "v", 5)
    own = lambda block: sorted(tuple(r) for r in metric.neighbours(df, df, "id", "v", (index[0], 5), 4, block).collect())
    d = all_pairs(np.array(x)).round(9)
    np.fill_diagonal(d, np.inf)
    want = sorted((i, int(j), float(d[i, j]), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4]))
    got = own(1000)
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want] and own(17) == got


def plain_linkage(ids, edges, k):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    kept = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        p, q = sorted((find(a), find(b)))
        if p != q:
            root[q] = p
            kept.append((a, b, w))
    parts = len(ids) - len(kept)
    again = sorted(kept, key=lambda e: (e[2], e[0], e[1]))[: len(kept) - max(0, k - parts)]
    root.update({i: i for i in ids})
    for a, b, _ in again:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return set(kept), {i: find(i) for i in ids}


@pytest.mark.parametrize("seed, n, m, k", [(1, 60, 150, 5), (2, 80, 60, 3), (3, 40, 400, 40)])
def test_forest_and_single_linkage(spark, seed, n, m, k):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 12))) for _ in range(m)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    kept, clusters = plain_linkage(range(n), edges, k)
    assert {tuple(r) for r in metric.spanning_forest(df).collect()} == kept
    nodes = spark.range(n)
    assert {r.id: r.cluster for r in metric.single_linkage(df, k, nodes).collect()} == clusters


def test_linkage_query(spark, small):
    got = {r.vec_id: r.cluster for r in QUERIES["linkage_clusters"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    near = metric.neighbours(rows, rows, "vec_id", "embedding", metric.cell_index(rows, "vec_id", "embedding", 16), 30)
    assert got == plain_linkage([r[0] for r in rows.select("vec_id").collect()], [(r.vec_id, r.neighbour, r.distance) for r in near.collect()], 10)[1]
    assert len(set(got.values())) == 10


def dense_affinity(x, preference, damping, rounds):
    s = -(all_pairs(x) ** 2)
    np.fill_diagonal(s, preference)
    n = len(x)
    r, v = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        m = v + s
        best = m.argmax(1)
        top = m[np.arange(n), best].copy()
        m[np.arange(n), best] = -np.inf
        rival = np.where(np.arange(n)[None] == best[:, None], m.max(1)[:, None], top[:, None])
        r = damping * r + (1 - damping) * (s - rival)
        p = np.maximum(r, 0)
        np.fill_diagonal(p, 0)
        new = np.minimum(0, r.diagonal()[None] + p.sum(0)[None] - p)
        new[np.arange(n), np.arange(n)] = p.sum(0)
        v = damping * v + (1 - damping) * new
    chosen = np.flatnonzero((r + v).diagonal() > 0)
    near = s[:, chosen]
    out = chosen[near.argmax(1)]
    out[chosen] = chosen
    return dict(enumerate(out.tolist()))


def test_affinity_as_dense(spark):
    x = np.array(points(40, 2, 4, 0.3)[:40])
    d = -(all_pairs(x) ** 2)
    preference = float(np.median(d[np.triu_indices(40, 1)]))
    links = [(i, j, float(d[i, j])) for i in range(40) for j in range(40) if i != j]
    df = spark.createDataFrame(links, "a long, b long, s double")
    got = {r.id: r.exemplar for r in metric.affinity_clusters(df, preference, 0.5, 9, every=3, settled=99).collect()}
    assert got == dense_affinity(x, preference, 0.5, 9)
    assert 1 < len(set(got.values())) < 30


def test_affinity_along_few_links(spark):
    """Two stars, one row that is linked to nothing but through others' lists, and messages that settle."""
    links = [(0, k, -1.0) for k in (1, 2, 3)] + [(k, 0, -1.0) for k in (1, 2, 3)] + [(10, k, -1.0) for k in (11, 12)] + [(k, 10, -1.0) for k in (11, 12)]
    df = spark.createDataFrame([*links, (12, 99, -500.0)], "a long, b long, s double")
    got = {r.id: r.exemplar for r in metric.affinity_clusters(df, -2.5, 0.5, 14, every=3, settled=2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10, 12: 10, 99: 99}


def test_blocks_meet_without_copies(spark):
    """What is shuffled for the pairs of a table does not hold its vectors; ids need not be longs."""
    x = np.random.default_rng(3).normal(size=(300, 4))
    filed = spark.createDataFrame([(i, x[i].tolist(), 1, i % 2, [1 - i % 2] if i % 3 else []) for i in range(300)], "id int, v array<double>, n long, cell int, cells array<int>")

    def run(pairs):
        met = [(len(a.id), len(b.id), same) for a, b, same in pairs]
        yield metric.pd.DataFrame({"id": [0], "n": [sum(p * q if not same else p * (p + 1) // 2 for p, q, same in met)]})

    blocks = metric.pack(filed, 20)
    out = metric.meet_blocks(blocks, run, "id int, n long")
    assert sum(blocks.select(metric.F.size("id")).toPandas().iloc[:, 0]) == 300 and blocks.count() >= 16
    inside, border = (sum((i % 3 > 0) == near and i % 2 == 0 for i in range(300)) for near in (False, True))
    of_cell = (inside + border) * (inside + border + 1) // 2
    assert sum(r.n for r in out.collect()) == 2 * of_cell + border * border
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
