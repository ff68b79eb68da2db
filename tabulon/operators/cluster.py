"""Clusters: fitting by pyspark.ml, evaluation from contingency tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.similarity import affinity, cosine
from .metric import meet


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1, bisecting: bool = False) -> DataFrame:
    """Adds cluster."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector)))
    kind = BisectingKMeans if bisecting else KMeans
    return kind(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def silhouette_by_k(df: DataFrame, vector: str, ks: list[int], seed: int = 1) -> list[tuple[int, float]]:
    rows = df.withColumn("_v", array_to_vector(F.col(vector)))
    score = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
    return [(k, score.evaluate(KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows))) for k in ks]


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, majority, n, purity)."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("_n"))
    best = counts.groupBy(cluster).agg(F.max(F.struct("_n", (-F.col(label)).alias("l"))).alias("b"), F.sum("_n").alias("n"))
    return best.select(cluster, (-F.col("b.l")).alias("majority"), "n", (F.col("b._n") / F.col("n")).alias("purity"))


def external_scores(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: homogeneity, completeness, v_measure, adjusted_rand; from counts of (cluster, label)."""
    cell = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))  # cells of the table, not rows
    cell = cell.withColumns({"a": F.sum("n").over(W.partitionBy(cluster)), "b": F.sum("n").over(W.partitionBy(label)), "t": F.sum("n").over(every)})
    n, a, b, t = (F.col(c) for c in "nabt")
    two = lambda x: x * (x - 1) / 2
    # sums over clusters (labels) taken cell by cell, each cell with its share
    s = cell.agg(
        F.sum(-n / t * F.log(n / a)).alias("lc"), F.sum(-n / t * F.log(b / t)).alias("hl"), F.sum(-n / t * F.log(n / b)).alias("cl"), F.sum(-n / t * F.log(a / t)).alias("hc"),
        F.sum(two(n)).alias("i"), F.sum(n * (a - 1) / 2).alias("pa"), F.sum(n * (b - 1) / 2).alias("pb"), F.max(two(t)).alias("pt"),
    )
    h = F.when(F.col("hl") == 0, F.lit(1.0)).otherwise(1 - F.col("lc") / F.col("hl"))
    c = F.when(F.col("hc") == 0, F.lit(1.0)).otherwise(1 - F.col("cl") / F.col("hc"))
    expect = F.col("pa") * F.col("pb") / F.col("pt")
    return s.select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c == 0, F.lit(0.0)).otherwise(2 * h * c / (h + c)).alias("v_measure"), ((F.col("i") - expect) / ((F.col("pa") + F.col("pb")) / 2 - expect)).alias("adjusted_rand"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    long = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def around_centroid(df: DataFrame, group: str, key: str, vector: str, k: int, nearest: bool = True) -> DataFrame:
    """(group, key, distance, rank): the k members nearest to (or farthest from) their centroid, by cosine distance."""
    rows = df.join(centroids(df, group, vector), group).withColumn("distance", F.round(1 - cosine(F.col(vector), F.col("centroid")), 6))
    order = F.col("distance").asc() if nearest else F.col("distance").desc()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(order, key))).where(F.col("rank") <= k).select(group, key, "distance", "rank")


def dispersions(df: DataFrame, vector: str, ks: list[int], seed: int = 1) -> list[float]:
    """Sum of squared distances to the nearest of k centers, for every k."""
    rows = df.select(array_to_vector(F.col(vector)).alias("_v"))
    spread = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((F.var_pop("x") * F.count("x")).alias("s"))
    return [spread.agg(F.sum("s")).first()[0] if k == 1 else KMeans(k=k, seed=seed, featuresCol="_v").fit(rows).summary.trainingCost for k in ks]


def gap_statistic(df: DataFrame, key: str, vector: str, ks: list[int], refs: int = 2, seed: int = 1) -> list[tuple[int, float]]:
    """(k, gap): log of the mean dispersion of uniform rows in the data's box less the log of the data's own."""
    n = F.posexplode(vector).alias("i", "x")
    box = df.select(n).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    edges = box.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a", "b"))), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias("box"))  # one row, a cell per dimension
    own, other = dispersions(df, vector, ks, seed), [0.0] * len(ks)
    for r in range(refs):
        u = lambda i, r=r: F.pmod(F.xxhash64(F.lit(r), F.lit(seed), F.col(key), i), F.lit(1 << 30)) / float(1 << 30)
        rows = df.select(key).crossJoin(F.broadcast(edges)).select(F.transform("box", lambda s, i: s["a"] + (s["b"] - s["a"]) * u(i)).alias("v"))  # noqa: B023
        other = [x + y / refs for x, y in zip(other, dispersions(rows, "v", ks, seed), strict=True)]
    return [(k, math.log(x) - math.log(y)) for k, x, y in zip(ks, other, own, strict=True)]


def principal(df: DataFrame, columns: list[str], k: int = 2, out: str = "pc") -> DataFrame:
    """Adds out, the first k principal components of the z-scores of columns, as an array."""
    from pyspark.ml.feature import PCA, VectorAssembler

    from .encode import scale

    scaled = scale(df.withColumns({f"_z_{c}": F.col(c).cast("double") for c in columns}), [f"_z_{c}" for c in columns], "zscore")
    rows = VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(scaled)
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn(out, vector_to_array("_p")).drop("_v", "_p", *[f"_z_{c}" for c in columns])


def pair_affinity(pairs: DataFrame, df: DataFrame, a: str, b: str, key: str, vector: str, sigma: float = 0.5) -> DataFrame:
    """(a, b, cosine, affinity) of given pairs of keys."""
    x, y = df.select(F.col(key).alias(a), F.col(vector).alias("_x")), df.select(F.col(key).alias(b), F.col(vector).alias("_y"))
    return pairs.join(x, a).join(y, b).withColumn("cosine", cosine(F.col("_x"), F.col("_y"))).withColumn("affinity", affinity(F.col("cosine"), sigma)).select(a, b, "cosine", "affinity")


def label_shares(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, n, of_cluster, of_label) of every cell."""
    cell = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return cell.withColumns({"of_cluster": F.col("n") / F.sum("n").over(W.partitionBy(cluster)), "of_label": F.col("n") / F.sum("n").over(W.partitionBy(label))})


def spectral(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(id, cluster) from weighted links (src, dst, weight) by power iteration on the normalised affinity.

    Links lie by the side that has more ids, so that a round sends the value of such an id to one partition instead of many."""
    ids = edges.agg(*[F.approx_count_distinct(c).alias(c) for c in ("src", "dst")]).first()
    edges = edges.repartition("src" if ids["src"] > ids["dst"] else "dst")
    return PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", weightCol="weight").assignClusters(edges)


def expected_share(x: int, y: int, n: int) -> float:
    """The mean, over all tables of n rows with margins x and y, of what their cell adds to the mutual information. Only counts within
    twelve deviations and sixty of the mean are summed up: what lies beyond has no weight in doubles."""
    mean = x * y / n
    spread = 12 * math.sqrt(mean * (n - x) / n * (n - y) / max(1, n - 1)) + 60
    low, high = max(0, x + y - n, math.floor(mean - spread)), min(x, y, math.ceil(mean + spread))
    k = np.arange(low, high + 1, dtype=float)
    ratio = np.log((x - k[:-1]) * (y - k[:-1])) - np.log((k[:-1] + 1) * (n - x - y + k[:-1] + 1))
    mass = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.exp(mass - mass.max())
    some = k > 0
    return float((k[some] / n * np.log(n * k[some] / (float(x) * y)) * mass[some]).sum() / mass.sum())


def adjusted_mutual_information(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: mutual information of clusters and labels above what chance gives, over the mean of both entropies above it.

    Chance: the mean over all tables with the same margins. It is a sum over cells of cluster x label, each worked out from its
    two margins alone, however many rows they count."""
    cell = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    a, b = cell.groupBy(cluster).agg(F.sum("n").alias("a")), cell.groupBy(label).agg(F.sum("n").alias("b"))
    total = cell.agg(F.sum("n").alias("t"))  # one row

    @F.pandas_udf("double")
    def chance(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([expected_share(x, y, n) for x, y, n in zip(a.tolist(), b.tolist(), t.tolist(), strict=True)])

    # sizes of clusters and labels, not rows: equal margins are worked out once
    sizes = a.groupBy("a").agg(F.count("*").alias("i")).crossJoin(b.groupBy("b").agg(F.count("*").alias("j"))).crossJoin(F.broadcast(total))
    expect = sizes.agg(F.sum(F.col("i") * F.col("j") * chance("a", "b", "t")).alias("e"))
    entropy = lambda rows, c, out: rows.crossJoin(F.broadcast(total)).agg(F.sum(-F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))).alias(out))
    mutual = cell.join(a, cluster).join(b, label).crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("m"))
    row = mutual.crossJoin(expect).crossJoin(entropy(a, "a", "ha")).crossJoin(entropy(b, "b", "hb"))  # one row each
    below = (F.col("ha") + F.col("hb")) / 2 - F.col("e")
    return row.select(F.when(F.abs(below) < 1e-12, F.lit(1.0)).otherwise((F.col("m") - F.col("e")) / below).alias("adjusted_mutual_information"))


def _nearest_by_cosine(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """(id, neighbour, d, same): for each row (id, v, label) of a its k nearest other rows of b by cosine distance to nine digits, then
    id. A matrix product leaves those that rounding could let in; their sums are then taken one dimension after the other, as SQL
    does. Rows without a vector come last."""
    b = b.sort_values("id")
    ids, others = a["id"].to_numpy(), b["id"].to_numpy()
    mine, theirs = a["label"].to_numpy(object), b["label"].to_numpy(object)
    has_x, has_y = a["v"].notna().to_numpy(), b["v"].notna().to_numpy()
    width = max([len(v) for v in (*a["v"][has_x][:1], *b["v"][has_y][:1])], default=0)
    x, y = np.zeros((len(a), width)), np.zeros((len(b), width))
    x[has_x], y[has_y] = np.reshape(a["v"][has_x].tolist(), (-1, width)), np.reshape(b["v"][has_y].tolist(), (-1, width))
    norms = lambda m: np.sqrt(sum((m[:, j] ** 2 for j in range(width)), np.zeros(len(m))))
    nx, ny = norms(x), norms(y)
    ux, uy = x / np.where(nx == 0, 1, nx)[:, None], (y / np.where(ny == 0, 1, ny)[:, None]).T
    most, out = min(k, len(b) - 1), {"id": [], "neighbour": [], "d": [], "same": []}
    for start in range(0, len(a), 128):
        own = slice(start, start + 128)
        d = 1 - ux[own] @ uy
        d[~(has_x[own][:, None] & has_y[None])] = 3.0
        d[ids[own][:, None] == others[None]] = np.inf
        limit = np.partition(d, most - 1, axis=1)[:, most - 1] if most else np.full(len(d), -1.0)
        q, c = np.nonzero((d <= limit[:, None] + 4e-9) & np.isfinite(d))
        dot, both = np.zeros(len(q)), nx[own][q] * ny[c]
        for j in range(width):
            dot += x[own][q, j] * y[c, j]
        exact = np.round(1 - np.where(both == 0, 0.0, dot / np.where(both == 0, 1, both)), 9)
        exact[d[q, c] == 3.0] = np.inf
        order = np.lexsort((c, exact, q))
        q, c, exact = q[order], c[order], exact[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < k
        q, c = q[kept] + start, c[kept]
        out["id"].append(ids[q])
        out["neighbour"].append(others[c])
        out["d"].append(exact[kept])
        out["same"].append(np.array([None if pd.isna(l) or pd.isna(m) else float(l == m) for l, m in zip(mine[q], theirs[c], strict=True)], object))
    return pd.DataFrame({name: np.concatenate(parts) if parts else [] for name, parts in out.items()})


def knn_agreement(df: DataFrame, key: str, vector: str, label: str, queries: DataFrame, k: int = 5, block: int = 8000) -> DataFrame:
    """(key, agree): for each of the given queries (key) the share of its k nearest other rows, by cosine, that have its label;
    neighbours whose label or the query's is null do not count. A stated set of queries against all rows, in blocks of both sides:
    k rows for each query and block are shuffled, not its pairs. Vectors have one length."""
    rows = df.where(F.col(key).isNotNull()).select(F.lit(0).alias("cell"), F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    own = rows.join(queries.select(F.col(key).alias("id")), "id", "left_semi").select("cell", "id", "v", "label")
    kind = df.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest_by_cosine(a, b, k) if len(a) and len(b) else pd.DataFrame({"id": a["id"][:0], "neighbour": a["id"][:0], "d": np.zeros(0), "same": np.zeros(0)})

    near = meet(own, rows, "cell", ("id", "id"), run, f"id {kind}, neighbour {kind}, d double, same double", block)
    best = near.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("d", "neighbour"))).where(F.col("r") <= k)
    return best.groupBy(F.col("id").alias(key)).agg(F.avg("same").alias("agree"))
