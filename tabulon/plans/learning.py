"""Queries for encoding, evaluation, clusters and models."""

from pyspark.sql import functions as F

from ..functions.text import age
from ..operators import cluster, encode, metrics, models
from ..sources.files import table
from .registry import query

_P = "WITH p AS (SELECT d.source, l.doc_id, l.quality AS y, round(((l.doc_id * 37) % 101) / 200.0 + l.quality * 0.3, 4) AS s FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT s, sum(y) AS p, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS m, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM k)"


def _scored(spark, d):
    score = F.round(((F.col("doc_id") * 37) % 101) / 200.0 + F.col("quality") * 0.3, 4)
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", F.col("quality").alias("y"), score.alias("s"))


@query("one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O FROM orders")
def one_hot(spark, d):
    return encode.one_hot(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O")


@query("binary_encode", "WITH c AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS c FROM part) SELECT p_partkey, CAST((c >> 4) & 1 AS INT) AS p_brand_0, CAST((c >> 3) & 1 AS INT) AS p_brand_1, CAST((c >> 2) & 1 AS INT) AS p_brand_2, CAST((c >> 1) & 1 AS INT) AS p_brand_3, CAST(c & 1 AS INT) AS p_brand_4 FROM c")
def binary_encode(spark, d):
    return encode.binary_encode(table(spark, d, "part"), "p_brand", 5).select("p_partkey", *[f"p_brand_{k}" for k in range(5)])


@query("one_vs_all", "SELECT p_partkey, (p_type = 'SMALL')::INT AS label FROM part")
def one_vs_all(spark, d):
    return table(spark, d, "part").select("p_partkey", encode.one_vs_all(F.col("p_type"), "SMALL").alias("label"))


@query("order_age", "SELECT o_orderkey, 2020 - year(o_orderdate) AS age FROM orders")
def order_age(spark, d):
    return table(spark, d, "orders").select("o_orderkey", age(F.year("o_orderdate"), 2020, F.lit(0)).cast("long").alias("age"))


@query("minmax_scale", "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity FROM lineitem")
def minmax_scale(spark, d):
    out = encode.scale(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


@query("zscore_scale", "SELECT l_orderkey, l_linenumber, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 5) AS l_tax FROM lineitem")
def zscore_scale(spark, d):
    out = encode.scale(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), ["l_tax"], "zscore")
    return out.withColumn("l_tax", F.round("l_tax", 5))


@query("fmax", _P + ", f AS (SELECT s, tp / m AS p, tp / pos AS r FROM c), g AS (SELECT s, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f FROM f) SELECT round(f, 6) AS fmax, s AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM g ORDER BY f DESC NULLS LAST, s DESC LIMIT 1")
def fmax(spark, d):
    out = metrics.fmax(_scored(spark, d), [], "y", "s")
    return out.select(F.round("fmax", 6).alias("fmax"), "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("roc_auc", _P + ", r AS (SELECT p, n, sum(n) OVER (ORDER BY s) - (n - 1) / 2.0 AS r FROM k) SELECT round((sum(r * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 6) AS auc FROM r")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), [], "y", "s").select(F.round("auc", 6).alias("auc"))


@query("confusion", _P + ", q AS (SELECT source, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 0 AND s < 0.5) AS tn FROM p GROUP BY ALL) SELECT source, tp, fp, fn, tn, round(tp / (tp + fn + 1e-9), 6) AS tpr, round((tp + tn) / (tp + fp + fn + tn), 6) AS acc FROM q")
def confusion(spark, d):
    out = metrics.confusion(_scored(spark, d), ["source"], "y", "s", 0.5)
    return out.select("source", "tp", "fp", "fn", "tn", F.round("tpr", 6).alias("tpr"), F.round("acc", 6).alias("acc"))


@query("brier", _P + " SELECT source, round(1 - avg((s - y) * (s - y)), 6) AS brier FROM p GROUP BY ALL")
def brier(spark, d):
    return metrics.brier(_scored(spark, d), ["source"], "y", "s").withColumn("brier", F.round("brier", 6))


@query("prior_threshold", _P + " SELECT max(s) AS threshold FROM c WHERE m >= pos")
def prior_threshold(spark, d):
    return metrics.prior_threshold(_scored(spark, d), [], "y", "s")


@query("majority_vote", "WITH v AS (SELECT doc_id, unnest([quality, toxic, CAST(doc_id % 2 AS INT)]) AS v FROM labels) SELECT doc_id, CASE WHEN avg(v) > 0.5 THEN 1 ELSE 0 END AS label FROM v GROUP BY ALL")
def majority_vote(spark, d):
    votes = table(spark, d, "labels").select("doc_id", F.explode(F.array("quality", "toxic", (F.col("doc_id") % 2).cast("int"))).alias("v"))
    return metrics.majority(votes, "doc_id", "v")


@query("cluster_purity", "WITH c AS (SELECT vec_id % 7 AS g, label, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY g) AS t, row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS r FROM c) SELECT g, label AS majority, CAST(t AS BIGINT) AS n, round(n / t, 6) AS purity FROM r WHERE r = 1")
def cluster_purity(spark, d):
    return cluster.purity(table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 7), "g", "label").withColumn("purity", F.round("purity", 6))


@query("cluster_scores", "WITH c AS (SELECT label // 2 AS g, label AS l, count(*) AS n FROM embeddings GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY g) AS a, sum(n) OVER (PARTITION BY l) AS b, sum(n) OVER () AS t FROM c), s AS (SELECT sum(-n / t * ln(n / a)) AS lc, sum(-n / t * ln(b / t)) AS hl, sum(-n / t * ln(n / b)) AS cl, sum(-n / t * ln(a / t)) AS hc, sum(n * (n - 1) / 2) AS i, sum(n * (a - 1) / 2) AS pa, sum(n * (b - 1) / 2) AS pb, max(t * (t - 1) / 2) AS pt FROM m) SELECT round(1 - lc / hl, 6) AS homogeneity, round(1 - cl / hc, 6) AS completeness, round(2 * (1 - lc / hl) * (1 - cl / hc) / ((1 - lc / hl) + (1 - cl / hc)), 6) AS v_measure, round((i - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 6) AS adjusted_rand FROM s")
def cluster_scores(spark, d):
    out = cluster.external_scores(table(spark, d, "embeddings").withColumn("g", F.floor(F.col("label") / 2)), "g", "label")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("centroid_members", "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), d AS (SELECT e.label, e.vec_id, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS distance FROM e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d) SELECT label, vec_id, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def centroid_members(spark, d):
    return cluster.around_centroid(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 5)


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return cluster.kmeans(table(spark, d, "embeddings"), "embedding", 10).select("vec_id", "label", "cluster")


@query("tree_paths")
def tree_paths(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select(*names, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    model, _ = models.tree(rows, names, "y")
    return models.path_counts(models.tree_paths(model, spark, names))


@query("class_scores")
def class_scores(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_custkey") % 97).cast("double").alias("c"))
    return models.class_scores(rows, "o_orderkey", "o_orderstatus", ["o_totalprice", "c"], ["F", "O", "P"])


@query("tree_row_paths")
def tree_row_paths(spark, d):
    """How many rows that the tree has not seen take each of its paths, by their own label."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *names, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    rows = rows.withColumn("seen", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(4)) > 0)
    model, _ = models.tree(rows.where("seen"), names, "y", 4)
    return models.path_counts(models.row_paths(model, rows.where("not seen"), names), by="y")


@query("imputed_chained")
def imputed_chained(spark, d):
    """Prices and quantities with a twentieth of the values missing, filled by regressions on each other."""
    gone = lambda c, k: F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(k)), F.lit(20)) > 0, F.col(c)).alias(c)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gone("l_quantity", 1), gone("l_extendedprice", 2), gone("l_discount", 3), gone("l_tax", 4))
    return encode.impute_chained(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 5)


@query("stacked_scores")
def stacked_scores(spark, d):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes

    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("month"), F.greatest("c_acctbal", F.lit(0)).alias("balance"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    learners = {"tree": DecisionTreeClassifier(maxDepth=4, seed=1), "linear": LogisticRegression(), "bayes": NaiveBayes(modelType="gaussian")}
    return models.stacked_scores(rows, "o_orderkey", ["o_totalprice", "month", "balance"], "y", learners, 3)
