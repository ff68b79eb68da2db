"""Queries for thresholds, votes, comparisons of methods, clusters and trees."""

from pyspark.sql import functions as F

from ..operators import cluster, metrics, models
from ..sources.files import table
from .learning import _P, _scored
from .registry import query

_M = "WITH m AS (SELECT event_type AS metric, CAST(user_id % 6 AS INT) AS method, value FROM events), a AS (SELECT metric, method, avg(value) AS mean FROM m GROUP BY ALL)"


def _methods(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("metric"), (F.col("user_id") % 6).cast("int").alias("method"), "value")


@query("ratio_threshold", _P + " SELECT max(s) AS threshold FROM c WHERE m >= ceil(0.25 * total)")
def ratio_threshold(spark, d):
    return metrics.ratio_threshold(_scored(spark, d), [], "y", "s", 0.25)


@query("threshold_at_fpr", _P + " SELECT max(s) AS threshold FROM c WHERE m - tp >= 0.2 * (total - pos)")
def threshold_at_fpr(spark, d):
    return metrics.threshold_at_fpr(_scored(spark, d), [], "y", "s", 0.2)


@query("youden", _P + " SELECT round(tp / pos - (m - tp) / (total - pos), 9) AS j, s AS threshold FROM c ORDER BY j DESC, s DESC LIMIT 1")
def youden(spark, d):
    return metrics.youden(_scored(spark, d), [], "y", "s")


@query("auc_by_source", "WITH p AS (" + _P.split("), k AS")[0].removeprefix("WITH p AS (") + "), k AS (SELECT source, s, sum(y) AS p, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT source, p, n, sum(n) OVER (PARTITION BY source ORDER BY s) - (n - 1) / 2.0 AS r FROM k) SELECT source, round((sum(r * p) - sum(p) * (sum(p) + 1) / 2.0) / nullif(sum(p) * (sum(n) - sum(p)), 0), 6) AS auc FROM r GROUP BY ALL")
def auc_by_source(spark, d):
    return metrics.roc_auc(_scored(spark, d), ["source"], "y", "s").withColumn("auc", F.round("auc", 6))


_V = "WITH v AS (SELECT event_id, unnest(['a', 'b', 'c']) AS method, unnest([value, value / 2, value * 2]) AS s FROM events), t(method, threshold) AS (VALUES ('a', 40.0), ('b', 30.0), ('c', 150.0))"


@query("label_matrix", _V + " SELECT event_id, method, CASE WHEN s >= threshold THEN 1 ELSE 0 END AS vote FROM v JOIN t USING (method)")
def label_matrix(spark, d):
    long = table(spark, d, "events").select("event_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), s.alias("s")) for m, s in (("a", F.col("value")), ("b", F.col("value") / 2), ("c", F.col("value") * 2))])).alias("r")).select("event_id", "r.*")
    cuts = spark.createDataFrame([("a", 40.0), ("b", 30.0), ("c", 150.0)], "method string, threshold double")
    return metrics.votes(long, "event_id", "method", "s", cuts)


@query("combined_scores", "SELECT user_id, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY ALL")
def combined_scores(spark, d):
    rows = table(spark, d, "events")
    mean = metrics.combine(rows, "user_id", "value").select("user_id", F.round("score", 6).alias("mean"))
    return mean.join(metrics.combine(rows, "user_id", "value", "median").select("user_id", F.round("score", 6).alias("median")), "user_id")


@query("multiclass_auc", "WITH r AS (SELECT unnest(['F', 'O', 'P']) AS c, o_orderstatus AS y, unnest([(o_orderkey * 7 % 53) / 53.0, (o_orderkey * 5 % 47) / 47.0, (o_orderkey * 3 % 41) / 41.0]) AS s FROM orders), k AS (SELECT c, s, count(*) FILTER (y = c) AS p, count(*) AS n FROM r GROUP BY ALL), q AS (SELECT c, p, n, sum(n) OVER (PARTITION BY c ORDER BY s) - (n - 1) / 2.0 AS r FROM k), a AS (SELECT c, (sum(r * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))) AS auc FROM q GROUP BY ALL) SELECT round(avg(auc), 6) AS auc FROM a")
def multiclass_auc(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderstatus", ((k * 7 % 53) / 53.0).alias("F"), ((k * 5 % 47) / 47.0).alias("O"), ((k * 3 % 41) / 41.0).alias("P"))
    return metrics.multiclass_auc(rows, ["F", "O", "P"], "o_orderstatus").select(F.round("auc", 6).alias("auc"))


@query("methods_ranked", _M + ", r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, method) AS rank FROM a) SELECT metric, method, round(mean, 6) AS mean, rank FROM r WHERE rank <= 3")
def methods_ranked(spark, d):
    return metrics.rank_methods(_methods(spark, d), "metric", "method", "value", 3).withColumn("mean", F.round("mean", 6))


@query("methods_against_best", _M + " SELECT metric, method, round(mean, 6) AS mean, first_value(method) OVER (PARTITION BY metric ORDER BY mean DESC, method DESC) AS best, round(mean - max(mean) OVER (PARTITION BY metric), 6) AS delta FROM a")
def methods_against_best(spark, d):
    return metrics.against_best(_methods(spark, d), "metric", "method", "value").withColumns({"mean": F.round("mean", 6), "delta": F.round("delta", 6)})


@query("method_summary", _M + " SELECT metric, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM m GROUP BY ALL")
def method_summary(spark, d):
    return metrics.method_summary(_methods(spark, d), "metric", "value").withColumn("mean", F.round("mean", 6))


@query("best_within_error", "WITH s AS (SELECT user_id, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY ALL HAVING count(*) > 1), b AS (SELECT mean AS m, sd AS d FROM s ORDER BY mean DESC, sd DESC LIMIT 1) SELECT user_id FROM s, b WHERE mean >= m - d / 2 ORDER BY user_id LIMIT 1")
def best_within_error(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where("sd is not null")
    return metrics.best_within_error(rows, "user_id", "mean", "sd", 5).select("user_id")


@query("rmse", "SELECT l_returnflag, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 6) AS rmse FROM lineitem GROUP BY ALL")
def rmse(spark, d):
    return metrics.rmse(table(spark, d, "lineitem"), ["l_returnflag"], "l_tax", "l_discount").withColumn("rmse", F.round("rmse", 6))


@query("cluster_label_shares", "WITH c AS (SELECT vec_id % 7 AS g, label, count(*) AS n FROM embeddings GROUP BY ALL) SELECT g, label, n, round(n / sum(n) OVER (PARTITION BY g), 6) AS of_cluster, round(n / sum(n) OVER (PARTITION BY label), 6) AS of_label FROM c")
def cluster_label_shares(spark, d):
    out = cluster.label_shares(table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 7), "g", "label")
    return out.withColumns({"of_cluster": F.round("of_cluster", 6), "of_label": F.round("of_label", 6)})


@query("vector_affinity", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, b, round(c, 6) AS cosine, round(exp(-(1 - c) * (1 - c) / 0.5), 6) AS affinity FROM p")
def vector_affinity(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = rows.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    out = cluster.pair_affinity(pairs, rows, "a", "b", "vec_id", "embedding")
    return out.withColumns({"cosine": F.round("cosine", 6), "affinity": F.round("affinity", 6)})


@query("principal_components")
def principal_components(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return cluster.principal(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *names), names).select("l_orderkey", "l_linenumber", "pc")


@query("gap_statistic")
def gap_statistic(spark, d):
    return spark.createDataFrame(cluster.gap_statistic(table(spark, d, "embeddings"), "vec_id", "embedding", [2, 5, 10]), "k int, gap double")


@query("silhouettes")
def silhouettes(spark, d):
    return spark.createDataFrame(cluster.silhouette_by_k(table(spark, d, "embeddings"), "embedding", [2, 5, 10]), "k int, silhouette double")


def _flags(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return names, table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *names, (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("tree_trials")
def tree_trials(spark, d):
    names, rows = _flags(spark, d)
    return models.tree_trials(rows, "id", names, "y", trials=2)


@query("tree_thresholds")
def tree_thresholds(spark, d):
    names, rows = _flags(spark, d)
    return models.split_thresholds(models.tree(rows, names, "y")[0], spark, names)


@query("nested_search")
def nested_search(spark, d):
    names, rows = _flags(spark, d)
    return models.nested_search(rows, "id", names, "y", [0.01, 0.1], k=2)


@query("all_scores", _P + ", r AS (SELECT p, n, sum(n) OVER (ORDER BY s) - (n - 1) / 2.0 AS r FROM k), f AS (SELECT tp / m AS p, tp / pos AS r, (m - tp) / m AS p0, (m - tp) / (total - pos) AS r0 FROM c) SELECT (SELECT round((sum(r * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 6) FROM r) AS auc, (SELECT round(max(2 * p * r / nullif(p + r, 0)), 6) FROM f) AS fmax, (SELECT round(max(2 * p0 * r0 / nullif(p0 + r0, 0)), 6) FROM f) AS fmax_negative, (SELECT round(1 - avg((s - y) * (s - y)), 6) FROM p) AS brier")
def all_scores(spark, d):
    out = metrics.all_scores(_scored(spark, d), [], "y", "s")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("spectral_clusters")
def spectral_clusters(spark, d):
    links = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return cluster.spectral(links, 3)
