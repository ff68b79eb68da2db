"""Queries that draw rows: caps, quotas, bootstrap, weighted and interval draws."""

from pyspark.sql import functions as F

from ..operators import sampling
from ..sources.files import table
from .registry import query

_U = "CAST('0x' || left(md5('{seed}|' || {key}), 13) AS BIGINT) / 4503599627370496.0"


def _ranked(label: str, key: str, of: str) -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('0|' || {key}), {key}) AS i, count(*) OVER (PARTITION BY {label}) AS n FROM {of})"


@query("cap_majority", f"WITH {_ranked('o_orderstatus', 'o_orderkey', 'orders')} SELECT o_orderkey, o_orderstatus FROM r WHERE i <= 2 * (SELECT min(n) FROM r)")
def cap_majority(spark, d):
    return sampling.cap_majority(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 2)


@query("even_classes", f"WITH {_ranked('o_orderstatus', 'o_orderkey', 'orders')} SELECT o_orderkey, o_orderstatus FROM r WHERE i <= (SELECT min(n) FROM r)")
def even_classes(spark, d):
    return sampling.two_classes_even(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("top_up", "WITH o AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0), c AS (SELECT o_orderpriority, count(*) AS n FROM o GROUP BY ALL), l AS (SELECT o_orderpriority, (SELECT max(n) FROM c) - n AS lack FROM c WHERE n < (SELECT max(n) FROM c)), r AS (SELECT p.o_orderkey, p.o_orderpriority, lack, row_number() OVER (PARTITION BY p.o_orderpriority ORDER BY md5('0|' || p.o_orderkey), p.o_orderkey) AS i FROM orders p JOIN l USING (o_orderpriority) WHERE p.o_orderkey % 5 <> 0) SELECT o_orderkey, o_orderpriority FROM r WHERE i <= lack")
def top_up(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.top_up(rows.where("o_orderkey % 5 = 0"), rows, "o_orderpriority", "o_orderkey")


@query("class_quota", f"WITH {_ranked('o_orderpriority', 'o_orderkey', 'orders')}, q AS (SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) AS c, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS k FROM r) SELECT o_orderkey, o_orderpriority FROM q WHERE i <= 103 // k + CASE WHEN c <= 103 % k THEN 1 ELSE 0 END")
def class_quota(spark, d):
    return sampling.class_quota(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 103)


@query("bootstrap", f"WITH {_ranked('o_orderstatus', 'o_orderkey', 'orders')}, p AS (SELECT o_orderstatus, CAST(floor({_U.format(seed=1, key='o_orderkey')} * n) + 1 AS BIGINT) AS i FROM r) SELECT r.o_orderkey, r.o_orderstatus FROM p JOIN r USING (o_orderstatus, i)")
def bootstrap(spark, d):
    return sampling.bootstrap(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("weighted_choice", f"WITH w AS (SELECT p_type, count(*) AS w FROM part GROUP BY ALL), m AS (SELECT p_type, sum(w) OVER (ORDER BY p_type) / sum(w) OVER () AS high, (sum(w) OVER (ORDER BY p_type) - w) / sum(w) OVER () AS low FROM w), k AS (SELECT c_custkey, {_U.format(seed=0, key='c_custkey')} AS u FROM customer) SELECT c_custkey, p_type FROM k JOIN m ON u >= low AND u < high")
def weighted_choice(spark, d):
    weights = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("w"))
    return sampling.weighted_choice(weights, "p_type", "w", table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("round_robin", f"WITH {_ranked('c_mktsegment', 'c_custkey', 'customer')} SELECT c_custkey, c_mktsegment FROM r ORDER BY i, c_mktsegment LIMIT 52")
def round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 52)


@query("interval_sample", "WITH t AS (SELECT event_id, event_type, ntile(10) OVER (PARTITION BY event_type ORDER BY value, event_id) AS tile FROM events) SELECT event_id, event_type, CAST(tile AS INT) AS tile FROM t QUALIFY row_number() OVER (PARTITION BY event_type, tile ORDER BY md5('0|' || event_id), event_id) = 1")
def interval_sample(spark, d):
    return sampling.interval_sample(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "event_id", 10, "event_type").select("event_id", "event_type", "tile")


@query("sample_rows", "SELECT c_custkey FROM customer ORDER BY md5('0|' || c_custkey), c_custkey LIMIT 40")
def sample_rows(spark, d):
    return sampling.sample_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", 40)


@query("class_folds", f"WITH {_ranked('o_orderstatus', 'o_orderkey', 'orders')} SELECT o_orderkey, i % 5 AS fold FROM r")
def class_folds(spark, d):
    return sampling.folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5).select("o_orderkey", "fold")


@query("top_up_report", "WITH o AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL), f AS (SELECT o_orderpriority, count(*) AS found FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderpriority <> '2-HIGH' GROUP BY ALL) SELECT o_orderpriority, n, coalesce(found, 0) AS found, least(coalesce(found, 0), (SELECT max(n) FROM o) - n) AS added, coalesce(found, 0) > 0 AS hit FROM o LEFT JOIN f USING (o_orderpriority)")
def top_up_report(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.top_up_report(rows.where("o_orderkey % 5 = 0"), rows.where("o_orderkey % 5 = 0 or o_orderpriority <> '2-HIGH'"), "o_orderpriority", "o_orderkey")


@query("distinct_samples", "WITH u AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey DESC) = 1) SELECT o_orderkey, o_orderpriority, o_custkey FROM u QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0|' || o_orderkey), o_orderkey) <= 3")
def distinct_samples(spark, d):
    return sampling.distinct_samples(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderpriority", "o_orderkey", ["o_custkey"], 3)
