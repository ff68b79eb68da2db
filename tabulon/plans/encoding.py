"""Queries for encoding of whole tables, row sets and updates."""

from pyspark.sql import functions as F

from ..operators import canonical, encode, predicates, profile
from ..sources.files import table
from .registry import query


@query("categorify", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN -1 ELSE dense_rank() OVER (ORDER BY nullif(p_type, 'SMALL')) - 1 END AS code FROM part")
def categorify(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("t"))
    return encode.categorify(rows, "t", "code").select("p_partkey", F.col("code").cast("long").alias("code"))


@query("encoded_orders", "WITH r AS (SELECT *, dense_rank() OVER (ORDER BY CAST(o_custkey % 40 AS VARCHAR)) AS c FROM orders) SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\", (o_orderpriority = '1-URGENT')::INT AS \"o_orderpriority_1-URGENT\", (o_orderpriority = '2-HIGH')::INT AS \"o_orderpriority_2-HIGH\", (o_orderpriority = '3-MEDIUM')::INT AS \"o_orderpriority_3-MEDIUM\", (o_orderpriority = '4-NOT SPECIFIED')::INT AS \"o_orderpriority_4-NOT SPECIFIED\", (o_orderpriority = '5-LOW')::INT AS \"o_orderpriority_5-LOW\", CAST((c >> 5) & 1 AS INT) AS c_0, CAST((c >> 4) & 1 AS INT) AS c_1, CAST((c >> 3) & 1 AS INT) AS c_2, CAST((c >> 2) & 1 AS INT) AS c_3, CAST((c >> 1) & 1 AS INT) AS c_4, CAST((c >> 0) & 1 AS INT) AS c_5 FROM r")
def encoded_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 40).cast("string").alias("c"), F.lit(None).cast("string").alias("gone"))
    return encode.encode_columns(rows, ["o_orderstatus", "o_orderpriority", "c", "gone"])


@query("imputed_prices", "WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS v FROM part) SELECT p_partkey, round(coalesce(v, avg(v) OVER ()), 4) AS v FROM r")
def imputed_prices(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("v"))
    return encode.impute_mean(rows, ["v"]).withColumn("v", F.round("v", 4))


@query("unit_rows", "SELECT l_orderkey, l_linenumber, coalesce(round(l_tax / nullif(sqrt(l_tax * l_tax + l_discount * l_discount), 0), 6), 0.0) AS a FROM lineitem")
def unit_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return encode.unit_rows(rows, ["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("l_tax", 6).alias("a"))


@query("complete_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'")
def complete_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("b"))
    return encode.complete_rows(rows, ["a", "b"]).select("o_orderkey")


@query("label_means", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_tax = 0 AND l_discount = 0) AS n_zero, round(avg(l_tax), 6) AS mean_l_tax, round(avg(l_discount), 6) AS mean_l_discount FROM lineitem GROUP BY ALL")
def label_means(spark, d):
    out = profile.label_means(table(spark, d, "lineitem"), "l_returnflag", ["l_tax", "l_discount"])
    return out.withColumns({"mean_l_tax": F.round("mean_l_tax", 6), "mean_l_discount": F.round("mean_l_discount", 6)})


@query("distinct_with_count", "WITH r AS (SELECT DISTINCT p_brand, nullif(p_type, 'SMALL') AS t, p_name FROM part) SELECT *, count(*) OVER (PARTITION BY p_brand, t) AS n_group FROM r")
def distinct_with_count(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.nullif("p_type", F.lit("SMALL")).alias("t"), "p_name")
    return profile.distinct_with_count(rows, ["p_brand", "t"])


@query("first_names", "WITH f AS (SELECT p_size, p_name, min(p_partkey) AS o FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY o, p_name) AS r FROM f) SELECT p_size, coalesce(max(p_name) FILTER (r = 1), 'NONE') AS p_name_1, coalesce(max(p_name) FILTER (r = 2), 'NONE') AS p_name_2, coalesce(max(p_name) FILTER (r = 3), 'NONE') AS p_name_3 FROM r GROUP BY ALL")
def first_names(spark, d):
    return profile.spread(table(spark, d, "part"), "p_size", "p_name", "p_partkey", 3)


@query("standard_scores", "WITH s AS (SELECT *, avg(value) OVER () AS m, stddev_pop(value) OVER () AS d FROM events) SELECT 'value' AS \"column\", count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, count(*) FILTER ((value - m) / d < -3) AS n_low, count(*) FILTER ((value - m) / d > 3) AS n_high FROM s")
def standard_scores(spark, d):
    return profile.standard_scores(table(spark, d, "events"), ["value"]).withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("merged_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1 - s_suppkey, 'ADDED' FROM supplier")
def merged_rows(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW"))
    added = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment"))
    return profile.merge_rows(old, new.unionByName(added), ["c_custkey"])


@query("bag_means", "SELECT l_orderkey, l_linenumber, round((l_tax + l_discount) / 2, 6) AS m FROM lineitem")
def bag_means(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("m.0"), F.col("l_discount").alias("m.1"))
    return profile.bags(rows, ["m"]).withColumn("m", F.round("m", 6))


@query("code_check", "WITH c AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'Request' ELSE p_brand || '-' || p_size END AS c FROM part) SELECT count(*) AS n, count(*) - count(c) AS nulls, count(*) FILTER (contains(c, '-')) AS hyphens, count(*) FILTER (lower(c) = 'request') AS noisy FROM c")
def code_check(spark, d):
    k = F.col("p_partkey")
    return canonical.check_canonical(table(spark, d, "part").select(F.when(k % 7 == 0, None).when(k % 11 == 0, "Request").otherwise(F.concat("p_brand", F.lit("-"), "p_size")).alias("c")), "c")


@query("valid_codes", r"SELECT c_custkey, regexp_matches(c_name || '', '^\d+') OR c_name = 'unknown' AS named, regexp_matches(CAST(c_custkey AS VARCHAR) || '-7', '^\d+') AS numbered FROM customer")
def valid_codes(spark, d):
    return table(spark, d, "customer").select("c_custkey", canonical.valid_code(F.col("c_name")).alias("named"), canonical.valid_code(F.concat(F.col("c_custkey"), F.lit("-7"))).alias("numbered"))


@query("without_codes", "SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(p_brand || '^' || p_type, '^'), ['Brand#11', 'SMALL'])")
def without_codes(spark, d):
    rows = table(spark, d, "part").withColumn("l", F.concat("p_brand", F.lit("^"), "p_type"))
    return predicates.without_codes(rows, ["Brand#11", "SMALL"], ["l"]).select("p_partkey")


@query("null_or_zero_rows", "SELECT count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AS some_null, count(*) FILTER (o_custkey % 2 = 0 AND o_orderkey % 3 = 0) AS all_zero FROM orders")
def null_or_zero_rows(spark, d):
    rows = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("b"), (F.col("o_custkey") % 2).alias("x"), (F.col("o_orderkey") % 3).alias("y"))
    return rows.agg(F.count_if(canonical.any_null("a", "b")).alias("some_null"), F.count_if(canonical.all_zero("x", "y")).alias("all_zero"))
