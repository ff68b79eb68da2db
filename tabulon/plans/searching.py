"""Queries that find codes and neighbours: searches over an index, nearest strings, density and linkage clusters."""

from pyspark.sql import functions as F

from ..operators import metric, nearest, search, tfidf
from ..sources.files import scratch, table
from .registry import query

_NAMES = "string_split(p_name, ' ') || [p_type, 'SIZE' || p_size]"
_FIT = f"""WITH w AS (SELECT p_partkey, p_brand, unnest({_NAMES}) AS term FROM part), c AS (SELECT p_brand, term, count(*) AS tf FROM w GROUP BY ALL),
 m AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT p_brand) FROM part)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY ALL),
 x AS (SELECT p_brand, term, tf * idf AS v FROM c JOIN m USING (term)), b AS (SELECT p_brand, term, v / sqrt(sum(v * v) OVER (PARTITION BY p_brand)) AS v FROM x),
 q AS (SELECT p_partkey, term, count(*) * any_value(idf) AS v FROM w JOIN m USING (term) GROUP BY ALL), r AS (SELECT p_partkey, term, v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)) AS v FROM q),
 s AS (SELECT p_partkey, p_brand AS code, round(sum(r.v * b.v), 9) AS score FROM r JOIN b USING (term) GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, code) AS rank FROM s)"""


def _parts(spark, d):
    size = F.concat(F.lit("SIZE"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type", size).alias("text"))


def _brand_search(spark, d):
    """The model and the index go through files, as a service that searches later would read them."""
    tokens, at = lambda c: F.split(c, " "), scratch(spark, "model")
    counts = tfidf.term_counts(_parts(spark, d).select("p_brand", tokens(F.col("text")).alias("t")), "p_brand", "t")
    search.save_model(search.fit_terms(counts, "p_brand"), f"{at}/terms")
    model = search.load_model(spark, f"{at}/terms")
    index = search.build_index(search.weigh(counts, model, "p_brand"), "p_brand", f"{at}/index")
    return search.find_codes(_parts(spark, d), "p_partkey", "text", tokens, model, index, 3)


@query("code_search", _FIT + " SELECT p_partkey, code, round(score, 6) AS score, rank FROM f WHERE rank <= 3")
def code_search(spark, d):
    return _brand_search(spark, d).withColumn("score", F.round("score", 6))


@query("code_search_hits", _FIT + ", h AS (SELECT p_partkey, min(rank) AS rank FROM f JOIN part USING (p_partkey) WHERE code = p_brand AND rank <= 3 GROUP BY ALL), o AS (SELECT k, (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM h WHERE rank <= k) AS hits FROM (VALUES (1), (2), (3)) t(k)) SELECT k, n, hits, round(hits / n, 9) AS share FROM o")
def code_search_hits(spark, d):
    out = search.hit_rates(_brand_search(spark, d), _parts(spark, d), "p_partkey", "p_brand", 3)
    return out.withColumns({"k": F.col("k").cast("int"), "share": F.round("share", 9)})


_WORDS = "unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))"
_ITEMS = f"""WITH c AS (SELECT item_id, {_WORDS} AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM c GROUP BY ALL),
 m AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT item_id) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY ALL),
 x AS (SELECT item_id, term, tf * idf AS v FROM tf JOIN m USING (term)), b AS (SELECT item_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS v FROM x),
 d AS (SELECT doc_id, {_WORDS} AS term FROM documents), q AS (SELECT doc_id, term, count(*) * any_value(idf) AS v FROM d JOIN m USING (term) GROUP BY ALL),
 r AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM q), s AS (SELECT doc_id, item_id AS code, round(sum(r.v * b.v), 9) AS score FROM r JOIN b USING (term) GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rank FROM s)"""


@query("item_search", _ITEMS + " SELECT doc_id, code, round(score, 6) AS score, rank FROM f WHERE rank <= 3")
def item_search(spark, d):
    """Unseen texts: the model knows the terms of the benchmark alone, and every document searches it."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{2,})"), 1)
    counts = tfidf.term_counts(table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("t")), "item_id", "t")
    model = search.fit_terms(counts, "item_id")
    index = search.build_index(search.weigh(counts, model, "item_id"), "item_id", scratch(spark, "items"))
    found = search.find_codes(table(spark, d, "documents"), "doc_id", "text", tokens, model, index, 3)
    return found.withColumn("score", F.round("score", 6))


def _closest(part: str, of: str, name: str, key: str) -> str:
    """The engine's own Jaro-Winkler lifts scores over 0.7 only; ours lifts all, so it is put together from Jaro's."""
    same = " + ".join(f"(length(value) >= {n} AND length({name}) >= {n} AND left(value, {n}) = left(upper({name}), {n}))::INT" for n in range(1, 5))
    score = f"round(1 - (jaro_similarity(value, upper({name})) + 0.1 * ({same}) * (1 - jaro_similarity(value, upper({name})))), 9)"
    return f"""{part} AS (SELECT value, {part}_jw, {part}_jw_dist FROM (SELECT value, upper({name}) AS {part}_jw, {score} AS {part}_jw_dist, row_number() OVER (PARTITION BY value ORDER BY {score}, {key}, {name}) AS r FROM v CROSS JOIN {of}) WHERE r = 1)"""


@query("part_features_jaro_winkler", f"WITH v AS (SELECT DISTINCT upper(p_name) AS value FROM part), {_closest('land', 'nation', 'n_name', 'n_nationkey')}, {_closest('zone', 'region', 'r_name', 'r_regionkey')} SELECT * FROM land JOIN zone USING (value)")
def part_features_jaro_winkler(spark, d):
    land = table(spark, d, "nation").select(F.upper("n_name").alias("text"), F.col("n_nationkey").alias("ord"))
    zone = table(spark, d, "region").select(F.upper("r_name").alias("text"), F.col("r_regionkey").alias("ord"))
    names = table(spark, d, "part").select(F.upper("p_name").alias("name"))
    return nearest.part_features(names, "name", {"land": land, "zone": zone}, {"jw": nearest.nearest_jaro_winkler})


@query("nearest_supplier", "WITH v AS (SELECT DISTINCT c_name AS value FROM customer), p AS (SELECT value, s_name AS target, round(1 - jaro_winkler_similarity(value, s_name), 9) AS distance, row_number() OVER (PARTITION BY value ORDER BY round(1 - jaro_winkler_similarity(value, s_name), 9), s_suppkey, s_name) AS r FROM v CROSS JOIN supplier) SELECT value, target, distance FROM p WHERE r = 1")
def nearest_supplier(spark, d):
    """Every customer name against all names of suppliers: both tables grow, and no name has a partner that is alike but for case."""
    return nearest.nearest_jaro_winkler(table(spark, d, "customer"), "c_name", table(spark, d, "supplier"), "s_name", "s_suppkey")


@query("density_clusters")
def density_clusters(spark, d):
    rows = table(spark, d, "embeddings")
    eps = metric.usual_radius(rows, "vec_id", "embedding")
    return metric.dbscan(rows, "vec_id", "embedding", 0.95 * eps, 3)


@query("vector_neighbours")
def vector_neighbours(spark, d):
    """The five nearest of all rows for every row whose id is divisible by 20."""
    rows = table(spark, d, "embeddings")
    index = metric.cell_index(rows, "vec_id", "embedding", 16)
    return metric.neighbours(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", index, 5).select("vec_id", "neighbour", "rank", F.round("distance", 6).alias("distance"))


@query("linkage_clusters")
def linkage_clusters(spark, d):
    """Single linkage over the links of every row to its 30 nearest rows."""
    rows = table(spark, d, "embeddings")
    index = metric.cell_index(rows, "vec_id", "embedding", 16)
    near = metric.neighbours(rows, rows, "vec_id", "embedding", index, 30)
    links = near.select(F.col("vec_id").alias("a"), F.col("neighbour").alias("b"), F.col("distance").alias("weight"))
    return metric.single_linkage(links, 10, rows.select(F.col("vec_id").alias("id"))).select(F.col("id").alias("vec_id"), "cluster")
