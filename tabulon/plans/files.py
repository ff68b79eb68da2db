"""Queries that write tables to the shared folder in the library's formats and read them again, and those over what is read."""

from pyspark.sql import functions as F

from ..operators import canonical, models, profile, roles
from ..sources import files
from ..sources.files import table
from ..streaming.ingest import ingest
from .registry import query


@query("delimited_round_trip", "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def delimited_round_trip(spark, d):
    path = files.scratch(spark, "customers")
    rows = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_name")
    files.write_delimited(rows, path, "|")
    return files.read_delimited(spark, path, "c_custkey long, c_mktsegment string, c_name string", "|", ["c_custkey", "c_name", "c_mktsegment"])


@query("silver_records", "WITH r AS (SELECT c_custkey % 100 AS a, c_mktsegment AS m, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'Request' ELSE (c_custkey % 100) || '-' || (c_custkey % 3) || '.x' END AS code, c_custkey AS seq FROM customer), o AS (SELECT a, m, code, max(seq) AS seq FROM r GROUP BY ALL) SELECT a, m, CASE WHEN code IS NULL OR code = 'Request' THEN 'unknown' ELSE regexp_replace(replace(code, '-', ''), '(\\.|;)[a-zA-Z0-9]*', '', 'g') END AS code, seq FROM o")
def silver_records(spark, d):
    k = F.col("c_custkey")
    code = F.when(k % 10 == 0, None).when(k % 10 == 1, "Request").otherwise(F.concat(k % 100, F.lit("-"), k % 3, F.lit(".x")))
    raw = table(spark, d, "customer").select((k % 100).alias("a"), F.col("c_mktsegment").alias("m"), code.alias("code"), k.alias("seq"))
    return files.silver(spark, raw, files.scratch(spark, "silver"), "code", "seq")


@query("code_map", "SELECT DISTINCT CAST(10000 + p_size AS VARCHAR) AS code, left(CAST(10000 + p_size AS VARCHAR), 3) || '.' || substr(CAST(10000 + p_size AS VARCHAR), 4) AS dotted, p_type AS name FROM part")
def code_map(spark, d):
    path = files.scratch(spark, "codes")
    files.write_delimited(table(spark, d, "part").select((10000 + F.col("p_size")).cast("string").alias("k"), F.col("p_type").alias("v")), path)
    return files.read_code_map(spark, path, "k", "v")


@query("dictionary_table", "WITH r AS (SELECT DISTINCT replace(p_brand || '-' || p_size, '-', '') AS code, replace('\"' || p_name || '\"', '\"', '') AS tag FROM part) SELECT code, tag FROM r QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(tag) DESC, tag) = 1")
def dictionary_table(spark, d):
    path = files.scratch(spark, "dictionary")
    rows = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), "p_size").alias("code"), F.concat(F.lit('"'), "p_name", F.lit('"')).alias("tag"))
    files.write_dictionary(rows, path, "code")
    return files.dictionary_table(files.read_delimited(spark, path, "code string, tag string"), "code", "tag")


@query("pair_files", "SELECT o_orderkey % 2 AS label, round(o_totalprice / 1000, 3) AS score, o_orderpriority AS code FROM orders")
def pair_files(spark, d):
    path, order = files.scratch(spark, "pairs"), {"label": ["label"], "features": ["score"], "meta": ["code", "note"]}
    rows = table(spark, d, "orders").select(F.lit("x").alias("note"), F.col("o_orderpriority").alias("code"), F.round(F.col("o_totalprice") / 1000, 3).alias("score"), (F.col("o_orderkey") % 2).alias("label"))
    files.write_pairs(rows, path, order)
    return files.read_pairs(spark, path, "label long, score double, code string, note string", order, ["note"])


@query("score_files", "SELECT 'm' || doc_id % 3 AS method, 'auc' AS metric, CAST(doc_id % 5 AS INT) AS fold, avg(quality) AS value FROM labels GROUP BY ALL")
def score_files(spark, d):
    path = files.scratch(spark, "scores")
    k = F.col("doc_id")
    files.write_scores(table(spark, d, "labels").groupBy(F.concat(F.lit("m"), k % 3).alias("method"), F.lit("auc").alias("metric"), (k % 5).cast("int").alias("fold")).agg(F.avg("quality").alias("value")), path)
    return files.read_scores(spark, path)


@query("saved_searches", "SELECT 'parts' AS name, 'like' AS kind, count(*) FILTER (contains(lower(p_name), 'a') OR contains(lower(p_name), '50%_')) AS n FROM part")
def saved_searches(spark, d):
    from ..operators.predicates import search_text

    path = files.scratch(spark, "searches")
    files.write_searches(spark.createDataFrame([("parts", "like", search_text(["p_name"], ["A", "50%_"]))], "name string, kind string, text string"), path)
    name, kind, text = files.read_searches(spark, path).first()  # one saved search
    return table(spark, d, "part").agg(F.count_if(F.expr(text)).alias("n")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n")


@query("group_folders", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")
def group_folders(spark, d):
    path = files.scratch(spark, "groups")
    files.write_groups(table(spark, d, "customer").select("c_custkey", "c_nationkey"), path, ["c_nationkey"])
    return files.read_group(spark, path, c_nationkey=7).select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))


@query("ingested_rows", "SELECT DISTINCT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE (c_custkey % 7) || '' || (c_custkey % 3) END AS code FROM customer")
def ingested_rows(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 10 != 0, F.concat(k % 7, F.lit("-"), k % 3)).alias("code"))
    source, target, marks = (files.scratch(spark, n) for n in ("source", "target", "marks"))
    for part in (rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), rows):  # later batches repeat rows of earlier ones
        part.write.mode("append").parquet(source)
        ingest(spark, source, "id long, code string", target, marks, "id", "code").awaitTermination()
    return spark.read.parquet(target).select("id", "code")


@query("role_columns", "SELECT * FROM (VALUES ('money', 'l_extendedprice', 'price'), ('money', 'l_discount', 'discount'), ('money', 'l_tax', 'tax'), ('key', 'l_orderkey', 'orderkey')) AS t(role, name, short)")
def role_columns(spark, d):
    names = [c for c in table(spark, d, "lineitem").columns if c in ("l_extendedprice", "l_discount", "l_tax", "l_orderkey")]
    short = roles.short_names(names, "l_", {"extendedprice": "price"})
    told = roles.by_prefix(names, {"money": ["l_ext", "l_disc", "l_tax"], "key": ["l_order"]})
    return spark.createDataFrame([(r, c, short[c]) for r, cs in told.items() for c in cs], "role string, name string, short string")


@query("scaled_features", "SELECT count(*) AS n, count(DISTINCT a) AS n_values, round(min(a), 6) AS low, round(max(a), 6) AS high FROM (SELECT (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS a FROM lineitem)")
def scaled_features(spark, d):
    x, _ = roles.to_xy(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_returnflag", untracked=["l_orderkey", "l_linenumber"], scaler="minmax")
    return x.agg(F.count("*").alias("n"), F.count_distinct("l_quantity").alias("n_values"), F.round(F.min("l_quantity"), 6).alias("low"), F.round(F.max("l_quantity"), 6).alias("high"))


@query("threshold_votes", "SELECT doc_id, CAST((quality + toxic) / 2.0 >= 0.5 AS INT) AS prediction FROM labels")
def threshold_votes(spark, d):
    return models.ThresholdClassifier(inputCols=["quality", "toxic"], threshold=0.5).transform(table(spark, d, "labels")).select("doc_id", "prediction")


@query("checked_join", "SELECT l.doc_id, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id)")
def checked_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return profile.join_all(docs, table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("listed_codes", "SELECT p_partkey, CASE WHEN c IN (SELECT 'b' || r_regionkey FROM region) THEN c WHEN c = 'unknown' THEN c ELSE 'other' END AS c FROM (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'unknown' ELSE 'b' || p_size % 8 END AS c FROM part)")
def listed_codes(spark, d):
    size = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.when(size % 9 != 0, F.concat(F.lit("B-"), size % 8)).alias("c"))
    return canonical.canonicalize(rows, "c", table(spark, d, "region").select(F.concat(F.lit("b"), "r_regionkey").alias("c")))
