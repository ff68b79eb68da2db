"""Queries over corpora, statistics of several columns, sets and strings."""

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import cleaning, cluster, corpus, encode, metrics, pairs, predicates, profile, sampling, tfidf
from ..sources.files import table
from .registry import query
from .text import clean_sql

_GRAMS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN ('IN', 'FROM', 'ON', 'OR', 'OF', 'BY', 'AND', 'TO')) AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(0, len(t)), lambda i: t[i + 1])) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(0, len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2])) FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(0, len(t) - 2), lambda i: t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3])) FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT term FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 2000), k AS (SELECT * FROM c SEMI JOIN v USING (term)),
df AS (SELECT term, count(*) AS df FROM k GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM k JOIN df USING (term) CROSS JOIN n), y AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM x)"""


@query("document_ngrams", _GRAMS + " SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM y QUALIFY rank <= 3")
def document_ngrams(spark, d):
    weights = corpus.ngram_weights(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", vocabulary=2000)
    return tfidf.top_terms(weights, "doc_id", 3).withColumn("weight", F.round("weight", 6))


@query("merged_descriptors", "WITH t AS (SELECT p_brand, max(p_type) AS tag FROM part WHERE p_size > 25 GROUP BY ALL), e AS (SELECT p_brand, min(p_name) AS a, nullif(min(p_type), 'ECONOMY') AS b FROM part GROUP BY ALL) SELECT e.p_brand, concat_ws(' ', a, b, tag) AS document FROM e LEFT JOIN t USING (p_brand)")
def merged_descriptors(spark, d):
    part = table(spark, d, "part")
    entries = part.groupBy("p_brand").agg(F.min("p_name").alias("a"), F.nullif(F.min("p_type"), F.lit("ECONOMY")).alias("b"))
    tags = part.where("p_size > 25").groupBy("p_brand").agg(F.max("p_type").alias("tag"))
    return corpus.merged_descriptors(entries, tags, "p_brand", ["a", "b"], "tag")


_JOINED = "upper(trim(concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_type), ''))))"


@query("row_documents", f"WITH c AS (SELECT p_brand, array_to_string(list_sort(list(DISTINCT upper(trim(p_type)))), ' ') AS document FROM part GROUP BY ALL) SELECT p_partkey, concat_ws(' ', nullif(trim(array_to_string({clean_sql(_JOINED)}, ' ')), ''), c.document) AS document FROM part JOIN c USING (p_brand)")
def row_documents(spark, d):
    part = table(spark, d, "part")
    codes = corpus.choose_corpus(None, part.select("p_brand", "p_type"), "p_brand", None, "p_brand", None)
    return corpus.row_documents(part, "p_partkey", ["p_name", "p_type"], codes, "p_brand").select("p_partkey", "document")


@query("tfidf_unsmoothed", r"WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL) SELECT item_id, term, round((1 + ln(tf)) * (1 + ln((SELECT count(*) FROM benchmark) / df)), 6) AS weight FROM tf JOIN df USING (term)")
def tfidf_unsmoothed(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]{2,})"), 1).alias("t"))
    return tfidf.tfidf(items, "item_id", "t", sublinear=True, smooth=False, norm=False).withColumn("weight", F.round("weight", 6))


@query("with_cleaned", f"SELECT p_partkey, array_to_string({clean_sql('upper(trim(p_name))')}, ' ') AS cleaned FROM part")
def with_cleaned(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    terms = cleaning.cleaned_terms(part, "p_brand", ["p_name"])
    return cleaning.with_cleaned(part, terms, "p_brand", "p_name", "cleaned").select("p_partkey", "cleaned")


@query("mean_abs_correlation", "WITH r AS (SELECT unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_tax), corr(l_extendedprice, l_tax)]) AS r FROM lineitem) SELECT round(avg(abs(r)), 6) AS mean_abs_r FROM r")
def mean_abs_correlation(spark, d):
    return profile.mean_abs_correlation(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("mean_abs_r", F.round("mean_abs_r", 6))


@query("interval_about", "WITH r AS (SELECT l_returnflag, l_discount * 12 AS x FROM lineitem), s AS (SELECT l_returnflag, list_sort(list(x)) AS x, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n FROM r GROUP BY ALL), q AS (SELECT l_returnflag, x[CAST(floor(0.05 * n) AS INT) + 1] AS low, least(x[CAST(floor(0.95 * n) AS INT) + 1], 1.0) AS high, m, s FROM s) SELECT l_returnflag, round(low, 6) AS low, round(high, 6) AS high, round(m - low, 6) AS below, round(high - m, 6) AS above, round(s, 6) AS deviation FROM q")
def interval_about(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 12).alias("x"))
    out = profile.interval_about(rows, ["l_returnflag"], "x")
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("informative_scores", "WITH z AS (SELECT l_orderkey, l_linenumber, (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS l_tax FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_tax, 5) AS l_tax FROM z WHERE abs(l_tax) > 1e-12")
def informative_scores(spark, d):
    rows = table(spark, d, "lineitem").withColumn("gone", F.nullif("l_discount", F.lit(0.05)))
    return profile.informative(rows, ["l_orderkey", "l_linenumber"], ["l_tax", "gone"]).withColumn("l_tax", F.round("l_tax", 5))


@query("common_values", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_values(spark, d):
    return profile.common_values(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("frequent_summary", "SELECT p_type, count(p_retailprice) AS n, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY ALL HAVING count(p_retailprice) >= 3")
def frequent_summary(spark, d):
    spread = F.round(F.max("p_retailprice") - F.min("p_retailprice"), 4)
    return metrics.summary_of(table(spark, d, "part"), "p_type", "p_retailprice", 3, spread=spread)


@query("combined_by", "WITH v AS (SELECT doc_id, unnest([quality * 0.7, toxic * 0.4, (doc_id % 7) / 7.0]) AS s FROM labels) SELECT doc_id, round(max(s), 6) AS score FROM v GROUP BY ALL")
def combined_by(spark, d):
    votes = table(spark, d, "labels").select("doc_id", F.explode(F.array(F.col("quality") * 0.7, F.col("toxic") * 0.4, (F.col("doc_id") % 7) / 7.0)).alias("s"))
    return metrics.combine_by(votes, "doc_id", F.round(F.max("s"), 6))


@query("balanced_from_pool", "WITH o AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0), c AS (SELECT o_orderpriority, count(*) AS n FROM o GROUP BY ALL), t AS (SELECT CAST(floor(median(n)) AS BIGINT) AS t FROM c), l AS (SELECT o_orderpriority, t - n AS lack FROM c CROSS JOIN t WHERE n < t), r AS (SELECT p.o_orderkey, p.o_orderpriority, lack, row_number() OVER (PARTITION BY p.o_orderpriority ORDER BY md5('0|' || p.o_orderkey), p.o_orderkey) AS i FROM orders p JOIN l USING (o_orderpriority) WHERE p.o_orderkey % 5 <> 0) SELECT o_orderkey, o_orderpriority FROM o UNION ALL SELECT o_orderkey, o_orderpriority FROM r WHERE i <= lack")
def balanced_from_pool(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.balance_to_median(rows.where("o_orderkey % 5 = 0"), "o_orderpriority", "o_orderkey", pool=rows)


@query("common_substrings", "WITH p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part), s AS (SELECT a, b, i, n, substr(a, i, n) AS t FROM p, unnest(range(1, length(a) + 1)) AS x(i), unnest(range(1, length(a) + 1)) AS y(n) WHERE i + n <= length(a) + 1 AND contains(b, substr(a, i, n))), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, i) AS r FROM s) SELECT p.a, p.b, coalesce(r.t, '') AS common FROM p LEFT JOIN r ON r.a = p.a AND r.b = p.b AND r.r = 1")
def common_substrings(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return rows.withColumn("common", sim.common_substring_text(F.col("a"), F.col("b")))


@query("adjusted_mutual_information", "WITH c AS (SELECT vec_id % 7 AS g, label AS l, count(*) AS n FROM embeddings GROUP BY ALL), a AS (SELECT g, sum(n)::DOUBLE AS a FROM c GROUP BY ALL), b AS (SELECT l, sum(n)::DOUBLE AS b FROM c GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t FROM c), m AS (SELECT sum(n / t * ln(n * t / (a * b))) AS m FROM c JOIN a USING (g) JOIN b USING (l) CROSS JOIN t), k AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM a CROSS JOIN b CROSS JOIN t), e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS e FROM k), h AS (SELECT (SELECT sum(-a / t * ln(a / t)) FROM a CROSS JOIN t) AS ha, (SELECT sum(-b / t * ln(b / t)) FROM b CROSS JOIN t) AS hb) SELECT round((m - e) / ((ha + hb) / 2 - e), 6) AS adjusted_mutual_information FROM m CROSS JOIN e CROSS JOIN h")
def adjusted_mutual_information(spark, d):
    rows = table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 7)
    return cluster.adjusted_mutual_information(rows, "g", "label").withColumn("adjusted_mutual_information", F.round("adjusted_mutual_information", 6))


@query("text_helpers", r"SELECT p_partkey, concat_ws(' ', nullif(trim(p_name), ''), nullif(p_type, 'SMALL')) AS joined, replace('""' || p_name, '""', '') AS bare, list_has_any(string_split(p_name, ' '), string_split(lower(p_type), ' ')) AS shared, split_part(p_name, ' ', 1) = split_part(lower(p_type), ' ', 1) AS begins, p_type IN ('SMALL', 'LARGE') AS listed FROM part".replace('""', '"'))
def text_helpers(spark, d):
    name, kind = F.col("p_name"), F.lower("p_type")
    return table(spark, d, "part").select(
        "p_partkey", tx.conjoin(name, F.nullif("p_type", F.lit("SMALL"))).alias("joined"), tx.dequote(F.concat(F.lit('"'), name)).alias("bare"),
        tx.common_tokens(name, kind).alias("shared"), tx.common_prefix(name, kind).alias("begins"), predicates.equals_any(["p_type"], ["small", "Large"]).alias("listed"),
    )


@query("null_like_values", r"SELECT p_partkey, list_filter([trim(regexp_replace(p_name, '[!-/:-@\[-`{-~]', '', 'g')), 'a'], lambda x: x <> '') AS kept FROM part")
def null_like_values(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.remove_null_like(F.array("p_name", F.lit(" -- "), F.lit(None).cast("string"), F.lit("a."))).alias("kept"))


@query("perturbed", "SELECT c_custkey, round(c_acctbal + 0.01 + CAST('0x' || left(md5('3|' || c_custkey), 13) AS BIGINT) / 4503599627370496.0 * 0.09, 6) AS v FROM customer")
def perturbed(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(encode.perturb(F.col("c_acctbal"), 1.0, 3, "c_custkey"), 6).alias("v"))


@query("processed_texts", f"SELECT p_partkey, array_to_string({clean_sql('upper(trim(p_name))')}, ' ') AS cleaned, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS spaced FROM part")
def processed_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", cleaning.process_text(F.col("p_name")).alias("cleaned"), cleaning.process_text(F.col("p_name"), clean=False, standard=False).alias("spaced"))


@query("nearest_labels", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS q, e.vec_id, q.label = e.label AS same, round(1 - list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS r FROM s) SELECT q AS vec_id, round(avg(same::INT), 6) AS agree FROM r WHERE r <= 5 GROUP BY ALL")
def nearest_labels(spark, d):
    rows = table(spark, d, "embeddings")
    return cluster.knn_agreement(rows, "vec_id", "embedding", "label", rows.where("vec_id % 20 = 0")).withColumn("agree", F.round("agree", 6))


LABELLED = "WITH r AS (SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('0|' || p_partkey), p_partkey) <= 3), b AS (SELECT p_brand, row_number() OVER (ORDER BY md5('0|' || p_brand), p_brand) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)), k AS (SELECT p_brand, i, n, unnest(range(1, least(10, greatest(n - 1, 1)) + 1)) AS k FROM b WHERE n > 1), o AS (SELECT k.p_brand, x.p_brand AS candidate FROM k JOIN b x ON x.i = (k.i + k.k) % k.n) SELECT p_partkey, p_brand, p_brand AS candidate, 1 AS label FROM r UNION ALL SELECT p_partkey, p_brand, candidate, 0 FROM r JOIN o USING (p_brand)"


@query("labelled_pairs", LABELLED)
def labelled_pairs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand")
    return pairs.candidate_pairs(rows, rows, "p_partkey", "p_brand")
