"""Queries of the import of records, of what is saved and loaded again, of cohorts, reports and tables of pairs."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import canonical, dictionary, imports, pairs, predicates, profile, sampling, tfidf
from ..sources import files
from ..sources.files import table
from .corpora import LABELLED
from .registry import QUERIES, SQL, query
from .relational import discount_score
from .text import clean_sql

_ROWS = "WITH r AS (SELECT p_partkey, p_brand AS site, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 100 AS VARCHAR) ELSE p_name || ', ' || p_type END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'high' WHEN p_partkey % 10 = 5 THEN CAST(p_partkey % 100 AS VARCHAR) ELSE '7' END AS value, p_type AS kind FROM part), s AS (SELECT p_partkey, site, upper(trim(name)) AS name, upper(value) AS value, upper(trim(kind)) AS kind FROM r), t AS (SELECT p_partkey, site, CASE WHEN try_cast(name AS DOUBLE) IS NULL THEN name WHEN name = value THEN '' WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN name ELSE value END AS name, kind FROM s)"
_WORDS = f"{_ROWS}, d AS (SELECT DISTINCT 'name' AS text, site, name AS original FROM t UNION ALL SELECT DISTINCT 'kind', site, kind FROM t), w AS (SELECT text, site, original, {clean_sql('original')} AS w FROM d), c AS (SELECT text, site, term, count(*) AS n FROM (SELECT text, site, unnest(w) AS term FROM w) GROUP BY ALL), p AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY text, site) AS percent FROM c), o AS (SELECT text, site, list(term) AS gone FROM p WHERE percent > 20 AND term NOT IN ('%', '#') GROUP BY ALL)"


def _import(spark, d):
    path, k = files.scratch(spark, "import"), F.col("p_partkey")
    name = F.when(k % 5 == 0, (k % 100).cast("string")).otherwise(F.concat("p_name", F.lit(", "), "p_type"))
    value = F.when(k % 3 == 0, "high").when(k % 10 == 5, (k % 100).cast("string")).otherwise("7")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("site"), name.alias("name"), value.alias("value"), F.col("p_type").alias("kind"))
    imports.import_source(rows, "site", ["name", "kind"], path, value="value", named=["name"], most=0.2)
    return path


@query("imported_records", f"{_ROWS} SELECT p_partkey, site, array_to_string({clean_sql('name')}, ' ') AS name, array_to_string({clean_sql('kind')}, ' ') AS kind FROM t")
def imported_records(spark, d):
    return imports.read_import(spark, _import(spark, d), "records").select("p_partkey", "site", "name", "kind")


@query("imported_terms", f"{_WORDS} SELECT 'cleaned' AS what, text, site, original AS term, array_to_string(list_filter(w, lambda x: NOT coalesce(list_contains(gone, x), false)), ' ') AS cleaned, NULL::BIGINT AS n, NULL::DOUBLE AS percent FROM w LEFT JOIN o USING (text, site) UNION ALL SELECT 'word', text, site, term, NULL, n, round(percent, 6) FROM p UNION ALL SELECT 'discarded', text, site, unnest(gone), NULL, NULL, NULL FROM o")
def imported_terms(spark, d):
    path = _import(spark, d)
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    read = lambda what, name, *columns: imports.read_import(spark, path, name).select(F.lit(what).alias("what"), "text", F.col("Site").alias("site"), *columns)
    out = read("cleaned", "cleaned", F.col("Original").alias("term"), F.col("Cleaned").alias("cleaned"), none("long", "n"), none("double", "percent"))
    out = out.unionByName(read("word", "word_counts", F.col("Term").alias("term"), none("string", "cleaned"), F.col("Count").alias("n"), F.round("Percent", 6).alias("percent")))
    return out.unionByName(read("discarded", "discarded", F.col("DiscardedName").alias("term"), none("string", "cleaned"), none("long", "n"), none("double", "percent")))


@query("control_cohort", "WITH c AS (SELECT o_orderkey, o_orderpriority, 0 AS control FROM orders WHERE o_orderpriority = '1-URGENT'), f AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY md5('0|' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)) SELECT * FROM c UNION ALL SELECT o_orderkey, o_orderpriority, 1 FROM f WHERE r <= (SELECT count(*) FROM c)")
def control_cohort(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.with_controls(orders.where("o_orderpriority = '1-URGENT'"), orders, "o_orderkey")


@query("class_shares", "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0|' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus FROM r WHERE r <= greatest(floor(0.3 * n), 1)")
def class_shares(spark, d):
    return sampling.share_per_class(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.3)


def _given_sql(key: str) -> str:
    runs = lambda of: f"SELECT t[i:i + n - 1] AS g FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT string_split(text, ' ') AS t FROM {of}), (VALUES (1), (2), (3)) v(n))"
    return f"WITH d AS ({runs('documents')}), b AS (SELECT DISTINCT g FROM ({runs('benchmark')})), c AS (SELECT {key} AS k, count(*) AS n FROM d GROUP BY ALL) SELECT array_to_string(g, ' ') AS gram, len(g) AS size, coalesce(n, 0) AS n FROM b LEFT JOIN c ON c.k = {key.replace('g', 'b.g', 1) if key == 'g' else 'list_sort(b.g)'}"


def _given(spark, d, ordered):
    words = F.split("text", " ")
    grams = table(spark, d, "benchmark").select(F.explode(F.concat(*[tx.ngrams(words, n) for n in (1, 2, 3)])).alias("g"))
    out = tfidf.given_ngrams(table(spark, d, "documents").select(words.alias("t")), "t", grams, "g", ordered)
    return out.select(F.array_join("gram", " ").alias("gram"), F.size("gram").cast("long").alias("size"), "n")


@query("given_ngram_counts", _given_sql("g"))
def given_ngram_counts(spark, d):
    return _given(spark, d, True)


@query("given_ngram_counts_unordered", _given_sql("list_sort(g)"))
def given_ngram_counts_unordered(spark, d):
    return _given(spark, d, False)


@query("acronym_lookup", "WITH a AS (SELECT DISTINCT upper(left(p_name, 1) || left(split_part(p_name, ' ', 2), 1)) AS a, upper(p_name) AS e FROM part), k AS (SELECT a, list_sort(list(e)) AS es FROM a GROUP BY a) SELECT p_partkey, token, coalesce(array_to_string(es, ';'), '') AS expansions, coalesce(len(es), 0) AS n FROM (SELECT p_partkey, lower(left(p_type, 1)) || 'w' AS token FROM part) LEFT JOIN k ON upper(token) = a")
def acronym_lookup(spark, d):
    path, part = files.scratch(spark, "acronyms"), table(spark, d, "part")
    short = F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1))
    part.select(short.alias("a"), F.col("p_name").alias("e")).write.options(sep="^", header=False).csv(path)
    rows = part.select("p_partkey", F.concat(F.lower(F.substring("p_type", 1, 1)), F.lit("w")).alias("token"))
    out = dictionary.acronym_lookup(rows, "token", files.read_acronyms(spark, path, "^", 1))
    return out.select("p_partkey", "token", F.array_join("expansions", ";").alias("expansions"), F.size("expansions").cast("long").alias("n"))


@query("saved_synonyms", SQL["synonym_keys"])
def saved_synonyms(spark, d):
    path = files.scratch(spark, "synonyms")
    files.load_or_make(spark, path, lambda: QUERIES["synonym_keys"](spark, d), again_if_empty=True)
    return files.load_or_make(spark, path, lambda: None)


@query("descriptor_files", f"SELECT DISTINCT 'p_name' AS name, p_brand AS code, array_to_string({clean_sql('upper(trim(p_name))')}, ' ') AS value, '' AS note FROM part UNION ALL SELECT DISTINCT 'p_type', p_brand, array_to_string({clean_sql('upper(trim(p_type))')}, ' '), '' FROM part")
def descriptor_files(spark, d):
    folder, part, out = files.scratch(spark, "vars"), table(spark, d, "part"), None
    for c in ("p_name", "p_type"):
        files.write_delimited(part.select(F.col("p_brand").alias("code"), c, F.lit(None).cast("string").alias("note")).distinct(), f"{folder}/{c}-vars")
    for c in ("p_name", "p_type"):
        one = files.read_descriptors(spark, folder, [c, "p_none"], f"code string, {c} string, note string", clean=True)[c]
        one = one.select(F.lit(c).alias("name"), "code", F.col(c).alias("value"), "note")
        out = one if out is None else out.unionByName(one)
    return out


@query("code_check_targets", "WITH c AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'Request' WHEN p_partkey % 13 = 0 THEN 'other' ELSE p_brand || '-' || p_size END AS c FROM part) SELECT count(*) AS n, count(*) - count(c) AS nulls, count(*) FILTER (contains(c, '-')) AS hyphens, count(*) FILTER (lower(c) = 'request') AS noisy, count(*) FILTER (c <> 'other' AND c NOT IN (SELECT p_brand || '-' || p_size FROM part WHERE p_size < 20)) AS outside FROM c")
def code_check_targets(spark, d):
    k, own = F.col("p_partkey"), F.concat("p_brand", F.lit("-"), "p_size")
    part = table(spark, d, "part")
    rows = part.select(F.when(k % 7 == 0, None).when(k % 11 == 0, "Request").when(k % 13 == 0, "other").otherwise(own).alias("c"))
    return canonical.check_canonical(rows, "c", targets=part.where("p_size < 20").select(own.alias("c")))


@query("case_report", "WITH f AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_returnflag) <> count(DISTINCT l_linestatus) AS mixed, CASE WHEN count(*) < 5 THEN -1 ELSE avg(l_discount) * 18 END AS s FROM lineitem GROUP BY ALL) SELECT CASE WHEN s < 0 THEN 'low' WHEN s < 0.9 THEN 'hard' ELSE 'easy' END AS class, count(*) AS n_codes, round(count(*) / (SELECT count(*) FROM f), 9) AS ratio, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (mixed) AS n_mixed FROM f GROUP BY ALL")
def case_report(spark, d):
    rows = table(spark, d, "lineitem")
    scores = rows.groupBy("l_suppkey").agg(discount_score().alias("score"))
    return profile.case_report(rows, scores, "l_suppkey", ["l_returnflag", "l_linestatus"]).withColumn("ratio", F.round("ratio", 9))


@query("ranked_predictions", "WITH s AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderkey % 2 AS INT) AS label, (o_orderkey * 37 % 1000) / 1000.0 AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY label, score DESC, o_orderkey) AS place FROM s) SELECT o_orderkey, o_orderpriority, label, CAST(score AS DOUBLE) AS score, place, score < 0.85 AS doubtful FROM r")
def ranked_predictions(spark, d):
    k = F.col("o_orderkey")
    scored = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (k % 2).cast("int").alias("label"), (k * 37 % 1000 / 1000).alias("score"))
    return pairs.ranked_predictions(scored, "o_orderpriority", ["o_orderkey"], "label", "score")


@query("pair_table", f"WITH l AS ({LABELLED}), e AS (SELECT p_brand AS b, max(p_type) AS y FROM part GROUP BY ALL) SELECT l.p_partkey, l.p_brand, candidate AS assignment, label, array_to_string({clean_sql('upper(trim(p.p_name))')}, ' ') AS t_p_name, array_to_string({clean_sql('upper(trim(y))')}, ' ') AS d_p_type FROM l JOIN part p ON p.p_partkey = l.p_partkey JOIN e ON b = candidate")
def pair_table(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_partkey", "p_brand")
    made = pairs.candidate_pairs(rows, rows, "p_partkey", "p_brand")
    return pairs.pair_table(made, part.select("p_partkey", "p_name"), part.select("p_brand", "p_type"), "p_partkey", "p_brand", ["p_name"], ["p_type"], kinds=())


@query("regex_search", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'cold|wid|brass\\+')")
def regex_search(spark, d):
    text = predicates.search_text(["p_name"], ["Cold", "wid", "brass+"], "regex")
    return table(spark, d, "part").where(F.expr(text)).select("p_partkey", "p_name")


_TAG = r"upper(trim(regexp_replace(tag, '(^|[^\w])widget(\W|$)', '\1\2', 'gi')))"


@query("site_free_tags", f"SELECT p_partkey, array_to_string({clean_sql(_TAG)}, ' ') AS tag FROM (SELECT p_partkey, p_name || ' ' || p_type || ' widgets' AS tag FROM part)")
def site_free_tags(spark, d):
    tag = F.concat("p_name", F.lit(" "), "p_type", F.lit(" widgets"))
    return table(spark, d, "part").select("p_partkey", tx.clean_tag(tag, ["widget"]).alias("tag"))
