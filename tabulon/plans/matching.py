"""Queries for cleaning tables, tokens, expansions, string features and scored pairs."""

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import cleaning, dictionary, models, nearest, pairs, tfidf
from ..operators.steps import written
from ..sources.files import table
from .registry import SQL, query
from .text import _W, STOP, _weights, clean_sql

_SITE_TERMS = f"WITH t AS (SELECT DISTINCT p_brand, upper(trim(p_name || ' / ' || p_type)) AS original FROM part), c AS (SELECT p_brand, original, {clean_sql('original')} AS w FROM t)"


def _sites(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(" / "), "p_type").alias("term"))


@query("cleaned_terms", _SITE_TERMS + " SELECT p_brand, 'term' AS \"column\", original, array_to_string(w, ' ') AS cleaned FROM c")
def cleaned_terms(spark, d):
    return cleaning.cleaned_terms(_sites(spark, d), "p_brand", ["term"])


@query("discarded_tokens", _SITE_TERMS + ", u AS (SELECT p_brand, w, unnest(string_split(original, ' ')) AS token FROM c) SELECT DISTINCT p_brand, token FROM u WHERE token <> '' AND NOT list_contains(w, token)")
def discarded_tokens(spark, d):
    return cleaning.discarded_tokens(_sites(spark, d), "p_brand", "term")


_WORDS = f"WITH k AS (SELECT p_partkey, p_brand, {clean_sql('upper(trim(p_name))')} AS w FROM part), u AS (SELECT p_partkey, p_brand, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM k), n AS (SELECT p_brand, term, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) * 100 AS percent FROM n)"


@query("site_words", _WORDS + " SELECT p_brand, term, n, round(percent, 6) AS percent FROM s")
def site_words(spark, d):
    return cleaning.word_counts(table(spark, d, "part"), "p_brand", "p_name").withColumn("percent", F.round("percent", 6))


@query("without_frequent", _WORDS + " SELECT k.p_brand, k.p_partkey, coalesce(string_agg(u.term, ' ' ORDER BY u.i) FILTER (s.percent <= 7), '') AS cleaned FROM k LEFT JOIN u USING (p_brand, p_partkey) LEFT JOIN s ON s.p_brand = k.p_brand AND s.term = u.term GROUP BY ALL")
def without_frequent(spark, d):
    return cleaning.without_frequent(table(spark, d, "part"), "p_brand", "p_partkey", "p_name", 0.07)


_MARKS = "',.:' || chr(9) || '^+*~()![]{}_|\"-/\\#?%<>@='"


@query("dictionary_tokens", f"SELECT p_partkey, array_to_string(list_filter(string_split(translate(upper(p_name || ' of ' || p_brand || '/' || p_type), {_MARKS}, repeat(' ', 29)), ' '), lambda t: t NOT IN {STOP}), ' ') AS tokens FROM part")
def dictionary_tokens(spark, d):
    both = F.upper(F.concat("p_name", F.lit(" of "), "p_brand", F.lit("/"), "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.dictionary_tokens(both), " ").alias("tokens"))


@query("word_dedup", "WITH t AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM t")
def word_dedup(spark, d):
    both = F.concat_ws(" ", "p_name", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", tx.dedup_words(both).alias("words"))


@query("resolved_names", "WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '12' WHEN 1 THEN p_name WHEN 2 THEN '5.5' ELSE '-7' END AS n, CASE p_partkey % 3 WHEN 0 THEN '12' WHEN 1 THEN p_type END AS v FROM part) SELECT p_partkey, CASE WHEN try_cast(n AS DOUBLE) IS NULL THEN n WHEN n = v THEN '' WHEN v IS NULL OR try_cast(v AS DOUBLE) IS NOT NULL THEN n ELSE v END AS name, v AS value FROM r")
def resolved_names(spark, d):
    k = F.col("p_partkey")
    name, value = F.when(k % 4 == 0, "12").when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, "5.5").otherwise("-7"), F.when(k % 3 == 0, "12").when(k % 3 == 1, F.col("p_type"))
    new, same = tx.resolve_value(name, value)
    return table(spark, d, "part").select("p_partkey", new.alias("name"), same.alias("value"))


_SLOT = "p_name || ' (' || replace(p_brand, '#', '-') || ') [mg/' || p_type || '] -- see ' || p_type"


@query("name_slots", rf"WITH t AS (SELECT p_partkey, {_SLOT} AS c FROM part) SELECT p_partkey, regexp_extract(c, '^[^\[]+\[([^\]]*)\]', 1) AS unit, trim(regexp_extract(c, '([A-Za-z0-9,'' -]+?)\s*\(([A-Za-z0-9 .-]+)\)', 1)) AS compound, regexp_extract(c, '([A-Za-z0-9,'' -]+?)\s*\(([A-Za-z0-9 .-]+)\)', 2) AS abbrev, trim(regexp_extract(c, '--\s*(.*)$', 1)) AS note FROM t")
def name_slots(spark, d):
    text = F.concat("p_name", F.lit(" ("), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(") [mg/"), "p_type", F.lit("] -- see "), "p_type")
    return table(spark, d, "part").select("p_partkey", tx.slots(text).alias("s")).select("p_partkey", "s.*")


@query("word_tokens", "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[-0-9a-z_:.]+')) AS token FROM benchmark) SELECT token, count(*) AS n FROM w GROUP BY ALL")
def word_tokens(spark, d):
    return table(spark, d, "benchmark").select(F.explode(tx.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("row_expansions", "WITH r AS (SELECT unnest([lower(p_type), lower(p_brand)]) AS token, string_split(p_name, ' ') AS l FROM part), e AS (SELECT token, list_sort(list_transform(l, lambda t, i: {'d': levenshtein(token, t), 'i': i, 't': t}))[1].t AS expansion FROM r), c AS (SELECT token, expansion, count(*) AS n FROM e GROUP BY ALL) SELECT token, expansion, n FROM c QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, expansion) = 1")
def row_expansions(spark, d):
    rows = table(spark, d, "part").select(F.array(F.lower("p_type"), F.lower("p_brand")).alias("s"), F.split("p_name", " ").alias("l"))
    return dictionary.nearest_in_row(rows, "s", "l")


_ACRONYM = "CASE WHEN length(token) > 1 AND len(string_split(expansion, ' ')) >= length(token) AND len(list_filter(range(1, length(token) + 1), lambda i: left(string_split(expansion, ' ')[i], 1) = substr(token, i, 1))) = length(token) THEN array_to_string(string_split(expansion, ' ')[1:length(token)], ' ') END"


@query("final_expansions", f"WITH e AS ({SQL['token_expansions']}), y AS (SELECT upper(left(n_name, 2)) AS token, min(upper(n_name)) AS sys FROM nation GROUP BY ALL UNION ALL SELECT 'Brand', 'BRAND NAME'), t AS (SELECT token, expansion, {_ACRONYM} AS a FROM e QUALIFY n = max(n) OVER (PARTITION BY token)), b AS (SELECT token, min(a) AS a, bool_or(token = expansion) AS same, first(expansion ORDER BY length(expansion), expansion) AS short FROM t GROUP BY ALL) SELECT coalesce(b.token, y.token) AS token, coalesce(a, CASE WHEN same THEN b.token END, sys, short) AS expansion FROM b FULL JOIN y ON b.token = y.token")
def final_expansions(spark, d):
    rows = table(spark, d, "part").select(F.split("p_brand", "#").alias("s"), F.split(F.concat("p_name", F.lit(" "), "p_type"), " ").alias("l"))
    system = table(spark, d, "nation").groupBy(F.upper(F.substring("n_name", 1, 2)).alias("token")).agg(F.min(F.upper("n_name")).alias("expansion"))
    system = system.unionByName(spark.createDataFrame([("Brand", "BRAND NAME")], "token string, expansion string"))
    return dictionary.final_map(system, dictionary.expansions(rows, "s", "l"))


@query("reexpressed_names", "WITH v AS (SELECT DISTINCT upper(p_name) AS value FROM part), t AS (SELECT value, unnest(string_split(value, ' ')) AS tok, generate_subscripts(string_split(value, ' '), 1) AS pos FROM v), n AS (SELECT upper(n_name) AS token, n_nationkey AS ord FROM nation), w AS (SELECT DISTINCT tok FROM t), b AS (SELECT tok, token, row_number() OVER (PARTITION BY tok ORDER BY levenshtein(tok, token), ord, token) AS r FROM w, n) SELECT value, string_agg(CASE WHEN left(tok, 1) = left(token, 1) THEN token || ' LAND' ELSE tok END, ' ' ORDER BY pos) AS text FROM t JOIN b USING (tok) WHERE r = 1 GROUP BY ALL")
def reexpressed_names(spark, d):
    short = table(spark, d, "nation").select(F.upper("n_name").alias("token"), F.concat(F.upper("n_name"), F.lit(" LAND")).alias("expansion"), F.col("n_nationkey").alias("ord"))
    return nearest.reexpress(table(spark, d, "part").select(F.upper("p_name").alias("value")), "value", short)


def _near(part: str, of: str, name: str, key: str) -> str:
    return f"{part} AS (SELECT value, t AS {part}_lv, d AS {part}_lv_dist FROM (SELECT value, upper({name}) AS t, levenshtein(value, upper({name})) AS d, {key} AS o FROM v, {of}) QUALIFY row_number() OVER (PARTITION BY value ORDER BY d, o, t) = 1)"


@query("part_features", f"WITH v AS (SELECT DISTINCT p_type AS value FROM part), {_near('land', 'nation', 'n_name', 'n_nationkey')}, {_near('zone', 'region', 'r_name', 'r_regionkey')} SELECT * FROM land JOIN zone USING (value)")
def part_features(spark, d):
    land = table(spark, d, "nation").select(F.upper("n_name").alias("text"), F.col("n_nationkey").alias("ord"))
    zone = table(spark, d, "region").select(F.upper("r_name").alias("text"), F.col("r_regionkey").alias("ord"))
    return nearest.part_features(table(spark, d, "part"), "p_type", {"land": land, "zone": zone}, {"lv": nearest.nearest})


@query("compared_parts", r"WITH d AS (SELECT p_brand, min(p_name) AS a, min(p_type) AS b FROM part GROUP BY ALL), r AS (SELECT p_partkey, string_split(upper(p_name || ' ' || p_type), ' ') AS t, string_split(upper(a), ' ') AS a, string_split(upper(b), ' ') AS b FROM part JOIN d USING (p_brand)) SELECT p_partkey, len(list_intersect(t, a)) AS n_a, len(list_intersect(t, b)) AS n_b FROM r")
def compared_parts(spark, d):
    part = table(spark, d, "part")
    entries = part.groupBy("p_brand").agg(F.min("p_name").alias("a"), F.min("p_type").alias("b"))
    rows = part.select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return dictionary.compare_parts(rows, entries, "p_brand", "t", ["a", "b"]).select("p_partkey", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"))


@query("tfidf_top_terms", _W + ", r AS (SELECT item_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 9) DESC, term) AS rank FROM y) SELECT * FROM r WHERE rank <= 5")
def tfidf_top_terms(spark, d):
    return tfidf.top_terms(_weights(spark, d), "item_id", 5).withColumn("weight", F.round("weight", 6))


@query("tfidf_group_terms", _W + ", g AS (SELECT item_id % 4 AS g, count(*) AS n FROM benchmark GROUP BY ALL), m AS (SELECT item_id % 4 AS g, term, sum(CASE WHEN weight >= 0.1 THEN weight ELSE 0 END) AS s FROM y GROUP BY ALL), r AS (SELECT g, term, s / n AS weight, row_number() OVER (PARTITION BY g ORDER BY round(s / n, 9) DESC, term) AS rank FROM m JOIN g USING (g)) SELECT g, term, round(weight, 6) AS weight, rank FROM r WHERE rank <= 5")
def tfidf_group_terms(spark, d):
    groups = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 4).alias("g"))
    return tfidf.mean_terms(_weights(spark, d), groups, "item_id", "g", 5).withColumn("weight", F.round("weight", 6))


def _pairs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    found = pairs.candidate_pairs(rows, rows, "p_partkey", "p_brand")
    return pairs.pair_features(found, rows, rows, "p_partkey", "p_brand", ["p_name", "p_type"], ["p_name"], sim.ratio_column)


@query("pair_features")
def pair_features(spark, d):
    return _pairs(spark, d)


@query("scored_pairs")
def scored_pairs(spark, d):
    rows = written(_pairs(spark, d), "features")  # read by every pass of the fit
    names = [c for c in rows.columns if c.endswith(("_sdist", "_tfidf"))]
    return models.score_candidates(rows.where("p_partkey % 5 <> 0"), rows.where("p_partkey % 5 = 0"), names, "label")
