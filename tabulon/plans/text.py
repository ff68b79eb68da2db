"""Queries over text: cleaning, tokens, dictionary expansion, matching."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import dictionary, nearest, predicates, profile, tfidf
from ..sources.files import table
from .registry import query

STOP = "('', 'IN', 'FROM', 'ON', 'OR', 'OF', 'BY', 'AND', '&', 'TO')"


def clean_sql(c: str) -> str:
    """The cleaner's tokens in SQL: first occurrences, then the pieces of each up to an empty one or a stop word."""
    marks = "',.:' || chr(9) || '^+*~()![]{}_|\"'"
    raw = rf"list_filter(list_transform(string_split(translate(replace(coalesce({c}, ''), '''', ''), {marks}, repeat(' ', 19)), ' '), lambda x: regexp_replace(x, '\d{{1,2}}[/-]\d{{1,4}}([/-]\d{{2,4}})*|\d{{6}}', '', 'g')), lambda x: x <> '')"
    first = f"list_transform([{raw}], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))[1]"
    cut = f"list_transform(list_transform({first}, lambda t: string_split(translate(t, '/\\-', '   '), ' ')), lambda s: s[1:coalesce(nullif(coalesce(list_position(list_transform(s, lambda p: p IN {STOP}), true), 0), 0) - 1, len(s))])"
    return f"flatten({cut})"


def _site_tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("source", F.explode(tx.clean_tokens(F.col("text"))).alias("token"))


_SITE = f"WITH t AS (SELECT source, unnest({clean_sql('text')}) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM t GROUP BY ALL)"


@query("site_word_topn", _SITE + ", s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY source), 9) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rank FROM c) SELECT source, token, n, share, rank FROM s WHERE rank <= 10")
def site_word_topn(spark, d):
    counts = profile.share_of_group(_site_tokens(spark, d).groupBy("source", "token").agg(F.count("*").alias("n")), ["source"], "n")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "token"))
    return counts.withColumns({"share": F.round("share", 9), "rank": rank}).where("rank <= 10")


@query("frequent_tokens", _SITE + ", s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share FROM c) SELECT source, token, n FROM s WHERE share > 0.01 AND token NOT IN ('%', '#')")
def frequent_tokens(spark, d):
    counts = profile.share_of_group(_site_tokens(spark, d).groupBy("source", "token").agg(F.count("*").alias("n")), ["source"], "n")
    return counts.where("share > 0.01 and token not in ('%', '#')").select("source", "token", "n")


_BOTH = clean_sql("upper(p_name || ' / ' || p_brand || '-' || p_type)")


@query("clean_names", f"SELECT p_partkey, upper(trim(p_name)) AS std, array_to_string({_BOTH}, ' ') AS cleaned FROM part")
def clean_names(spark, d):
    both = F.upper(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("-"), "p_type"))
    return table(spark, d, "part").select("p_partkey", tx.standardize(F.col("p_name")).alias("std"), tx.clean_term(both).alias("cleaned"))


@query("page_brackets", r"SELECT page_id, regexp_replace(url || ' [a b/c] [x-y]', '\[[A-Za-z0-9\s/]*\]', '', 'g') AS plain, regexp_replace(replace(url, '-', ''), '-\d+', '', 'g') AS code FROM pages")
def page_brackets(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", tx.strip_brackets(F.concat(url, F.lit(" [a b/c] [x-y]"))).alias("plain"), tx.dehyphenate(tx.dehyphenate(url), True).alias("code"))


@query("phrase_search", r"SELECT doc_id, regexp_matches(text, '(?i)^.*the of([^\w.*]|$)') AS phrase, contains(lower(text), 'license') OR contains(lower(source), 'src1') AS keyword FROM documents")
def phrase_search(spark, d):
    return table(spark, d, "documents").select("doc_id", predicates.phrase("text", "the of").alias("phrase"), (predicates.contains_any(["text"], ["license"]) | predicates.contains_any(["source"], ["src1"])).alias("keyword"))


@query("ngram_counts", "WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS t FROM part), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) AS g FROM w) SELECT array_to_string(g, ' ') AS gram, count(*) AS n FROM g GROUP BY ALL")
def ngram_counts(spark, d):
    t = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    return table(spark, d, "part").select(F.explode(tx.ngrams(t, 2)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"))


@query("ngram_counts_unordered", "WITH w AS (SELECT string_split(p_name || ' ' || lower(p_type), ' ') AS t FROM part), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: list_sort(t[i:i + 1]))) AS g FROM w) SELECT array_to_string(g, ' ') AS gram, count(*) AS n FROM g GROUP BY ALL")
def ngram_counts_unordered(spark, d):
    t = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    return table(spark, d, "part").select(F.explode(tx.ngrams(t, 2, ordered=False)).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"))


def _names(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))


@query("name_jaccard", "WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS t FROM part), w AS (SELECT p_name, unnest(t) AS w FROM n), p AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM w a JOIN w b ON a.w = b.w AND a.p_name < b.p_name) SELECT a, b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM p JOIN n x ON x.p_name = a JOIN n y ON y.p_name = b")
def name_jaccard(spark, d):
    words = _names(spark, d).select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    pairs = words.select(F.col("p_name").alias("a"), "w").join(words.select(F.col("p_name").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("jaccard", F.round(sim.jaccard(F.split("a", " "), F.split("b", " ")), 6))


@query("nearest_name", "WITH v AS (SELECT DISTINCT p_type AS value FROM part), t AS (SELECT upper(n_name) AS target, min(n_nationkey) AS ord FROM nation GROUP BY ALL), p AS (SELECT value, target, levenshtein(value, target) AS distance, row_number() OVER (PARTITION BY value ORDER BY levenshtein(value, target), ord, target) AS r FROM v CROSS JOIN t) SELECT value, target, CAST(distance AS INT) AS distance FROM p WHERE r = 1")
def nearest_name(spark, d):
    targets = table(spark, d, "nation").select(F.upper("n_name").alias("n"), "n_nationkey")
    return nearest.nearest(table(spark, d, "part"), "p_type", targets, "n", "n_nationkey")


@query("nearest_name_jaro_winkler", "WITH v AS (SELECT DISTINCT p_type AS value FROM part), t AS (SELECT upper(n_name) AS target, min(n_nationkey) AS ord FROM nation GROUP BY ALL), p AS (SELECT value, target, round(1 - jaro_winkler_similarity(value, target), 9) AS distance, row_number() OVER (PARTITION BY value ORDER BY round(1 - jaro_winkler_similarity(value, target), 9), ord, target) AS r FROM v CROSS JOIN t) SELECT value, target, distance FROM p WHERE r = 1")
def nearest_name_jaro_winkler(spark, d):
    targets = table(spark, d, "nation").select(F.upper("n_name").alias("n"), "n_nationkey")
    return nearest.nearest_jaro_winkler(table(spark, d, "part"), "p_type", targets, "n", "n_nationkey")


@query("token_similarity")
def token_similarity(spark, d):
    names = _names(spark, d).select(F.col("p_name").alias("a"))
    types = table(spark, d, "part").select("p_name", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("b"), F.col("p_name").alias("a")).select("a", "b").distinct()
    return nearest.token_similarity(types.join(names, "a", "left_semi"), "a", "b", sim.ratio_column)


@query("synonym_keys", "WITH d AS (SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'M' || p_partkey % 5 END AS m, CASE p_partkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DISCOURAGED' ELSE 'DEPRECATED' END AS s, p_partkey % 13 AS v FROM part), g AS (SELECT *, count(*) OVER w AS n, sum((m IS NULL)::INT) OVER w AS bare, max(CASE WHEN m IS NULL THEN p_partkey END) OVER w AS k1, sum((s = 'ACTIVE')::INT) OVER w AS act, max(CASE WHEN s = 'ACTIVE' THEN p_partkey END) OVER w AS k2, sum((m IS NULL AND s = 'ACTIVE')::INT) OVER w AS ba, max(CASE WHEN m IS NULL AND s = 'ACTIVE' THEN p_partkey END) OVER w AS k3, sum((m IS NULL AND s = 'DISCOURAGED')::INT) OVER w AS bd, max(CASE WHEN m IS NULL AND s = 'DISCOURAGED' THEN p_partkey END) OVER w AS k4, sum((s <> 'DEPRECATED')::INT) OVER w AS alive, max(CASE WHEN m IS NULL THEN v * 10000000 + p_partkey END) OVER w % 10000000 AS k5 FROM d WINDOW w AS (PARTITION BY p_brand, p_type, p_size)), k AS (SELECT p_partkey, n, CASE WHEN bare = 1 THEN k1 WHEN bare = 0 THEN CASE WHEN act = 1 THEN k2 END WHEN ba = 1 THEN k3 WHEN bd = 1 THEN k4 WHEN alive = 0 THEN k5 END AS key FROM g) SELECT p_partkey, key FROM k WHERE n > 1 AND key IS NOT NULL")
def synonym_keys(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.when(k % 3 != 0, F.concat(F.lit("M"), k % 5)).alias("m"), F.when(k % 4 == 0, "ACTIVE").when(k % 4 == 1, "DISCOURAGED").otherwise("DEPRECATED").alias("s"), (k % 13).alias("v"))
    return dictionary.synonym_keys(rows, ["p_brand", "p_type", "p_size"], "p_partkey", "m", "s", "v")


@query("token_expansions", "WITH p AS (SELECT string_split(p_brand, '#') AS s, string_split(p_name || ' ' || p_type, ' ') AS l FROM part), w AS (SELECT l, len(s) AS ns, len(l) AS nl, unnest(s) AS token, unnest(range(len(s))) AS i FROM p), r AS (SELECT token, l, nl, CASE WHEN nl >= ns THEN i ELSE i - 2 END AS b, unnest([1, 2, 3]) AS k FROM w) SELECT token, array_to_string(l[b + 1:b + k], ' ') AS expansion, count(*) AS n FROM r WHERE b >= 0 AND b + k <= nl GROUP BY ALL")
def token_expansions(spark, d):
    rows = table(spark, d, "part").select(F.split("p_brand", "#").alias("s"), F.split(F.concat("p_name", F.lit(" "), "p_type"), " ").alias("l"))
    return dictionary.expansions(rows, "s", "l")


@query("acronyms", "SELECT DISTINCT upper(p_name) AS name, left(split_part(upper(p_name), ' ', 1), 1) || left(split_part(upper(p_name), ' ', 2), 1) AS token, CASE WHEN split_part(upper(p_name), ' ', 2) <> '' THEN split_part(upper(p_name), ' ', 1) || ' ' || split_part(upper(p_name), ' ', 2) END AS expansion FROM part")
def acronyms(spark, d):
    name = F.upper("p_name")
    token = F.concat(F.substring(F.split_part(name, F.lit(" "), F.lit(1)), 1, 1), F.substring(F.split_part(name, F.lit(" "), F.lit(2)), 1, 1))
    return table(spark, d, "part").select(name.alias("name"), token.alias("token")).distinct().withColumn("expansion", dictionary.acronym(F.col("token"), F.concat("name", F.lit(" REST"))))


@query("one_tag", "WITH r AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS r FROM part) SELECT p_brand, p_name, p_partkey FROM r WHERE r = 1")
def one_tag(spark, d):
    return dictionary.one_tag(table(spark, d, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", "p_name", "p_partkey")


@query("code_documents", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT upper(trim(p_name)))), ' ') || ' ' || array_to_string(list_sort(list(DISTINCT upper(trim(p_type)))), ' ') AS document FROM part GROUP BY p_brand")
def code_documents(spark, d):
    return dictionary.code_documents(table(spark, d, "part"), "p_brand", ["p_name", "p_type"])


_W = r"WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), x AS (SELECT item_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term) CROSS JOIN n), y AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight FROM x)"


def _weights(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]{2,})"), 1).alias("t"))
    return tfidf.tfidf(items, "item_id", "t")


@query("tfidf_weights", _W + " SELECT item_id, term, round(weight, 6) AS weight FROM y")
def tfidf_weights(spark, d):
    return _weights(spark, d).withColumn("weight", F.round("weight", 6))


@query("tfidf_cosine", _W + " SELECT a.item_id AS a, b.item_id AS b, round(sum(a.weight * b.weight), 6) AS cosine FROM y a JOIN y b ON a.term = b.term AND b.item_id = a.item_id + 1 GROUP BY ALL")
def tfidf_cosine(spark, d):
    items = table(spark, d, "benchmark")
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return tfidf.similar(pairs, _weights(spark, d), "a", "b", "item_id").where("cosine > 0").withColumn("cosine", F.round("cosine", 6))


def _counts(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]{2,})"), 1).alias("t"))
    return tfidf.term_counts(items, "item_id", "t")


_TF = r"WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY ALL)"


@query("term_frequencies", _TF + " SELECT item_id, term, tf, round(1 + ln(tf), 6) AS sublinear, round(0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY item_id), 6) AS augmented FROM tf")
def term_frequencies(spark, d):
    return tfidf.term_frequencies(_counts(spark, d), "item_id").withColumns({c: F.round(c, 6) for c in ("sublinear", "augmented")})


@query("limited_vocabulary", _TF + ", v AS (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 50) SELECT item_id, term, tf FROM tf SEMI JOIN v USING (term)")
def limited_vocabulary(spark, d):
    return tfidf.limit_vocabulary(_counts(spark, d), 50).select("item_id", "term", "tf")
