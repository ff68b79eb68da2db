"""Reference dictionary: one tag per code, synonym keys, expansions of short tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def one_tag(df: DataFrame, code: str, tag: str, order: str) -> DataFrame:
    """The longest tag of every code, the first of equals."""
    best = F.row_number().over(W.partitionBy(code).orderBy(F.desc(F.length(tag)), order))
    return df.withColumn("_r", best).where("_r = 1").drop("_r")


def lookup(df: DataFrame, dictionary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left look-up of columns by key, '' where there is none. Spark broadcasts the dictionary if it is small."""
    return df.join(dictionary.select(key, *columns), key, "left").fillna("", columns)


def synonym_keys(df: DataFrame, parts: list[str], code: str, method: str, status: str, version: str) -> DataFrame:
    """(code, key) for groups of two or more codes that agree in all parts (nulls never agree). The key is the only one
    without method; if all have one, the only active; else the only active one without method; the only discouraged one
    without method; or, if all are deprecated, the latest without method."""
    rows = df.where(" and ".join(f"{p} is not null" for p in parts))
    by = W.partitionBy(*parts)
    bare, state = F.col(method).isNull(), F.col(status)

    def only(which: Column) -> Column:
        return F.when(F.sum(which.cast("int")).over(by) == 1, F.max(F.when(which, F.col(code))).over(by))

    latest = F.max(F.when(bare, F.struct(F.col(version), F.col(code)))).over(by)[code]
    no_bare = F.sum(bare.cast("int")).over(by) == 0
    deprecated = F.sum((state != "DEPRECATED").cast("int")).over(by) == 0
    key = F.coalesce(only(bare), F.when(no_bare, only(state == "ACTIVE")), F.when(~no_bare, F.coalesce(only(bare & (state == "ACTIVE")), only(bare & (state == "DISCOURAGED")), F.when(deprecated, latest))))
    return rows.withColumns({"key": key, "_n": F.count("*").over(by)}).where("_n > 1 and key is not null").select(code, "key")


def expansions(df: DataFrame, short: str, long: str) -> DataFrame:
    """(token, expansion, n): each short token against the runs of one to three long tokens that start at its place, or two
    places before it if the long text has fewer tokens."""
    words = df.select(F.col(long).alias("l"), F.size(short).alias("ns"), F.size(long).alias("nl"), F.posexplode(short).alias("i", "token"))
    start = F.when(F.col("nl") >= F.col("ns"), F.col("i")).otherwise(F.col("i") - 2)
    runs = words.withColumn("s", start).where("s >= 0").select("token", "l", "s", "nl", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).where("s + k <= nl")
    return runs.groupBy("token", F.array_join(F.slice("l", F.col("s") + 1, F.col("k")), " ").alias("expansion")).agg(F.count("*").alias("n"))


def acronym(token: Column, expansion: Column) -> Column:
    """The first words of the expansion whose initials spell the token (two letters or more), else null."""
    words = F.split(expansion, " ")
    n = F.length(token)
    fits = (n > 1) & (F.size(words) >= n) & F.coalesce(F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.get(words, i - 1), F.lit(1), F.lit(1)) == F.substring(token, i, F.lit(1))), F.lit(False))
    return F.when(fits, F.array_join(F.slice(words, F.lit(1), n), " "))


def acronym_lookup(rows: DataFrame, token: str, acronyms: DataFrame) -> DataFrame:
    """rows with expansions, all distinct ones that acronyms(acronym, expansion) has for the token, ignoring case, sorted; none: empty."""
    known = acronyms.where("acronym is not null and expansion is not null").select(F.upper("acronym").alias("_a"), F.upper("expansion").alias("_e"))
    known = known.groupBy("_a").agg(F.array_sort(F.collect_set("_e")).alias("expansions"))
    out = rows.join(known, F.upper(F.col(token)) == F.col("_a"), "left").drop("_a")
    return out.withColumn("expansions", F.coalesce("expansions", F.array().cast("array<string>")))


def final_map(system: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, expansion) of system(token, expansion) and tokens(token, expansion, n): an acronym first, then the token itself
    if it is one of its expansions, then the system's, then the shortest of the most frequent."""
    top = tokens.withColumn("_m", F.max("n").over(W.partitionBy("token"))).where("n = _m").withColumn("_a", acronym(F.col("token"), F.col("expansion")))
    best = top.groupBy("token").agg(F.min("_a").alias("a"), F.bool_or(F.col("token") == F.col("expansion")).alias("same"), F.min(F.struct(F.length("expansion").alias("n"), "expansion")).alias("short"))
    both = best.join(system.withColumnRenamed("expansion", "sys"), "token", "full")
    return both.select("token", F.coalesce("a", F.when(F.col("same"), F.col("token")), "sys", "short.expansion").alias("expansion"))


def code_documents(df: DataFrame, code: str, columns: list[str]) -> DataFrame:
    """One document per code: its distinct upper-cased values, sorted within each column."""
    parts = [F.array_join(F.array_sort(F.collect_set(F.nullif(F.upper(F.trim(c)), F.lit("")))), " ") for c in columns]
    return df.groupBy(code).agg(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]).alias("document"))


def nearest_in_row(df: DataFrame, short: str, long: str, distance: Callable[[Column, Column], Column] = F.levenshtein) -> DataFrame:
    """(token, expansion, n): every short token goes to the nearest long token of its own row, the first of equals; the most
    frequent of those is its expansion, the first by name of equals. Rows that repeat are compared once."""
    rows = df.select(F.explode(F.array_distinct(short)).alias("token"), F.col(long).alias("l")).where("size(l) > 0").groupBy("token", "l").agg(F.count("*").alias("n"))
    near = F.array_min(F.transform("l", lambda t, i: F.struct(distance(F.col("token"), t).alias("d"), i.alias("i"), t.alias("t"))))
    counts = rows.withColumn("expansion", near["t"]).groupBy("token", "expansion").agg(F.sum("n").alias("n"))
    return counts.groupBy("token").agg(F.min(F.struct((-F.col("n")).alias("m"), "expansion")).alias("b")).select("token", F.col("b.expansion").alias("expansion"), (-F.col("b.m")).alias("n"))


def compare_parts(df: DataFrame, dictionary: DataFrame, code: str, text: str, parts: list[str]) -> DataFrame:
    """Adds, for each part of the code's dictionary entry, n_<part>: how many of its words the text has."""
    entry = dictionary.select(code, *[F.col(p).alias(f"_p_{p}") for p in parts])
    words = lambda c: F.filter(F.array_distinct(F.split(F.upper(F.coalesce(c, F.lit(""))), r"\s+")), lambda t: t != "")
    out = df.join(entry, code, "left")
    return out.withColumns({f"n_{p}": F.size(F.array_intersect(words(F.col(text)), words(F.col(f"_p_{p}")))) for p in parts}).drop(*[f"_p_{p}" for p in parts])
