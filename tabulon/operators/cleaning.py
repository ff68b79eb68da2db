"""Cleaning of record tables: cleaned terms and dropped tokens per site, frequent tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_term, clean_tokens, dedup_words, standardize
from .profile import share_of_group


def clean_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns standardized and cleaned in place."""
    return df.withColumns({c: clean_term(standardize(F.col(c))) for c in columns})


def cleaned_terms(df: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """(site, column, original, cleaned) of every distinct term; terms are made distinct before they are cleaned."""
    terms = df.select(site, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), standardize(F.col(c)).alias("original")) for c in columns])).alias("s"))
    return terms.select(site, "s.*").distinct().withColumn("cleaned", clean_term(F.col("original")))


def discarded_tokens(df: DataFrame, site: str, column: str) -> DataFrame:
    """(site, token) of pieces between blanks that cleaning does not leave as they are."""
    terms = df.select(site, standardize(F.col(column)).alias("t")).distinct()
    gone = F.array_except(F.split("t", " "), clean_tokens(F.col("t")))
    return terms.select(site, F.explode(gone).alias("token")).where("token <> ''").distinct()


def word_counts(df: DataFrame, site: str, column: str) -> DataFrame:
    """(site, term, n, percent of the site's words) of the cleaned column."""
    counts = df.select(site, F.explode(clean_tokens(standardize(F.col(column)))).alias("term")).groupBy(site, "term").agg(F.count("*").alias("n"))
    return share_of_group(counts, [site], "n", "percent").withColumn("percent", F.col("percent") * 100)


def without_frequent(df: DataFrame, site: str, key: str, column: str, most: float, spare: tuple[str, ...] = ("%", "#")) -> DataFrame:
    """(site, key, cleaned): the cleaned column without words whose share of their site's words is above most."""
    rows = df.select(site, key, standardize(F.col(column)).alias("_t"))
    words = rows.select(site, key, F.posexplode(clean_tokens(F.col("_t"))).alias("_i", "term"))
    often = word_counts(df, site, column).where((F.col("percent") > most * 100) & ~F.col("term").isin(*spare)).select(site, "term")
    left = words.join(often, [site, "term"], "left_anti").groupBy(site, key).agg(F.array_sort(F.collect_list(F.struct("_i", "term"))).alias("_w"))
    left = left.select(site, key, F.array_join(F.transform("_w", lambda x: x["term"]), " ").alias("cleaned"))
    return rows.select(site, key).join(left, [site, key], "left").fillna("", ["cleaned"])


def with_cleaned(df: DataFrame, cleaned: DataFrame, site: str, column: str, out: str) -> DataFrame:
    """df with the cleaned form of column from cleaned(site, column, original, cleaned), by site and text; null where there is none."""
    entry = cleaned.where(F.col("column") == column).select(F.col(site).alias("_s"), F.col("original").alias("_o"), F.col("cleaned").alias(out))
    return df.join(entry, (df[site] == F.col("_s")) & (standardize(df[column]) == F.col("_o")), "left").drop("_s", "_o")


def process_text(c: Column, clean: bool = True, standard: bool = True, dedup: bool = False) -> Column:
    """A text standardized, then cleaned or with its blanks made single, then with repeated words out, as the switches say."""
    text = standardize(c) if standard else F.coalesce(c, F.lit(""))
    text = clean_term(text) if clean else F.trim(F.regexp_replace(text, r"\s+", " "))
    return dedup_words(text) if dedup else text
