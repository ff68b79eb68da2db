"""Text corpora as relations (key, document), and term weights of word n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, clean_term, conjoin, standardize
from . import tfidf
from .dictionary import code_documents
from .steps import written


def words(c: Column) -> Column:
    """Words of two letters, digits or underscores or more, as they are."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def word_ngrams(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of low to high tokens, joined by a blank."""
    def runs(t: Column, n: int) -> Column:
        if n == 1:
            return F.transform(t, lambda w: F.coalesce(w, F.lit("")))
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    # tokens are bound once, however often they are read
    return F.flatten(F.transform(F.array(tokens), lambda t: F.concat(*[runs(t, n) for n in range(low, high + 1)])))


def ngram_weights(docs: DataFrame, key: str, text: str, low: int = 1, high: int = 3, stop: list[str] = STOP_WORDS, vocabulary: int = 50_000, tokenizer: Callable[[Column], Column] = words, **weights) -> DataFrame:
    """(key, term, weight): stop words go before n-grams are made, the vocabulary most frequent terms of the corpus stay, and
    weights are those of tfidf(). tokenizer makes an array of words of the text column."""
    tokens = F.filter(tokenizer(F.col(text)), lambda w: ~w.isin(*stop)) if stop else tokenizer(F.col(text))
    rows = docs.select(key, tokens.alias("_w"))
    top = written(frequent_ngrams(rows, "_w", low, high, vocabulary), "vocabulary")
    grams = rows.select(key, F.explode(word_ngrams(F.col("_w"), low, high)).alias("term"))
    counts = grams.join(F.broadcast(top) if vocabulary <= 100_000 else top, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))
    counts = written(counts, "counts")  # read for document frequencies and for weights
    return tfidf.tfidf(docs.select(key), key, "", counts=counts, **weights)


def frequent_ngrams(rows: DataFrame, tokens: str, low: int, high: int, n: int, few: int = 200_000) -> DataFrame:
    """(term): the n most frequent runs of low to high tokens over all rows; ties go by term.

    Exact, without counting all runs: a run is no more frequent than the runs in it, so that beyond low tokens only those count whose
    first and last tokens but one make runs that reach the n-th largest count so far. Up to few of these are broadcast; beyond, and
    where tokens hold blanks, so that runs of several lengths are one term, all runs are counted."""
    count = lambda terms: terms.groupBy("term").agg(F.count("*").alias("n"))
    runs = lambda low, high: rows.select(F.explode(word_ngrams(F.col(tokens), low, high)).alias("term"))
    last = written(count(runs(low, low)), "counts")
    found = last
    blanks = last.where(F.col("term").contains(" ")) if low == 1 else rows.where(F.exists(tokens, lambda w: w.contains(" ")))
    if low < high and not blanks.isEmpty():
        found, high = count(runs(low, high)), low
    for size in range(low + 1, high + 1):
        top = found.select("n").orderBy(F.desc("n")).limit(n).agg(F.min("n"), F.count("*")).first()
        least = top[0] if top[1] == n else 1
        often = last.where(F.col("n") >= least)
        if least > 1 and often.count() <= few:
            parts = word_ngrams(F.col(tokens), size - 1, size - 1)
            both = rows.select(F.col(tokens).alias("_t"), parts.alias("_p")).withColumn("_m", F.greatest(F.size("_p") - 1, F.lit(0)))
            zipped = F.arrays_zip(F.slice("_p", F.lit(1), F.col("_m")).alias("a"), F.slice("_p", F.lit(2), F.col("_m")).alias("b"), F.slice("_t", F.lit(size), F.col("_m")).alias("c"))
            pairs = both.select(F.explode(zipped).alias("_z")).select("_z.a", "_z.b", "_z.c")
            for side in "ab":
                pairs = pairs.join(F.broadcast(often.select(F.col("term").alias(side))), side, "left_semi")
            last = written(count(pairs.select(F.concat_ws(" ", "a", "c").alias("term"))).where(F.col("n") >= least), "counts")
        else:
            last = written(count(runs(size, size)), "counts")
        found = found.union(last)
    return found.orderBy(F.desc("n"), "term").limit(n).select("term")


def merged_descriptors(dictionary: DataFrame, tags: DataFrame, code: str, columns: list[str], tag: str) -> DataFrame:
    """(code, document): the values of columns of every code and its tag, joined; nulls and empties are skipped."""
    both = dictionary.join(tags.select(code, tag), code, "left")
    return both.select(code, conjoin(*[F.col(c) for c in columns], F.col(tag)).alias("document"))


def row_documents(df: DataFrame, key: str, columns: list[str], descriptors: DataFrame | None = None, code: str | None = None) -> DataFrame:
    """(key, document): the columns of every row joined and cleaned, with the document of the row's code behind it if
    descriptors(code, document) are given."""
    own = clean_term(standardize(conjoin(*[F.col(c) for c in columns])))
    if descriptors is None:
        return df.select(key, own.alias("document"))
    more = descriptors.select(code, F.col("document").alias("_d"))
    return df.select(key, code, own.alias("_o")).join(more, code, "left").select(key, conjoin(F.col("_o"), F.col("_d")).alias("document"))


def choose_corpus(given: DataFrame | None, df: DataFrame, key: str, columns: list[str] | None, code: str, merged: DataFrame | None) -> DataFrame:
    """(key, document): the corpus given; else documents of the rows' columns; else the merged dictionary; else one document per
    code of the rows' own values."""
    if given is not None:
        return given
    if columns:
        return row_documents(df, key, columns)
    if merged is not None:
        return merged.withColumnRenamed(code, key)
    return code_documents(df, code, [c for c in df.columns if c not in (key, code)]).withColumnRenamed(code, key)


def save_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").parquet(path)


def load_corpus(spark, path: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The saved corpus; if there is none, that of make(), which is saved first."""
    from ..sources.files import load_or_make

    return load_or_make(spark, path, make) if make else spark.read.parquet(path)
