"""Candidate pairs of records and codes with similarity features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_term, standardize
from . import tfidf
from .nearest import token_similarity
from .roles import pair_names
from .running import ranked_by
from .sampling import negatives, per_class
from .steps import written


def candidate_pairs(rows: DataFrame, dictionary: DataFrame, key: str, code: str, per_code: int = 3, k: int = 10, seed: int = 0) -> DataFrame:
    """(key, code, candidate, label): up to per_code rows of every code with their own code (1) and k other codes (0)."""
    chosen = per_class(rows, code, key, per_code, seed)
    own = chosen.select(key, code, F.col(code).alias("candidate"), F.lit(1).alias("label"))
    other = chosen.select(key, code).join(negatives(dictionary, code, k, seed).withColumnRenamed("negative", "candidate"), code).select(key, code, "candidate", F.lit(0).alias("label"))
    return own.unionByName(other)


def pair_features(pairs: DataFrame, rows: DataFrame, dictionary: DataFrame, key: str, code: str, texts: list[str], parts: list[str], kernel: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds to pairs(key, code, candidate, label), for every text column of rows and every part of the candidate's dictionary
    entry, <text>_<part>_sdist (mean of the best token similarities) and <text>_<part>_tfidf (cosine of term weights, learned
    on the dictionary's and the rows' distinct texts). Distinct texts are compared once, and those of no pair get no weights.

    Rows without a pair are left out first, and rows and entries meet pairs by a merge join: a small file may hold a large table, which
    a plan that goes by the size of files would send through the driver."""
    clean = lambda c: clean_term(standardize(F.col(c)))
    pairs = written(pairs, "pairs")
    entry = dictionary.groupBy(code).agg(*[F.max(p).alias(p) for p in parts])
    paired = rows.join(pairs.select(key).distinct(), key, "left_semi").select(key, *[clean(c).alias(f"_x_{c}") for c in texts])
    cleaned = entry.select(F.col(code).alias("candidate"), *[clean(p).alias(f"_y_{p}") for p in parts])
    out = written(pairs.join(paired.hint("merge"), key).join(cleaned.hint("merge"), "candidate"), "paired")
    every = None
    for frame, names in ((rows, texts), (entry, parts)):
        for n in names:
            one = frame.select(F.col(n).alias("text"))
            every = one if every is None else every.unionByName(one)
    words = written(every.distinct().select(clean("text").alias("text")).where("text <> ''").distinct(), "words")
    met = out.select(F.explode(F.array(*[f"_x_{c}" for c in texts], *[f"_y_{p}" for p in parts])).alias("text"))
    weights = written(tfidf.tfidf(words.withColumn("t", F.split("text", " ")), "text", "t", of=met), "weights")
    for a, b, name in pair_names(texts, parts):
        both = out.select(f"_x_{a}", f"_y_{b}").distinct().toDF("a", "b")
        both = token_similarity(both, "a", "b", kernel).withColumnRenamed("similarity", f"{name}_sdist")
        both = tfidf.similar(both, weights, "a", "b", "text").withColumnRenamed("cosine", f"{name}_tfidf")
        out = out.join(both.withColumnsRenamed({"a": f"_x_{a}", "b": f"_y_{b}"}), [f"_x_{a}", f"_y_{b}"], "left").fillna(0.0, [f"{name}_sdist", f"{name}_tfidf"])
    return out.drop(*[f"_x_{c}" for c in texts], *[f"_y_{p}" for p in parts])


def pair_table(pairs: DataFrame, rows: DataFrame, dictionary: DataFrame, key: str, code: str, texts: list[str], parts: list[str], kernel: Callable[[Column, Column], Column] | None = None, kinds: tuple[str, ...] = ("sdist", "tfidf"), test: bool = False) -> DataFrame:
    """The training table of pairs: assignment (the candidate) and label, features of the kinds asked for as in pair_features(), the row's own
    texts t_<text> and the candidate's descriptors d_<part>, cleaned, '' where there are none. test: every label is -1, as the
    right answer is not known."""
    clean = lambda c: clean_term(standardize(F.col(c)))
    out = pairs
    if kinds:
        out = pair_features(pairs, rows, dictionary, key, code, texts, parts, kernel or F.levenshtein)
        names = [n for _, _, n in pair_names(texts, parts)]
        out = out.drop(*[f"{n}_{kind}" for n in names for kind in ("sdist", "tfidf") if kind not in kinds])
    out = written(out, "pairs")  # rows and entries meet it as in pair_features()
    own = rows.join(out.select(key).distinct(), key, "left_semi").select(key, *[clean(c).alias(f"t_{c}") for c in texts])
    entry = dictionary.groupBy(code).agg(*[F.max(p).alias(p) for p in parts]).select(F.col(code).alias("candidate"), *[clean(p).alias(f"d_{p}") for p in parts])
    out = out.join(own.hint("merge"), key, "left").join(entry.hint("merge"), "candidate", "left").fillna("", [f"t_{c}" for c in texts] + [f"d_{p}" for p in parts])
    return out.withColumnRenamed("candidate", "assignment").withColumn("label", F.lit(-1) if test else F.col("label"))


def ranked_predictions(scored: DataFrame, code: str, key: list[str], label: str, score: str, low: float = 0.85, top: int | None = None) -> DataFrame:
    """scored with place, its rank in the order of label and falling score inside its code (ties by key), and doubtful, whether the score is
    below low; top: the first so many places of every code. Places count over parts of the scores, so that no task sorts all rows of
    a code."""
    # labels are whole numbers and scores lie in [0, 1], so that one number gives the order of both
    placed = ranked_by(scored.withColumn("_o", F.col(label) * 2.0 - F.col(score)), [code], "_o", key)
    out = placed.withColumnRenamed("_rank", "place").withColumn("doubtful", F.col(score) < low).drop("_o", "_all")
    return out.where(F.col("place") <= top) if top else out


def train_and_test(rows: DataFrame, scores: DataFrame, dictionary: DataFrame, key: str, code: str, high: float = 0.9, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) pairs: codes that scores(code, score) finds easy give rows with their own code and others; the rest give
    rows with their own code alone."""
    easy = scores.where(F.col("score") >= high).select(code)
    train = candidate_pairs(rows.join(easy, code, "left_semi"), dictionary, key, code, seed=seed)
    test = candidate_pairs(rows.join(easy, code, "left_anti"), dictionary, key, code, k=1, seed=seed).where("label = 1")
    return train, test
