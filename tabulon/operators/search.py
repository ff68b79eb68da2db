"""Search for the codes of records: a fitted model of term weights, an inverted index with bounds, exact best matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from . import tfidf
from .steps import drop, written

EPS = 1e-9


def fit_terms(counts: DataFrame, key: str, smooth: bool = True, vocabulary: int | None = None) -> DataFrame:
    """The model of a corpus given by counts(key, term, tf): (term, df, idf), idf as in tfidf(); with vocabulary only its most
    frequent terms. It weighs any other texts by weigh()."""
    if vocabulary:
        counts = tfidf.limit_vocabulary(counts, vocabulary)
    n = F.lit(counts.agg(F.count_distinct(key)).first()[0])
    df = counts.groupBy("term").agg(F.count_distinct(key).alias("df"))
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1 if smooth else 1 + F.log(n / F.col("df"))
    return df.select("term", "df", idf.alias("idf"))


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def weigh(counts: DataFrame, model: DataFrame, key: str, sublinear: bool = False, norm: bool = True) -> DataFrame:
    """(key, term, weight) of texts given by counts(key, term, tf), by a model fitted on others: terms that it does not know
    count for nothing; norm: rows of length 1."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    rows = counts.join(model, "term").select(key, "term", (tf * F.col("idf")).alias("weight"))
    if not norm:
        return rows
    size = F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy(key)))  # over the distinct terms of one text
    return rows.select(key, "term", (F.col("weight") / size).alias("weight"))


def build_index(weights: DataFrame, code: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, bounds) of the codes' weights(code, term, weight): rows (term, code, weight), and (term, most, codes) with the
    term's largest weight and its number of codes. With a path they are saved there first."""
    postings = weights.select("term", F.col(code).alias("code"), "weight")
    bounds = postings.groupBy("term").agg(F.max("weight").alias("most"), F.count("*").alias("codes"))
    if path:
        postings.write.mode("overwrite").parquet(f"{path}/postings")
        bounds.write.mode("overwrite").parquet(f"{path}/bounds")
        return load_index(postings.sparkSession, path)
    return postings, bounds


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/bounds")


def _kth(scores: DataFrame, key: str, k: int) -> DataFrame:
    """(key, least): the k-th best score of every key that has as many."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("s")))
    return scores.withColumn("_r", place).where(F.col("_r") <= k).groupBy(key).agg(F.min("s").alias("least"), F.count("*").alias("_n")).where(F.col("_n") == k).select(key, "least")


def _sums(terms: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    return terms.join(postings, "term").groupBy(key, "code").agg(F.sum(F.col("w") * F.col("weight")).alias("s"))


def best_codes(queries: DataFrame, key: str, index: tuple[DataFrame, DataFrame], k: int, first: int = 2) -> DataFrame:
    """(key, code, score, rank): the k codes of the highest dot product with each query(key, term, weight), weights not negative;
    codes that share no term are not found. Scores that agree to nine digits are ties and go by code.

    Exact, without comparing all with all. A term adds its weight times the largest weight that any code gives it at most. The
    first terms by that bound give sums that the k-th best score cannot be under; terms whose bounds together cannot reach it are not
    looked up (the frequent ones: they weigh least); codes that cannot reach it with what is left are not finished."""
    postings, bounds = index
    order = W.partitionBy(key).orderBy(F.desc("ub"), "term")
    terms = queries.join(bounds, "term").select(key, "term", F.col("weight").alias("w"), (F.col("weight") * F.col("most")).alias("ub")).where("ub > 0")
    tail = F.sum("ub").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    terms = written(terms.withColumns({"i": F.row_number().over(order), "tail": tail}), "terms")
    floor = _kth(_sums(terms.where(F.col("i") <= first), postings, key), key, k)
    look = (F.col("i") <= first) | (F.col("tail") >= F.coalesce("least", F.lit(0.0)) - EPS)
    told = written(terms.join(floor, key, "left").select(key, "term", "w", "ub", look.alias("look")), "looked")
    drop(terms)
    partial = written(_sums(told.where("look"), postings, key), "partial")
    floor = _kth(partial, key, k)
    rest = told.where("not look").groupBy(key).agg(F.sum("ub").alias("rest"))
    alive = partial.join(floor, key, "left").join(rest, key, "left").where(F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0)) - EPS).select(key, "code", "s", F.col("rest").isNotNull().alias("open"))
    more = alive.where("open").select(key, "code").join(told.where("not look").select(key, "term", "w"), key).join(postings, ["term", "code"])
    more = more.groupBy(key, "code").agg(F.sum(F.col("w") * F.col("weight")).alias("m"))
    scored = alive.join(more, [key, "code"], "left").select(key, "code", F.round(F.col("s") + F.coalesce("m", F.lit(0.0)), 9).alias("score"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "code"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def _small_index(model: DataFrame, index: tuple[DataFrame, DataFrame], cells: int) -> tuple | None:
    """(terms, idf, codes in their order, weights as terms x codes) if terms times codes are at most cells, else None. Weights that are not
    positive go the general way."""
    postings, _ = index
    terms, codes = model.count(), postings.select("code").distinct()
    n, least = postings.agg(F.count("*"), F.min("weight")).first()
    if not n or least is None or least <= 0 or terms * codes.count() > cells or n > cells:
        return None
    known = model.select("term", "idf").toPandas()  # bounded by cells, as are the rows below
    order = codes.orderBy("code").toPandas()["code"].tolist()
    place, column = {t: i for i, t in enumerate(known["term"])}, {c: i for i, c in enumerate(order)}
    weights = np.zeros((len(place), len(order)))
    for r in postings.select("term", "code", "weight").toLocalIterator():
        if r.term in place:
            weights[place[r.term], column[r.code]] += r.weight
    return known["term"].tolist(), known["idf"].to_numpy(), order, weights


def _find_in_small(own: DataFrame, key: str, tokens, small: tuple, code: DataType, k: int) -> DataFrame:
    """find_codes() where every task holds the index: texts are scored where they are, nothing is shuffled."""
    spark = own.sparkSession
    shipped = spark.sparkContext.broadcast(small)

    def run(batches):
        terms, idf, order, weights = shipped.value
        known, most = pa.array(terms, pa.string()), min(k, len(order))
        for batch in batches:
            lists = batch.column(1)
            place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            cell, tf = np.unique((row * len(terms) + place)[place >= 0], return_counts=True)
            row, place = np.divmod(cell, len(terms))
            w = tf * idf[place]
            size = np.sqrt(np.bincount(row, w * w, len(lists)))
            w = w / np.where(size > 0, size, 1)[row]
            at, i, score = [], [], []
            for start in range(0, len(lists), 256):
                few = slice(*np.searchsorted(row, [start, start + 256]))
                dense = np.zeros((min(256, len(lists) - start), len(terms)))
                dense[row[few] - start, place[few]] = w[few]
                s = dense @ weights
                limit = np.partition(s, len(order) - most, axis=1)[:, len(order) - most]
                x, y = np.nonzero((s >= limit[:, None] - 2e-9) & (s > 0))
                at.append(x + start), i.append(y), score.append(s[x, y])
            ends = np.searchsorted(np.concatenate(at), np.arange(len(lists) + 1)) if at else np.zeros(1)
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in ((i, pa.int32()), (score, pa.float64()))], ["i", "s"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], [key, "_f"])

    kind = own.schema[key].dataType.simpleString()
    found = own.select(key, tokens(F.col("_text")).alias("_t")).mapInArrow(run, f"`{key}` {kind}, _f array<struct<i:int,s:double>>")
    best = F.array_sort(F.transform("_f", lambda x: F.struct((-F.round(x["s"], 9)).alias("s"), x["i"].alias("i"))))
    rows = found.select(key, F.posexplode(F.slice(best, 1, k)).alias("_p", "_b")).select(key, (-F.col("_b.s") + 0.0).alias("score"), (F.col("_p") + 1).alias("rank"), F.col("_b.i").alias("_i"))
    names = spark.createDataFrame(list(enumerate(small[2])), StructType([StructField("_i", IntegerType()), StructField("code", code)]))
    return rows.join(F.broadcast(names), "_i").select(key, "code", "score", "rank")


def find_codes(rows: DataFrame, key: str, text: str, tokens, model: DataFrame, index: tuple[DataFrame, DataFrame], k: int = 3, cells: int = 4_000_000) -> DataFrame:
    """(key, code, score, rank) for rows of any table: the k codes whose documents are nearest to the row's text by cosine.
    tokens makes an array of words of the text column; rows of one text are searched once. Rows whose text has no term of the
    model, null texts among them, find nothing. An index of up to cells terms times codes is given to every task."""
    own = rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    small = _small_index(model, index, cells)
    if small:
        return _find_in_small(own, key, tokens, small, index[0].schema["code"].dataType, k)
    own = own.withColumn("_id", F.unhex(F.md5("_text")))
    texts = own.select("_id", "_text").dropDuplicates(["_id"]).select("_id", F.explode(tokens(F.col("_text"))).alias("term"))
    known = model.select("term")
    if known.count() <= 200_000:  # else terms that the model does not know go later
        texts = texts.join(F.broadcast(known), "term", "left_semi")
    counts = texts.groupBy("_id", "term").agg(F.count("*").alias("tf"))
    found = best_codes(weigh(counts, model, "_id"), "_id", index, k)
    return own.select(key, "_id").join(found, "_id").select(key, "code", "score", "rank")


def hit_rates(found: DataFrame, rows: DataFrame, key: str, code: str, k: int) -> DataFrame:
    """(k, n, hits, share): how many rows have their own code among the first 1, 2, ... k codes that were found for them; rows
    that found nothing count as misses."""
    own = rows.where(F.col(code).isNotNull()).select(key, F.col(code).alias("_own"))
    at = own.join(found.where(F.col("rank") <= k), (found[key] == own[key]) & (F.col("code") == F.col("_own")), "left").select("rank")
    sums = at.agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= i).alias(f"h{i}") for i in range(1, k + 1)])
    wide = sums.select("n", F.posexplode(F.array(*[f"h{i}" for i in range(1, k + 1)])).alias("i", "hits"))
    return wide.select((F.col("i") + 1).cast("long").alias("k"), "n", "hits", (F.col("hits") / F.col("n")).alias("share"))
