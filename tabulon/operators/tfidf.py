"""Term weights as relations: (doc, term, weight). Nothing is collected; the vocabulary is a table like any other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ngrams


def _codes(ids: np.ndarray, n: int, odd: np.ndarray, ordered: bool) -> np.ndarray:
    """A 64-bit code of every run of n ids; without order, runs of the same ids have one."""
    made = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        x = odd[ids[j : len(ids) - n + 1 + j]]
        made += x * np.uint64(2 * j + 1) ^ x >> np.uint64(29) if ordered else x
    return made


def _met_runs(docs: DataFrame, tokens: str, given: list[list], ordered: bool, some: int = 500_000) -> DataFrame:
    """(run, n): how often runs of docs occur in a part of a task's rows, of those whose code is near a given gram's: all that are given
    and few others. Tokens become numbers in the vocabulary of the given grams, so that runs are compared as whole columns."""
    words = pa.array([w for g in given for w in g], pa.string())
    words, sizes = pc.unique(words), sorted({len(g) for g in given})
    odd = np.random.default_rng(1).integers(0, 1 << 64, len(words) + 1, np.uint64) | np.uint64(1)
    known: dict = {n: [] for n in sizes}
    place = {w: i for i, w in enumerate(words.to_pylist())}
    for g in given:
        known[len(g)].append([place[w] for w in g])
    bits = max(16, 6 + len(given).bit_length())  # a bitmap per size: one in 64 other runs, or fewer, is not told apart
    maps = {}
    for n in sizes:
        maps[n] = np.zeros(1 << bits, bool)
        code = np.zeros(len(known[n]), np.uint64)
        for at, ids in enumerate(known[n]):
            code[at] = _codes(np.array(ids), n, odd, ordered)[0]
        maps[n][code >> np.uint64(64 - bits)] = True
    shipped = docs.sparkSession.sparkContext.broadcast((words, odd, {n: np.packbits(m) for n, m in maps.items()}))  # bounded by the given grams

    def count(lists: pa.ListArray, words: pa.Array, odd: np.ndarray, maps: dict) -> Iterator[pa.RecordBatch]:
        values, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        ids = pc.fill_null(pc.index_in(values, words.cast(values.type)), len(words)).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        for n, marks in maps.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(marks[_codes(ids, n, odd, ordered) >> np.uint64(64 - bits)])
            at = at[doc[at] == doc[at + n - 1]]
            own = ids[at[:, None] + np.arange(n)]
            at, own = at[(own < len(words)).all(1)], own[(own < len(words)).all(1)]
            if not len(at):
                continue
            order = np.lexsort(own.T)
            own, at = own[order], at[order]
            first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(1)))
            run = values.take(pa.array((at[first][:, None] + np.arange(n)).ravel()))
            run = pa.ListArray.from_arrays(pa.array(np.arange(0, len(run) + 1, n), pa.int32()), run)
            yield pa.RecordBatch.from_arrays([run, pa.array(np.diff(np.append(first, len(at))))], ["run", "n"])

    def work(batches):
        words, odd, packed = shipped.value
        maps = {n: np.unpackbits(m).astype(bool) for n, m in packed.items()}
        for batch in batches:
            lists = batch.column(0)
            ends, start = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), 0
            while start < len(lists):  # about some tokens at a time
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + some, "right")))
                yield from count(lists.slice(start, end - start), words, odd, maps)
                start = end

    return docs.select(tokens).mapInArrow(work, "run array<string>, n long")


def given_ngrams(docs: DataFrame, tokens: str, grams: DataFrame, gram: str, ordered: bool = True, few: int = 200_000) -> DataFrame:
    """(gram, n): how often each distinct gram of grams, an array of tokens, occurs as a run in the token arrays of docs; 0 where it
    does not. ordered=False: runs with the same tokens in any order count, and grams that differ in order only have one count
    each. Only runs as long as some gram are made. Up to few grams go to every task, where runs meet them as numbers and are
    counted; a join leaves out the runs that only seemed to be given. Beyond, all runs are counted before they meet the grams."""
    wanted = grams.select(F.col(gram).alias("gram")).where("size(gram) > 0").distinct()
    sizes = dict(wanted.groupBy(F.size("gram")).count().collect())  # a handful
    # runs are joined to strings; each token stands behind its length, so that no two runs give one string
    marked = lambda t: F.transform(t, lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    one = lambda t: F.array_join(t if ordered else F.sort_array(t), "")
    runs = lambda t, n: t if n == 1 else F.transform(ngrams(t, n), one)
    given = wanted.withColumn("_g", one(marked(F.col("gram"))))
    if 0 < sum(sizes.values()) <= few:
        listed = [list(r[0]) for r in wanted.collect()]  # few
        met = _met_runs(docs, tokens, listed, ordered).select(one(marked(F.col("run"))).alias("_g"), "n")
        met = met.join(F.broadcast(given.select("_g").distinct()), "_g", "left_semi")
    else:
        docs = docs.select(marked(F.col(tokens)).alias("_t"))
        made = F.flatten(F.array(*[runs(F.col("_t"), n) for n in sorted(sizes)])) if sizes else F.array().cast("array<string>")
        met = docs.select(F.explode(made).alias("_g"), F.lit(1).alias("n"))
    counts = met.groupBy("_g").agg(F.sum("n").alias("n"))
    return given.join(counts, "_g", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))


def term_counts(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, key: str, tokens: str, sublinear: bool = False, smooth: bool = True, norm: bool = True, counts: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """smooth: idf = ln((1 + N) / (1 + df)) + 1, else 1 + ln(N / df); sublinear: 1 + ln(tf); norm: rows of length 1.
    of: only the keys in its column key get weights; N and df are those of all documents.

    Counts meet their terms by an outer join, though every term has an idf: the many counts of a small file are so never broadcast;
    nor, with of, are the terms."""
    tf = term_counts(docs, key, tokens) if counts is None else counts
    n = docs.agg(F.count("*").alias("_n"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1 if smooth else 1 + F.log(F.col("_n") / F.col("df"))
    df = df.select("term", idf.alias("idf"))
    if of is not None:
        tf, df = tf.join(of.select(key).distinct(), key, "left_semi"), df.hint("merge")
    weighted = tf.where("term is not null").join(df, "term", "left").select(key, "term", ((1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf")).alias("weight"))
    if not norm:
        return weighted
    return weighted.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy(key))))


def top_terms(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The n heaviest terms; weights that agree to nine digits are ties and go by term."""
    return weights.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term"))).where(F.col("rank") <= n)


def mean_terms(weights: DataFrame, docs: DataFrame, key: str, group: str, n: int, least: float = 0.1) -> DataFrame:
    """Mean weight of each term over all documents of a group, weights under least as 0; the n heaviest."""
    sizes = docs.groupBy(group).agg(F.count("*").alias("_n"))
    sums = weights.join(docs.select(key, group), key).groupBy(group, "term").agg(F.sum(F.when(F.col("weight") >= least, F.col("weight")).otherwise(0.0)).alias("_s"))
    return top_terms(sums.join(sizes, group).select(group, "term", (F.col("_s") / F.col("_n")).alias("weight")), group, n)


def similar(pairs: DataFrame, weights: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Cosine of the documents of each pair, from their shared terms; 0 without any."""
    left = weights.select(F.col(key).alias(a), "term", F.col("weight").alias("_x"))
    right = weights.select(F.col(key).alias(b), "term", F.col("weight").alias("_y"))
    dots = pairs.join(left, a).join(right, [b, "term"]).groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))
    return pairs.join(dots, [a, b], "left").fillna(0.0, ["cosine"])


def term_frequencies(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, term, tf) with sublinear (1 + ln tf) and augmented (0.5 + 0.5 tf / the document's largest tf)."""
    most = F.max("tf").over(W.partitionBy(key))
    return counts.withColumns({"sublinear": 1 + F.log("tf"), "augmented": 0.5 + 0.5 * F.col("tf") / most})


def limit_vocabulary(counts: DataFrame, n: int) -> DataFrame:
    """The rows of the n terms that are most frequent over all documents; ties go by term. n bounds the broadcast side."""
    top = counts.groupBy("term").agg(F.sum("tf").alias("_all")).orderBy(F.desc("_all"), "term").limit(n)
    return counts.join(F.broadcast(top.select("term")) if n <= 100_000 else top.select("term"), "term", "left_semi")
