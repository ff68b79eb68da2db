"""Importance resampling towards a target: hashed n-gram counts as blocks of a sparse matrix, gains, weights, a weighted draw."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, materialize, read_table, small_batches, tidy

#: Runs of digits, lower-case ASCII letters and all characters from U+0080.
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
BLOCK_ENTRIES = 1 << 15
#: Bytes of a row group of the written blocks, so that a scan holds some dozens of them and not up to 4096.
ROW_GROUP = 1 << 20
BLOCK = "block long, ids array<{kind}>, words array<int>, indptr array<int>, indices array<smallint>, data array<int>"


def features(text: str, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of every run of one to three words, and the number of words. A run's CRC goes on from that of the run before."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORDS.findall(text.translate(LOWER))]
    spaced = [b" " + w for w in words[1:]]
    one = list(map(crc32, words))
    two = list(map(crc32, spaced, one))
    three = list(map(crc32, spaced[1:], two))
    return np.array(one + two + three, np.uint32) % np.uint32(buckets), len(words)


def count_blocks(rows: DataFrame, key: str, column: str = "text", buckets: int = 10000) -> DataFrame:
    """The matrix of rows by buckets, written as blocks of compressed sparse rows: a block has its number, the ids of its rows,
    their words, indptr, and the indices and data of their entries. A block ends at about BLOCK_ENTRIES entries or with a batch,
    and a row has at most as many entries as there are buckets, so that no block grows with the input."""
    if not 0 < buckets <= 1 << 15:
        raise ValueError("indices are 16 bits wide")
    kind = rows.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, room = TaskContext.get().partitionId() << 33, BLOCK_ENTRIES
        ids, words, parts = [], [], []

        def full() -> pa.RecordBatch:
            ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in parts])]).astype(np.int32)
            indices = np.concatenate([i for i, _ in parts]).astype(np.int16)
            data = np.concatenate([d for _, d in parts]).astype(np.int32)
            lists = [pa.concat_arrays(ids), pa.array(words, pa.int32()), pa.array(ptr), pa.array(indices), pa.array(data)]
            own = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *own], names=["block", "ids", "words", "indptr", "indices", "data"])

        for batch in small_batches(batches, "text"):
            for k, text in enumerate(batch.column("text").to_pylist()):
                found, n = features(text or "", buckets)
                parts.append(np.unique(found, return_counts=True))
                words.append(n)
                ids.append(batch.column("key").slice(k, 1))
                room -= len(parts[-1][0])
                if room <= 0 or len(ids) >= 1 << 14:
                    yield full()
                    block, room = block + 1, BLOCK_ENTRIES
                    ids, words, parts = [], [], []
        if ids:
            yield full()

    return rows.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(run, BLOCK.format(kind=kind))


def _list(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False)


def column_sums(blocks: DataFrame, buckets: int = 10000) -> np.ndarray:
    """The column sums of a matrix: each task adds up its blocks, so that at most one row per bucket and task is shuffled; the
    result has one number per bucket, whatever the input."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                np.add.at(total, _list(batch, "indices", k), _list(batch, "data", k).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("indices", "data").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, unit: float = 1000.0) -> np.ndarray:
    """By bucket: how much likelier the target makes it than the raw texts, as a logarithm in units, rounded down; one is added to
    every count."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(unit * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """One row per row of the matrix: block, at (its place there), id, n_words, n_features and weight, the product of the matrix
    with the gains."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, ptr, data = batch.column("ids")[k].values, _list(batch, "words", k), _list(batch, "indptr", k), _list(batch, "data", k).astype(np.int64)
                run_of = [np.concatenate([[0], np.cumsum(x)]) for x in (data, data * shared.value[_list(batch, "indices", k)])]
                n, w = (x[ptr[1:]] - x[ptr[:-1]] for x in run_of)
                at = np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column("block")[k].as_py(), np.int64)), pa.array(at, pa.int64()), ids, pa.array(words, pa.int64()), pa.array(n), pa.array(w)], names=["block", "at", "id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"block long, at long, id {kind}, n_words long, n_features long, weight long")


def with_rank(rows: DataFrame, share: float, least_words: int) -> DataFrame:
    """rows with rank: 1, 2, 3, ... of the floor(share * N) highest scores among the N rows of least_words words or more, ties to the
    smaller id (null ids last), then to the place in the matrix; null for others. Rows are dealt out by ranges of that order, so
    that equal keys spread over tasks; only the number of rows per range reaches one place."""
    able = F.col("n_words") >= least_words
    order = [able.cast("int").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("block"), F.col("at")]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = sorted((part, n) for part, n in dealt.groupBy("part").agg(F.count_if(able)).collect())  # one number per range
    k, before, starts = math.floor(share * sum(n for _, n in sizes)), 0, []
    for part, n in sizes:
        if before < k:
            starts.append((part, before))
        before += n
    if not starts:
        return dealt.withColumn("rank", F.lit(None).cast("long"))
    from pyspark.sql import Window

    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, before long"))
    reached = dealt.join(first, "part")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = reached.withColumn("rank", F.when(able & (place <= k), place)).drop("before")
    return drawn.unionByName(dealt.where(F.col("part") > starts[-1][0]).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: float = 0.05, least_words: int = 20, seed: int = 42, buckets: int = 10000, key: str = "doc_id", target_key: str = "item_id") -> DataFrame:
    """One row per document: its key, n_features, weight, score and rank (null if it is not drawn).

    Features are runs of one to three words of the whole text, in lower case. The score adds Gumbel noise, a hash of seed and key,
    to the weight, so that the highest scores are a draw without replacement by weight. Null and empty texts have no features
    and weight 0 and are not drawn; a null key is drawn as an empty one; rows that repeat a key count each on their own. Columns other
    than key and text are not read. An empty table gives no rows; an empty target counts as no features."""
    own = materialize(count_blocks(docs, key, buckets=buckets), "counts", ROW_GROUP)
    gain = gains(column_sums(own, buckets), column_sums(count_blocks(target, target_key, buckets=buckets), buckets))
    rows = weights(own, gain)
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))
    return with_rank(rows, share, least_words).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
