"""Corpus pipeline: quality, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last return the
columns of documents. Near-duplicates and leaks are dropped by row (id and text), so that rows that share an id stand for
themselves. Rows with a null id pass the near-duplicate stage unchanged."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import line_runs, nbsvm, packing, partenum, templates
from tabulon.llm.common import discard, materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_row(docs: DataFrame, *columns: str, bits: int = 64) -> DataFrame:
    """docs with _row, a hash of columns of so many bits; where rows that differ share it, a second hash takes its place, so that
    what is dropped by _row is never another row."""
    first = F.xxhash64(*columns) if bits == 64 else F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    second = F.xxhash64(F.lit("again"), *columns)
    met = docs.select(first.alias("_row"), second.alias("_again")).groupBy("_row").agg(F.min("_again").alias("_a"), F.max("_again").alias("_b"))
    shared = materialize(met.where("_a <> _b").select("_row"), "shared")
    docs = docs.withColumn("_row", first)
    if shared.isEmpty():
        return docs
    told = docs.join(shared.withColumn("_shared", F.lit(True)), "_row", "left")
    return told.withColumn("_row", F.when(F.col("_shared"), second).otherwise(F.col("_row"))).drop("_shared")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. Null and empty texts are judged like others, by what they lack; whole texts,
    however long; repeated rows and rows without id each on their own."""
    return nbsvm.quality(docs, read_table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of a smaller id holds too; n_chars follows the text."""
    out = line_runs.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of the smallest id in each group, and one of rows that repeat both id and text. Null and empty texts are in no
    group; whole texts are compared."""
    docs = with_row(docs, "doc_id", "text")
    groups = partenum.near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text"))
    groups = groups.groupBy(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).agg(F.count("*").alias("_n"))
    own = docs.where("doc_id is not null").select("_row", "doc_id").distinct()
    own = materialize(own.join(groups, "_row"), "own")
    least = own.groupBy("_group").agg(F.min(F.struct("doc_id", "_row")).alias("_least"), F.count("*").alias("_size")).where("_size > 1")
    gone = materialize(own.join(least, "_group").where("_row <> _least._row").select("_row"), "gone")
    again = materialize(own.where("_n > 1").select("_row"), "again")
    kept = docs.join(gone, "_row", "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    one = kept.join(again, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return kept.join(again, "_row", "left_anti").select(*COLUMNS).union(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds benchmark items, those without id too. Null and empty texts hold none; long ones are read whole."""
    docs = with_row(docs, "text")  # a leak is a matter of the text alone
    leaks = templates.find_leaks(docs.select(F.col("_row").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    gone = materialize(leaks.select(F.col("doc_id").alias("_row")).distinct(), "gone")
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences, see packing.pack: null and empty texts are one id, long ones several pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates), ("benchmark decontamination", drop_leaks), ("packing", pack)]
#: No stage but line dedup can be put in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
