"""I-Match fingerprints: terms inside a band of document frequency, sorted and hashed over randomised subsets of the lexicon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, read_table

#: Subset j of the lexicon takes one term in 2 ** RATES[j]; the first takes all of them.
RATES = [0] + [2] * 4 + [3] * 6 + [4] * 8 + [5] * 10 + [6] * 12 + [7] * 8


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = 0.003, high: float = 0.01) -> DataFrame:
    """(t, subsets) of the terms (hashes) that a share from low to high of all documents hold, at least two documents; subsets
    has a bit for each subset that the term is in.

    No more than (mean distinct terms of a document) / low terms can reach the share low, so that the table has a size that
    does not depend on the number of documents; whether it is broadcast is left to its size."""
    hashed = docs.select(terms(F.col("text")).alias("t"))
    counts = hashed.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    n = docs.count()
    least = max(2, math.ceil(low * n))
    upper = max(least, math.floor(high * n))
    bits = F.lit(0).cast("long")
    for j, rate in enumerate(RATES):
        bits = bits.bitwiseOR(F.when(F.pmod(F.xxhash64("t", F.lit(j)), F.lit(1 << rate)) == 0, F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
    return materialize(counts.where(F.col("df").between(least, upper)).select("t", bits.alias("subsets")), "lexicon")


def codes(found: Column) -> Column:
    """16-bit hashes, one for each subset: of the sorted terms (t, subsets) of a text that are in it; 0 if there are none."""
    one = lambda a, j: F.transform(F.filter(a, lambda t: F.getbit(t["subsets"], F.lit(j)) == 1), lambda t: t["t"])
    code = lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(s), F.lit(65535)).cast("int") + 1)
    return F.transform(F.array(F.array_sort(found)), lambda a: F.array(*[code(one(a, j)) for j in range(len(RATES))]))[0]


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal subset hashes among the subsets that either text has terms in; 1 for two texts without terms."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda v: v))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda v: v))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def buckets(docs: DataFrame, rows_a_bucket: int, most_cuts: int = 1000) -> Column:
    """A number that rises with (doc_id, c1) and that about rows_a_bucket rows share, null ids first.

    The ids are cut at quantiles, as many as most_cuts; between two cuts they are spread evenly, and rows whose id is a cut
    (of which a common id has several) by their hash c1, into so many parts that buckets do not grow with the table."""
    n = docs.count()
    wanted = max(1, n // rows_a_bucket)
    cuts = min(wanted, most_cuts)
    parts = -(-wanted // cuts)
    at = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)])).first()[0] or [0]
    edges = F.array(*[F.lit(int(c)).cast("long") for c in at])
    below, up_to = F.size(F.filter(edges, lambda c: c < F.col("doc_id"))), F.size(F.filter(edges, lambda c: c <= F.col("doc_id")))
    share = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1 - 1e-9))
    by_hash = share(F.col("c1") / float(1 << 64) + 0.5)
    edge = lambda i: F.get(edges, i).cast("double")
    between = share(F.coalesce((F.col("doc_id").cast("double") - edge(below - 1)) / (edge(below) - edge(below - 1)), F.lit(0.5)))
    place = F.when(F.col("doc_id").isNull(), (by_hash - 1) * len(at)).when(up_to > below, 2 * below + 1 + by_hash * (2 * (up_to - below) - 1)).otherwise(2 * below + between)
    return F.floor(place * parts).cast("long")


def with_next(docs: DataFrame, rows_a_bucket: int = 4000) -> DataFrame:
    """Of docs(doc_id, text, c1, c2): bucket, place (of the row in it), copy, doc_id, text and next_text, that of the next row by
    doc_id and then by the hashes of the text (after the last: the first), without one global sort: every bucket has a copy of
    the row that follows it."""
    placed = docs.withColumn("bucket", buckets(docs, rows_a_bucket))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "c1", "c2"))
    heads = materialize(placed.groupBy("bucket").agg(first.alias("head")), "heads")  # one row per bucket
    before = F.lag("bucket").over(W.orderBy("bucket"))
    last = F.max("bucket").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = materialize(heads.select("bucket", "head", F.coalesce(before, last).alias("ghost")), "heads")
    placed = placed.join(heads, "bucket")
    own = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "c1", "c2")
    # the own row, and for the first of a bucket one more row in the bucket before it
    rows = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("copy")), F.when(F.col("head") == own, F.struct(F.col("ghost").alias("b"), F.lit(True).alias("copy"))))
    placed = placed.withColumn("at", F.explode(F.filter(rows, lambda r: r.isNotNull()))).select("doc_id", "text", "c1", "c2", F.col("at.b").alias("bucket"), F.col("at.copy").alias("copy"))
    window = W.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "c1", "c2")
    return placed.select("bucket", F.row_number().over(window).alias("place"), "copy", "doc_id", "text", F.lead("text").over(window).alias("next_text"))


def edited(text: Column, after: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the text after it."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame, low: float = 0.003, high: float = 0.01, rows_a_bucket: int = 4000) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Fingerprints are made of the terms in the band alone, whatever the length of the text: a subset without terms has code 0,
    and so have all subsets of a text without terms in the band. Null text counts as empty; null ids come first in the order,
    and rows of one id are ordered by the hashes of their texts. Other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(7), text).alias("c2"))
    known = lexicon(docs, low, high)
    rows = with_next(docs, rows_a_bucket).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    fact = F.struct("doc_id", "copy", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.when(F.lit(False), fact)
    part = lambda side, found, facts: F.struct(F.lit(side).alias("side"), found.alias("ts"), facts.alias("fact"))
    parts = F.array(part(0, terms(F.col("text")), none), part(1, terms(F.col("edited")), none), part(2, F.array(F.lit(None).cast("long")), fact))
    told = rows.select("bucket", "place", F.inline(parts)).select("bucket", "place", "side", "fact", F.explode("ts").alias("t"))
    told = told.join(known, "t", "left").where("subsets is not null or side = 2")
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("t", "subsets")))
    told = told.groupBy("bucket", "place").agg(codes(of(0)).alias("f"), codes(of(1)).alias("g"), F.first("fact", ignorenulls=True).alias("fact"))
    told = told.withColumn("h", F.lead("f").over(W.partitionBy("bucket").orderBy("place"))).where(~F.col("fact.copy"))
    return told.select("fact.doc_id", "fact.n_chars", "fact.edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("g")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("h")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
