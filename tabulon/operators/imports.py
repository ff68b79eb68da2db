"""One import of a source of records: its rows cleaned in place, and tables that tell what cleaning did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_tokens, resolve_value, standardize
from .cleaning import clean_columns
from .running import join_null_safe
from .steps import drop, written

#: Delimited outputs of an import and their columns.
OUTPUTS = {"cleaned": "Site string, Original string, Cleaned string", "word_counts": "Site string, Term string, Count long, Percent double", "discarded": "Site string, DiscardedName string"}
_AS_TEXT = {"sep": "|", "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def import_source(df: DataFrame, site: str, texts: list[str], path: str, value: str | None = None, named: list[str] | None = None, sites: DataFrame | None = None, most: float | None = None, spare: tuple[str, ...] = ("%", "#")) -> None:
    """Writes under path: records (Parquet), all columns of df with texts cleaned; and for every text column, as files parted by |, cleaned
    (Site, Original, Cleaned), word_counts (Site, Term, Count, Percent) and discarded (Site, DiscardedName).

    named: texts that are the name of value, see resolve_value(); sites: a table of the sites whose rows are taken; most: words
    whose share of their site's words is above it, but not spare ones, leave the cleaned terms and are discarded. Words
    count once for each distinct term of a site. Terms are made distinct before they are cleaned and are written once; rows are
    cleaned by expressions, so that they are never shuffled. Null sites are the empty site, null texts are empty."""
    rows = df if sites is None else df.join(sites.select(site).distinct(), site, "left_semi")
    told = {}
    for c in texts:
        told[c] = standardize(F.col(c))
        if value is not None and c in (named or []):
            told[c] = resolve_value(told[c], standardize(F.col(value)))[0]
    rows = rows.withColumns(told)
    clean_columns(rows, texts).write.mode("overwrite").parquet(f"{path}/records")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("text"), F.coalesce(c, F.lit("")).alias("Original")) for c in texts]))
    terms = rows.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("Site"), each.alias("s")).select("Site", "s.*").distinct()
    terms = written(terms.withColumn("words", clean_tokens(F.col("Original"))), "terms")
    found = written(terms.select("text", "Site", F.explode("words").alias("Term")).groupBy("text", "Site", "Term").agg(F.count("*").alias("Count")), "words")
    whole = found.groupBy("text", "Site").agg(F.sum("Count").alias("_all"))
    counts = join_null_safe(found, whole, ["text", "Site"]).withColumn("Percent", 100.0 * F.col("Count") / F.col("_all")).drop("_all")
    often = counts.where((F.col("Percent") > (100.0 * most if most is not None else 100.0)) & ~F.col("Term").isin(*spare)).select("text", "Site", "Term")
    gone = often.groupBy("text", "Site").agg(F.collect_list("Term").alias("_gone"))  # 1 / most words at most
    words = F.filter("words", lambda w: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<string>")), w))
    cleaned = terms.join(gone, ["text", "Site"], "left").select("text", "Site", "Original", F.array_join(words, " ").alias("Cleaned"))
    for name, out in (("cleaned", cleaned), ("word_counts", counts), ("discarded", often.withColumnRenamed("Term", "DiscardedName"))):
        out.write.mode("overwrite").partitionBy("text").options(**_AS_TEXT).csv(f"{path}/{name}")
    drop(terms, found)


def read_import(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An output of import_source(): records as they are, the others with text, the column they are about."""
    if name == "records":
        return spark.read.parquet(f"{path}/records")
    return spark.read.schema(f"{OUTPUTS[name]}, text string").options(**_AS_TEXT, multiLine=True).csv(f"{path}/{name}").fillna("")  # no output has nulls
