"""Canonical codes and record labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOISY_CODES, dehyphenate, replace_values, trim_tail


def canonical_code(c: Column, noisy: Iterable[str] = NOISY_CODES, missing: str = "unknown") -> Column:
    """null to missing; hyphens out; noisy cells to missing; tails off; empty to missing - in this order."""
    code = trim_tail(replace_values(dehyphenate(F.coalesce(c, F.lit(missing))), noisy, missing))
    return F.when(code == "", F.lit(missing)).otherwise(code)


def canonicalize(df: DataFrame, column: str, targets: DataFrame | None = None, noisy: Iterable[str] = NOISY_CODES, other: str = "other", missing: str = "unknown") -> DataFrame:
    """df with column made canonical. targets: a table of allowed codes (column of the same name); others become other."""
    df = df.withColumn(column, canonical_code(F.col(column), noisy, missing))
    if targets is None:
        return df
    allowed = targets.select(F.col(column).alias("_t")).distinct()
    known = df.join(allowed, df[column] == allowed["_t"], "left")
    return known.withColumn(column, F.when(F.col("_t").isNotNull() | (F.col(column) == missing), F.col(column)).otherwise(other)).drop("_t")


def check_canonical(df: DataFrame, column: str, noisy: Iterable[str] = NOISY_CODES, targets: DataFrame | None = None) -> DataFrame:
    """One row: counts of rows, nulls, hyphens and noisy cells, over all rows; with targets (column of the same name) also outside, the
    rows whose code is none of them nor unknown or other."""
    c = F.col(column)
    if targets is not None:
        codes = df.groupBy(column).agg(F.count("*").alias("_n"))
        known = targets.select(F.col(column).alias("_t")).where("_t is not null").distinct()
        codes = codes.join(known, codes[column] == known["_t"], "left")
        count = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0))
        outside = F.col("_t").isNull() & c.isNotNull() & ~c.isin("unknown", "other")
        return codes.agg(count(F.lit(True)).alias("n"), count(c.isNull()).alias("nulls"), count(c.contains("-")).alias("hyphens"), count(F.lower(c).isin(*noisy)).alias("noisy"), count(outside).alias("outside"))
    return df.agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c.contains("-")).alias("hyphens"), F.count_if(F.lower(c).isin(*noisy)).alias("noisy"))


def valid_code(c: Column) -> Column:
    return (c == "unknown") | c.rlike(r"^\d+")


def null_type(code: Column, tag: Column) -> Column:
    """1 both present, 2 no code, 3 no tag, 4 neither."""
    return F.when(code.isNotNull() & tag.isNotNull(), 1).when(tag.isNotNull(), 2).when(code.isNotNull(), 3).otherwise(4)


def performance_class(score: Column, high: float = 0.9) -> Column:
    return F.when(score < 0, "low").when(score < high, "hard").otherwise("easy")


def any_null(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def all_zero(*columns: str) -> Column:
    return F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x == 0)
