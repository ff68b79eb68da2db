"""Counts, profiles, order statistics and window selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .canonical import performance_class
from .running import join_null_safe, running_sums, values_at


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column, value, n, rank): the n most frequent values of every column, ties by value; one pass over df."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique, null_ratio) in one aggregation."""
    row = df.agg(*[F.struct(F.count_distinct(c).alias("u"), F.round(F.count_if(F.col(c).isNull()) / F.count("*"), 4).alias("r")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["u"].alias("n_unique"), F.col(c)["r"].alias("null_ratio")) for c in columns])).alias("s")).select("s.*")


def drop_sparse_columns(df: DataFrame, most_null: float = 0.9) -> DataFrame:
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if (shares[c] or 0.0) < most_null])


def five_number(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Exact quartiles from counts of distinct values, whatever the size of a group."""
    return values_at(df, keys, column, {"low": (0.0, True), "q1": (0.25, True), "median": (0.5, True), "q3": (0.75, True), "high": (1.0, True)})


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value at which half of the weight is reached; the mean of two where a sum is exactly half."""
    rows = running_sums(df.groupBy(*keys, value).agg(F.sum(weight).alias("_w")), keys, value, ["_w"], source=df)
    before, upto, every = 2 * (F.col("run__w") - F.col("_w")), 2 * F.col("run__w"), F.col("all__w")
    hit = (upto >= every) & (before < every)
    found = rows.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias("_v"), F.bool_or(hit & (upto == every)).alias("_even"), F.min(F.when(before >= every, F.col(value))).alias("_next"))
    return found.select(*keys, F.when(F.col("_even") & F.col("_next").isNotNull(), (F.col("_v") + F.col("_next")) / 2).otherwise(F.col("_v").cast("double")).alias("weighted_median"))


def order_interval(df: DataFrame, keys: list[str], column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values at positions int(p x n) from 0, with mean, median and sample deviation."""
    stats = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"))
    places = values_at(df, keys, column, {"low": (low, False), "high": (high, False), "median": (0.5, True)})
    return join_null_safe(places, stats, keys).select(*keys, "low", "high", "mean", "median", "deviation")


def with_group_count(df: DataFrame, keys: list[str], out: str = "n_group") -> DataFrame:
    """Adds the size of each row's group. Sizes are counted before the shuffle and joined, so that the rows of a large group need not
    meet in one task."""
    return join_null_safe(df, df.groupBy(*keys).agg(F.count("*").alias(out)), keys)


def at_group_max(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All rows at their group's maximum, by a join as in with_group_count()."""
    return join_null_safe(df, df.groupBy(*keys).agg(F.max(column).alias("_m")), keys).where(F.col("_m") == F.col(column)).drop("_m")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def share_of_group(df: DataFrame, keys: list[str], column: str, out: str = "share") -> DataFrame:
    return df.withColumn(out, F.col(column) / F.sum(column).over(W.partitionBy(*keys)))


def heterogeneity(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct values of each column per key, and whether those counts differ."""
    out = df.groupBy(key).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    counts = F.array(*[F.col(f"n_{c}") for c in columns])
    return out.withColumn("heterogeneous", F.array_max(counts) != F.array_min(counts))


def case_report(rows: DataFrame, scores: DataFrame, code: str, columns: list[str], high: float = 0.9) -> DataFrame:
    """(class, n_codes, ratio, n_rows, n_mixed) of the performance classes of scores(code, score): codes and their share of all codes, their
    rows, and codes whose columns have differing numbers of distinct values."""
    facts = heterogeneity(rows, code, columns).join(rows.groupBy(code).agg(F.count("*").alias("_n")), code)
    told = scores.select(code, performance_class(F.col("score"), high).alias("class")).join(facts.select(code, "_n", "heterogeneous"), code, "left")
    out = told.groupBy("class").agg(F.count("*").alias("n_codes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count_if("heterogeneous").alias("n_mixed"))
    every = scores.agg(F.count("*").alias("_all"))  # one row
    return out.crossJoin(F.broadcast(every)).select("class", "n_codes", (F.col("n_codes") / F.col("_all")).alias("ratio"), "n_rows", "n_mixed")


def class_balance(df: DataFrame, label: str, least: float = 0.1) -> DataFrame:
    """(label, n, ratio, multiple of the rarest, is_balanced)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))  # one row per class
    ratio = F.col("n") / F.sum("n").over(every)
    return counts.withColumns({"ratio": ratio, "multiple": F.col("n") / F.min("n").over(every)}).withColumn("is_balanced", F.min("ratio").over(every) >= least)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("s")).select("s.*")


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "variable", "value")


def top_and_bottom(df: DataFrame, column: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(column), tie).limit(n).unionByName(df.orderBy(column, tie).limit(n)).distinct()


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of new replace those of old with the same keys."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_last(both, keys, [F.desc("_new")]).drop("_new")


def bags(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns name.0, name.1, ... to their mean per row, named name."""
    mean = lambda n, own: (reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in own]) / len(own)).alias(n)
    own = {n: [c for c in df.columns if c.rpartition(".")[0] == n] for n in names}
    used = {c for cs in own.values() for c in cs}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in used], *[mean(n, cs) for n, cs in own.items()])


def label_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Per label: rows, rows that are zero in every column, and each column's mean."""
    zero = F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x == 0)
    return df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(zero).alias("n_zero"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def distinct_with_count(df: DataFrame, keys: list[str], out: str = "n_group") -> DataFrame:
    """Exact copies of rows once, with the number of distinct rows of their keys (null keys are a group)."""
    rows = df.distinct()
    return join_null_safe(rows, rows.groupBy(*keys).agg(F.count("*").alias(out)), keys)


def spread(df: DataFrame, key: str, value: str, order: str, k: int, default: str = "NONE") -> DataFrame:
    """(key, <value>_1 .. <value>_k): the first k distinct values of each key by first appearance, default where there are fewer."""
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    top = first.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_o", value))).where(F.col("_r") <= k)
    return top.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("_r") == i, F.col(value))), F.lit(default)).alias(f"{value}_{i}") for i in range(1, k + 1)])


def standard_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, deviation, n_low, n_high) with the values beyond three deviations counted, in two passes."""
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")).alias(f"_{c}") for c in columns])  # one row
    z = lambda c: (F.col(c) - F.col(f"_{c}.mean")) / F.nullif(F.col(f"_{c}.deviation"), F.lit(0.0))
    row = df.crossJoin(F.broadcast(one)).agg(*[F.struct(F.any_value(f"_{c}").alias("s"), F.count_if(z(c) < -3).alias("n_low"), F.count_if(z(c) > 3).alias("n_high")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["s"]["n"].alias("n"), F.col(c)["s"]["mean"].alias("mean"), F.col(c)["s"]["deviation"].alias("deviation"), F.col(c)["n_low"].alias("n_low"), F.col(c)["n_high"].alias("n_high")) for c in columns])).alias("s")).select("s.*")


def interval_about(df: DataFrame, keys: list[str], column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values at positions int(p x n) from 0, the upper one no more than 1, their distances below and above the mean, deviation."""
    c = order_interval(df, keys, column, low, high).withColumn("high", F.least("high", F.lit(1.0)))
    return c.select(*keys, "low", "high", (F.col("mean") - F.col("low")).alias("below"), (F.col("high") - F.col("mean")).alias("above"), "deviation")


def mean_abs_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of the absolute correlations of all pairs of columns."""
    return correlations(df, columns).agg(F.avg(F.abs("r")).alias("mean_abs_r"))


def informative(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and the z-scores of those columns that have no null, without rows whose mean score is 0."""
    from .encode import scale

    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()  # one row
    kept = [c for c in columns if nulls[c] == 0]
    z = scale(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in kept]), kept, "zscore")
    return z.where(F.abs(reduce(lambda a, b: a + b, [F.col(c) for c in kept])) > 1e-12) if kept else z


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The values that both tables have."""
    return a.select(column).intersect(b.select(column))


def join_all(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on key; an error if a row of either side has no partner or several."""
    out = a.join(b, key)
    n = [x.count() for x in (a, b, out)]
    if len(set(n)) > 1:
        raise ValueError(f"rows {n[0]} and {n[1]} give {n[2]}")
    return out
