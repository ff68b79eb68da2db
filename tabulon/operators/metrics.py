"""Scores of binary predictions as aggregates. Scores are grouped first; sums over thresholds run in parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .running import join_null_safe, running_sums


def curve(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """(keys, score, tp, fp, positives, total) at every distinct score taken as threshold."""
    counts = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    rows = running_sums(counts, keys, score, ["_p", "_n"], down=True, source=df)
    return rows.select(*keys, score, F.col("run__p").alias("tp"), (F.col("run__n") - F.col("run__p")).alias("fp"), F.col("all__p").alias("positives"), F.col("all__n").alias("total"))


def fmax(df: DataFrame, keys: list[str], label: str, score: str, beta: float = 1.0) -> DataFrame:
    """Best F over the thresholds, with threshold, precision and recall there (the highest threshold of equal ones)."""
    c = curve(df, keys, label, score).withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.nullif("positives", F.lit(0))})
    f = (1 + beta**2) * F.col("precision") * F.col("recall") / F.nullif(beta**2 * F.col("precision") + F.col("recall"), F.lit(0.0))
    best = c.withColumn("f", f).groupBy(*keys).agg(F.max(F.struct("f", F.col(score).alias("threshold"), "precision", "recall")).alias("b"))
    return best.select(*keys, F.col("b.f").alias("fmax"), F.col("b.threshold").alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def roc_auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area by the rank sum, ties by their mean rank."""
    c = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    c = running_sums(c, keys, score, ["_n"], source=df)
    rank = F.col("run__n") - (F.col("_n") - 1) / 2
    sums = c.withColumn("_r", rank * F.col("_p")).groupBy(*keys).agg(F.sum("_r").alias("_r"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    return sums.select(*keys, ((F.col("_r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auc"))


def confusion(df: DataFrame, keys: list[str], label: str, score: str, threshold: float) -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    c = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn, e = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), 1e-9
    return c.withColumns({"tpr": tp / (tp + fn + e), "tnr": tn / (tn + fp + e), "ppv": tp / (tp + fp + e), "npv": tn / (tn + fn + e), "fpr": fp / (fp + tn + e), "fnr": fn / (fn + tp + e), "fdr": fp / (fp + tp + e), "acc": (tp + tn) / (tp + fp + fn + tn)})


def brier(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    return df.groupBy(*keys).agg((1 - F.avg((F.col(score) - F.col(label)) ** 2)).alias("brier"))


def rmse(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2)).alias("rmse"))


def prior_threshold(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """The score at the rank of the number of positives; found among counts of distinct scores."""
    c = curve(df, keys, label, score)
    return c.where(F.col("tp") + F.col("fp") >= F.col("positives")).groupBy(*keys).agg(F.max(score).alias("threshold"))


def majority(df: DataFrame, item: str, vote: str) -> DataFrame:
    """1 where more than half of the votes are 1."""
    return df.groupBy(item).agg(F.when(F.avg(vote) > 0.5, 1).otherwise(0).alias("label"))


def combine(df: DataFrame, item: str, score: str, how: str = "mean") -> DataFrame:
    return df.groupBy(item).agg((F.avg(score) if how == "mean" else F.percentile(score, 0.5)).alias("score"))


def rank_methods(df: DataFrame, metric: str, method: str, value: str, k: int) -> DataFrame:
    mean = df.groupBy(metric, method).agg(F.avg(value).alias("mean"))
    return mean.withColumn("rank", F.row_number().over(W.partitionBy(metric).orderBy(F.desc("mean"), method))).where(F.col("rank") <= k)


def best_within_error(df: DataFrame, name: str, score: str, deviation: str, n: int) -> DataFrame:
    """The first name whose score is within one standard error of the best."""
    best = df.agg(F.max(F.struct(score, deviation)).alias("b"))  # one row
    near = df.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("b")[score] - F.col("b")[deviation] / (n - 1) ** 0.5)
    return near.orderBy(name).limit(1).drop("b")


def ratio_threshold(df: DataFrame, keys: list[str], label: str, score: str, ratio: float) -> DataFrame:
    """The score at rank ceil(ratio x n)."""
    c = curve(df, keys, label, score)
    return c.where(F.col("tp") + F.col("fp") >= F.ceil(F.lit(ratio) * F.col("total"))).groupBy(*keys).agg(F.max(score).alias("threshold"))


def threshold_at_fpr(df: DataFrame, keys: list[str], label: str, score: str, rate: float) -> DataFrame:
    """The highest score at which the share of false positives reaches rate."""
    c = curve(df, keys, label, score)
    return c.where(F.col("fp") >= F.lit(rate) * (F.col("total") - F.col("positives"))).groupBy(*keys).agg(F.max(score).alias("threshold"))


def youden(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """The threshold of the largest tpr - fpr, the highest of equals."""
    c = curve(df, keys, label, score)
    j = F.col("tp") / F.nullif("positives", F.lit(0)) - F.col("fp") / F.nullif(F.col("total") - F.col("positives"), F.lit(0))
    return c.groupBy(*keys).agg(F.max(F.struct(F.round(j, 9).alias("j"), F.col(score).alias("threshold"))).alias("b")).select(*keys, F.col("b.j").alias("j"), F.col("b.threshold").alias("threshold"))


def votes(df: DataFrame, item: str, method: str, score: str, thresholds: DataFrame) -> DataFrame:
    """(item, method, vote): 1 where the score reaches the method's threshold in thresholds(method, threshold)."""
    return df.join(thresholds, method).select(item, method, (F.col(score) >= F.col("threshold")).cast("int").alias("vote"))


def multiclass_auc(df: DataFrame, classes: list[str], label: str) -> DataFrame:
    """Mean over classes of the area of each class against the rest; df has one score column per class, named like it."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("int").alias("y"), F.col(c).cast("double").alias("s")) for c in classes])).alias("r")).select("r.*")
    return roc_auc(long, ["class"], "y", "s").agg(F.avg("auc").alias("auc"))


def against_best(df: DataFrame, metric: str, method: str, value: str) -> DataFrame:
    """(metric, method, mean, best, delta): every method's mean over folds beside the best of its metric."""
    mean = df.groupBy(metric, method).agg(F.avg(value).alias("mean"))
    by = W.partitionBy(metric)  # one row per method
    return mean.withColumn("_b", F.max(F.struct("mean", method)).over(by)).select(metric, method, "mean", F.col("_b")[method].alias("best"), (F.col("mean") - F.col("_b.mean")).alias("delta"))


def method_summary(df: DataFrame, metric: str, value: str) -> DataFrame:
    return df.groupBy(metric).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def all_scores(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """auc, fmax, fmax_negative (label 0 is the one to find, by the same scores) and brier, all from one curve."""
    counts = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    c = running_sums(counts, keys, score, ["_p", "_n"], down=True, source=df)
    hits, n, s = F.col("_p"), F.col("_n"), F.col(score)
    tp, taken, positives, total = F.col("run__p"), F.col("run__n"), F.col("all__p"), F.col("all__n")
    negatives = total - positives

    def best(found, wanted):  # F of precision found / taken and recall found / wanted
        return F.max(F.when((found > 0) & (wanted > 0), 2 * (found / taken) * (found / wanted) / (found / taken + found / wanted)).when(wanted > 0, F.when(found > 0, F.lit(0.0))))

    below = F.sum(hits * (negatives - (taken - tp) + (n - hits) / 2))
    return c.groupBy(*keys).agg(
        (below / F.nullif(F.max(positives) * F.max(negatives), F.lit(0))).alias("auc"),
        best(tp, positives).alias("fmax"), best(taken - tp, negatives).alias("fmax_negative"),
        (1 - F.sum(hits * (s - 1) ** 2 + (n - hits) * s**2) / F.max(total)).alias("brier"),
    )


def summary_of(df: DataFrame, name: str, value: str, least: int = 1, **aggregates: Column) -> DataFrame:
    """(name, n, one column per aggregate) of the names that have least values or more; aggregates are Columns over value, the
    mean if none is given."""
    out = aggregates or {"mean": F.avg(value)}
    return df.groupBy(name).agg(F.count(value).alias("n"), *[c.alias(k) for k, c in out.items()]).where(F.col("n") >= least)


def combine_by(df: DataFrame, item: str, aggregate: Column) -> DataFrame:
    """Scores of several methods as one per item, by any aggregate."""
    return df.groupBy(item).agg(aggregate.alias("score"))


def compare_estimates(before: DataFrame, after: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc, fmax, fmax_negative and brier of both tables of scores, and what the second gains."""
    a, b = all_scores(before, [], label, score), all_scores(after, [], label, score)
    names = a.columns
    both = a.select(*[F.col(c).alias(f"{c}_before") for c in names]).crossJoin(F.broadcast(b.select(*[F.col(c).alias(f"{c}_after") for c in names])))  # one row each
    return both.withColumns({f"{c}_gain": F.col(f"{c}_after") - F.col(f"{c}_before") for c in names})


def divide_methods(df: DataFrame, method: str, groups: dict[str, list[str]], other: str = "other") -> DataFrame:
    """Adds group: the first whose prefixes a method's name begins with."""
    c = F.lit(other)
    for name, starts in reversed(groups.items()):
        c = F.when(reduce(Column.__or__, [F.col(method).startswith(s) for s in starts]), F.lit(name)).otherwise(c)
    return df.withColumn("group", c)
