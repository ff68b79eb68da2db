"""Categorical codes, labels and scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sampling import uniform
from .steps import written


def ordinals(df: DataFrame, column: str) -> DataFrame:
    """(column, ordinal): values by rank from 0. Distinct values are dealt over parts of about equal size, so that no task sorts all
    of them."""
    from .running import add_totals_before, in_parts

    values = in_parts(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    rows = add_totals_before(values.withColumn("_one", F.lit(1)), [], "_part", ["_one"])
    place = F.col("before__one") + F.row_number().over(W.partitionBy("_part").orderBy(column))
    return rows.select(column, (place - 1).cast("int").alias("ordinal"))


def categorify(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based sorted code; null is -1."""
    return df.join(ordinals(df, column), column, "left").withColumn(out, F.coalesce("ordinal", F.lit(-1))).drop("ordinal")


def binary_encode(df: DataFrame, column: str, bits: int) -> DataFrame:
    """The code from 1 on as bits columns, null as zeros."""
    coded = categorify(df, column, "_c")
    return coded.withColumns({f"{column}_{k}": F.shiftright(F.col("_c") + 1, bits - 1 - k).bitwiseAND(1) for k in range(bits)}).drop("_c")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values})


def one_vs_all(c: Column, target: str) -> Column:
    return F.when(c == target, 1).otherwise(0)


def fill(df: DataFrame, texts: list[str], numbers: list[str], token: str = "unknown") -> DataFrame:
    return df.fillna(token, texts).fillna(0, numbers)


def scale(df: DataFrame, columns: list[str], how: str = "minmax") -> DataFrame:
    """minmax to 0..1, or zscore by the population deviation: one aggregation, its single row joined back."""
    agg = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min if how == "minmax" else F.avg), ("b", F.max if how == "minmax" else F.stddev_pop))]
    out = df.crossJoin(F.broadcast(df.agg(*agg)))  # one row
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        width = b - a if how == "minmax" else b
        out = out.withColumn(c, F.when(width == 0, F.lit(0.0)).otherwise((F.col(c) - a) / width))
    return out.select(*df.columns)


def unit_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return df.withColumns({c: F.when(norm == 0, F.lit(0.0)).otherwise(F.col(c) / norm) for c in columns})


def perturb(c: Column, least: float, seed: int, *keys: str, alpha: float = 10.0) -> Column:
    """c plus noise from least / (10 alpha) to least / alpha, drawn by a hash of the row's keys, so that it can be repeated."""
    return c + least / (10 * alpha) + uniform(seed, *keys) * (least / alpha - least / (10 * alpha))


def needs_scaling(df: DataFrame, columns: list[str]) -> bool:
    """Whether some column goes below 0 or above 1."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))]).first()
    return any((row[f"a_{c}"] or 0) < 0 or (row[f"b_{c}"] or 0) > 1 for c in columns)


def encode_columns(df: DataFrame, columns: list[str], high: int = 10, most_null: float = 0.9) -> DataFrame:
    """Text columns as numbers: columns with nulls in most rows go, nulls become unknown, columns of fewer than high values
    become one column per value and the others the bits of a code. Two passes over the counts decide, one plan encodes."""
    stats = df.agg(*[F.struct(F.count_distinct(c).alias("u"), F.avg(F.col(c).isNull().cast("int")).alias("r")).alias(c) for c in columns]).first()
    kept = [c for c in columns if (stats[c]["r"] or 0.0) < most_null]
    out = fill(df.drop(*[c for c in columns if c not in kept]), kept, [])
    for c in kept:
        n = stats[c]["u"] + ((stats[c]["r"] or 0.0) > 0)
        if n < high:
            values = sorted(r[0] for r in out.select(c).distinct().collect())  # fewer than high
            out = one_hot(out, c, values).drop(c)
        else:
            out = binary_encode(out, c, max(1, int(stats[c]["u"] + 1).bit_length())).drop(c)
    return out


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in columns."""
    return df.na.drop("any", subset=columns)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's mean."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])  # one row
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).select(*df.columns)


def impute_chained(df: DataFrame, columns: list[str], rounds: int = 10, ridge: float = 1e-6) -> DataFrame:
    """Nulls become what a linear regression on the other columns gives, all columns side by side for a number of rounds.

    Nulls begin as means. In each round one aggregation gathers, for every column with nulls, the sums of products over the rows
    that have it (of the round's standardised values); so many equations as there are columns are solved on the driver, and all
    nulls are filled anew from the values before the round. Rows without any value have the means; a column without values stays
    null and serves no other."""
    own = df.withColumns({f"_i_{c}": F.col(c).cast("double") for c in columns})
    first = own.agg(*[F.count(f"_i_{c}").alias(f"n_{c}") for c in columns], *[F.avg(f"_i_{c}").alias(f"m_{c}") for c in columns], *[F.stddev_pop(f"_i_{c}").alias(f"s_{c}") for c in columns], F.count("*").alias("all")).first()
    used = [c for c in columns if first[f"n_{c}"]]
    scale = {c: (first[f"m_{c}"], first[f"s_{c}"] or 1.0) for c in used}
    open_columns = [c for c in used if first[f"n_{c}"] < first["all"]]
    z = lambda c: (F.col(f"_i_{c}") - scale[c][0]) / scale[c][1]
    rows = own.withColumns({f"_z_{c}": F.coalesce(z(c), F.lit(0.0)) for c in used})
    for _ in range(rounds if open_columns and len(used) > 1 else 0):
        rows = written(rows, "imputed")
        sums = {}
        for c in open_columns:
            x = [F.lit(1.0), *[F.col(f"_z_{o}") for o in used if o != c], z(c)]
            sums |= {f"{c}:{i}:{j}": F.sum(F.when(F.col(f"_i_{c}").isNotNull(), x[i] * x[j])) for i in range(len(x)) for j in range(i, len(x))}
        got = rows.agg(*[v.alias(str(i)) for i, v in enumerate(sums.values())]).first()
        moment = dict(zip(sums, got, strict=True))
        fresh = {}
        for c in open_columns:
            n = len(used)
            xx = np.array([[moment[f"{c}:{min(i, j)}:{max(i, j)}"] for j in range(n)] for i in range(n)])
            b = np.linalg.solve(xx + ridge * first[f"n_{c}"] * np.eye(n), np.array([moment[f"{c}:{i}:{n}"] for i in range(n)]))
            guess = sum((float(v) * F.col(f"_z_{o}") for v, o in zip(b[1:], [o for o in used if o != c], strict=True)), F.lit(float(b[0])))
            fresh[f"_z_{c}"] = F.coalesce(z(c), guess)
        rows = rows.withColumns(fresh)
    out = {c: F.coalesce(F.col(f"_i_{c}"), F.col(f"_z_{c}") * scale[c][1] + scale[c][0]) for c in used}
    return rows.withColumns({**out, **{c: F.col(f"_i_{c}") for c in columns if c not in used}}).select(*df.columns)
