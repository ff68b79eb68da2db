"""Running sums and exact quantiles of groups of any size.

A window over a whole group is one task, however large the group. Here the ordered values are cut at approximate quantiles, sums
run inside each part, and the sums of earlier parts, a few hundred rows a group, are added. Results do not depend on the cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PARTS = 256
#: Rows that one part may have before another is cut; parts of this size sort in memory.
ROWS_A_PART = 200_000
CUT = 64


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet; without keys, b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    b = b.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])).drop(*[f"_key_{k}" for k in keys])


def add_totals_before(rows: DataFrame, keys: list[str], part: str, columns: list[str], down: bool = False) -> DataFrame:
    """Adds before_<c>, the sum of c over the group's earlier parts, and all_<c>, its sum over the group."""
    by = W.partitionBy(*(keys or [F.lit(1)]))
    order = by.orderBy(F.desc(part) if down else F.asc(part)).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, part).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = [F.coalesce(F.sum(f"_t_{c}").over(order), F.lit(0)).alias(f"before_{c}") for c in columns]
    return join_null_safe(rows, sums.select(*keys, part, *before, *[F.sum(f"_t_{c}").over(by).alias(f"all_{c}") for c in columns]), [*keys, part])


def bucket_of(edges: list, c: Column) -> Column:
    """How many of the sorted edges are below c: a tree of comparisons, so that a row meets about log2 of them. Null: 0."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c > F.lit(edges[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(edges))


def part_edges(df: DataFrame, order: str) -> list:
    """Sorted edges that cut the rows into shares of about equal size: one for every ROWS_A_PART rows, PARTS at most. They are found
    in a job of their own; any edges give the same results. Strings are cut by the first CUT letters of 4096 of them, drawn by hash."""
    if dict(df.dtypes)[order] == "string":
        n = df.count()
        parts = min(PARTS, -(-n // ROWS_A_PART))
        if parts < 2:
            return []
        drawn = df.where(F.col(order).isNotNull()).select(F.substring(order, 1, CUT).alias("v")).orderBy(F.xxhash64("v")).limit(4096).collect()
        found = sorted((r[0] for r in drawn), key=lambda v: v.encode())
        return sorted({found[len(found) * i // parts] for i in range(1, parts)}, key=lambda v: v.encode()) if found else []
    edges, n = df.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 10_000), F.count(order)).first()
    parts = min(PARTS, -(-n // ROWS_A_PART))
    return sorted({edges[PARTS * i // parts - 1] for i in range(1, parts)}) if edges else []


def in_parts(df: DataFrame, order: str) -> DataFrame:
    """Adds _part, which rises with order, by part_edges()."""
    return df.withColumn("_part", bucket_of(part_edges(df, order), F.col(order)))


def ranked_by(df: DataFrame, keys: list[str], order: str, ties: list[str]) -> DataFrame:
    """Adds _rank, the place from 1 in the group by order and then ties (nulls first), and _all, the size of the group."""
    rows = add_totals_before(in_parts(df, order).withColumn("_one", F.lit(1)), keys, "_part", ["_one"])
    rank = F.col("before__one") + F.row_number().over(W.partitionBy(*keys, "_part").orderBy(order, *ties))
    return rows.withColumns({"_rank": rank, "_all": F.col("all__one")}).drop("_one", "_part", "before__one", "all__one")


def running_sums(df: DataFrame, keys: list[str], order: str, columns: list[str], down: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Adds run_<c>, the sum of c over the group's rows up to and with this value of order (a number or a time), and all_<c>. Edges of
    parts come from source if that is cheaper to read; where all rows fit in one part, nothing is joined."""
    edges = part_edges(source or df, order)
    ordered = F.desc(order) if down else F.asc(order)
    if not edges:
        by = W.partitionBy(*(keys or [F.lit(1)]))
        sums = {f"run_{c}": F.sum(c).over(by.orderBy(ordered)) for c in columns}
        return df.withColumns(sums | {f"all_{c}": F.sum(c).over(by) for c in columns})
    rows = add_totals_before(df.withColumn("_part", bucket_of(edges, F.col(order))), keys, "_part", columns, down)
    by = W.partitionBy(*keys, "_part").orderBy(ordered)
    rows = rows.withColumns({f"run_{c}": F.col(f"before_{c}") + F.sum(c).over(by) for c in columns})
    return rows.drop("_part", *[f"before_{c}" for c in columns])


def values_at(df: DataFrame, keys: list[str], column: str, positions: dict[str, tuple[float, bool]]) -> DataFrame:
    """(keys, one column per position): name -> (p, True) is the quantile p, linear between neighbours; (p, False) is the value
    at place int(p x n) from 0. Nulls do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    rows = running_sums(counts, keys, column, ["_n"], source=df)
    out = []
    for name, (p, linear) in positions.items():
        at = F.lit(p) * (F.col("all__n") - 1 if linear else F.col("all__n"))

        def value(i: Column) -> Column:
            return F.max(F.when((F.col("run__n") > i) & (F.col("run__n") - F.col("_n") <= i), F.col(column)))

        low = value(F.floor(at))
        out.append((low + (value(F.ceil(at)) - low) * F.max(at - F.floor(at)) if linear else low).alias(name))
    return rows.groupBy(*keys).agg(*out)
