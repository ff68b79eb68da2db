"""Samples, splits and balance. Every draw orders rows by a hash of a seed and a key, so that it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profile import keep_last
from .running import join_null_safe, ranked_by, running_sums
from .steps import written


#: Counts that go to every task: of about a dozen classes, in all parts of the hash.
FEW = 50_000


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def ranked(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Adds _rank, the place from 1 in the class's hashed order, and _all, the class size. A class is dealt over the parts of
    the hash, so that no task sorts a whole class. Counts of the parts are written first; up to FEW of them go to every task, so that
    rows move once, to be ranked."""
    rows = df.withColumn("_d", F.unhex(draw(seed, key))).withColumn("_part", F.substring(F.hex("_d"), 1, 3))
    by = W.partitionBy(label)
    sizes = rows.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(by.orderBy("_part")) - F.col("_n")
    sizes = written(sizes.select(label, "_part", before.alias("_before"), F.sum("_n").over(by).alias("_all")), "sizes")
    placed = join_null_safe(rows, F.broadcast(sizes) if sizes.count() <= FEW else sizes, [label, "_part"])
    rank = F.col("_before") + F.row_number().over(W.partitionBy(label, "_part").orderBy("_d", key))
    return placed.withColumn("_rank", rank).select(*df.columns, "_rank", "_all")


def per_class(df: DataFrame, label: str, key: str, n: int | Column, seed: int = 0) -> DataFrame:
    """At most n rows of every class (n may be a column)."""
    if isinstance(n, Column):
        return ranked(df, label, key, seed).where(F.col("_rank") <= n).drop("_rank", "_all")
    rank = F.row_number().over(W.partitionBy(label).orderBy(draw(seed, key), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(seed, key), key).limit(n)


def balance_to_median(df: DataFrame, label: str, key: str, seed: int = 0, pool: DataFrame | None = None) -> DataFrame:
    """Classes above the median class size are cut down to it. With a pool, classes below it are filled up from it instead, as far
    as its rows go."""
    if pool is not None:
        median = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.floor(F.percentile("_n", 0.5)).cast("int")).first()[0]  # one number
        return df.unionByName(top_up(df, pool, label, key, median or 0, seed))
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    cap = sizes.agg(F.floor(F.percentile("_n", 0.5)).cast("int").alias("_cap"))  # one row
    return per_class(df.crossJoin(F.broadcast(cap)), label, key, F.col("_cap"), seed).drop("_cap")


def cap_majority(df: DataFrame, label: str, key: str, times: int, seed: int = 0) -> DataFrame:
    """No class keeps more than times the rows of the rarest."""
    cap = df.groupBy(label).agg(F.count("*").alias("_n")).agg((F.min("_n") * times).cast("int").alias("_cap"))  # one row
    return per_class(df.crossJoin(F.broadcast(cap)), label, key, F.col("_cap"), seed).drop("_cap")


def _class_sizes(df: DataFrame, label: str, target: int | None) -> DataFrame:
    """(label, _n, _to) of the classes but unknown and other; _to is target, or the size of the largest of them."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n")).where(~F.col(label).isin("unknown", "other"))
    most = F.max("_n").over(W.partitionBy(F.lit(1)))  # one row per class
    return sizes.withColumn("_to", most if target is None else F.lit(target))


def top_up(df: DataFrame, pool: DataFrame, label: str, key: str, target: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of pool that bring every class of df up to target (by default the size of its largest class), as far as they go;
    nothing for unknown and other."""
    lack = _class_sizes(df, label, target).where("_n < _to")
    fresh = pool.join(df.select(key), key, "left_anti").join(lack.select(label, (F.col("_to") - F.col("_n")).cast("int").alias("_lack")), label)
    return per_class(fresh, label, key, F.col("_lack"), seed).select(*df.columns)


def negatives(codes: DataFrame, column: str, k: int, seed: int = 0) -> DataFrame:
    """(code, negative): k other codes for each code: those that follow it in a hashed order, in a circle. One sort of the
    codes, whose number the dictionary bounds, instead of all pairs."""
    codes = codes.select(column).distinct()
    placed = codes.withColumn("_i", F.row_number().over(W.orderBy(draw(seed, column), column)) - 1)
    n = codes.agg(F.count("*").alias("_n"))  # one row
    want = placed.crossJoin(F.broadcast(n)).select(F.col(column), F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("_n") - 1, F.lit(1))))).alias("_k"), "_i", "_n").where("_n > 1")
    want = want.withColumn("_j", F.pmod(F.col("_i") + F.col("_k"), F.col("_n")))
    return want.join(placed.select(F.col(column).alias("negative"), F.col("_i").alias("_j")), "_j").select(column, "negative")


def split(df: DataFrame, key: str, ratio: float, label: str | None = None, seed: int = 0, out: str = "part") -> DataFrame:
    """Adds part: train for the first floor(ratio x n) rows of each class in hashed order, else test. Without label, all rows
    are one class.

    Rows stay where they are: counts of the hash's parts tell in which part a class is cut, the rows of that part alone are ranked,
    and every row is compared with its class's cut. Where that falls among rows of one key, these are dealt out by a rank of their own."""
    own = F.col(label) if label else F.lit(1)
    rows = df.withColumns({"_class": own, "_d": draw(seed, key)}).withColumn("_part", F.substring("_d", 1, 3))
    by = W.partitionBy("_class")
    sizes = rows.groupBy("_class", "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumns({"_before": F.sum("_n").over(by.orderBy("_part")) - F.col("_n"), "_train": F.floor(F.lit(ratio) * F.sum("_n").over(by)).cast("long")})
    at = sizes.where((F.col("_before") < F.col("_train")) & (F.col("_train") <= F.col("_before") + F.col("_n")))
    at = written(at.select("_class", "_part", "_before", "_train"), "at")  # a row per class: rows meet it without a shuffle of their own
    placed = join_null_safe(rows.select("_class", "_part", F.struct("_d", F.col(key).alias("_k")).alias("_cut")), at, ["_class", "_part"])
    place = F.row_number().over(W.partitionBy("_class", "_part").orderBy("_cut"))
    ties = F.count("*").over(W.partitionBy("_class", "_part").orderBy("_cut"))  # rows up to and with this key
    less = F.rank().over(W.partitionBy("_class", "_part").orderBy("_cut")) - 1  # rows before this key
    cuts = placed.withColumns({"_r": place, "_ties": ties, "_less": less}).where(F.col("_r") == F.col("_train") - F.col("_before"))
    cuts = cuts.select(F.col("_class").alias("_key"), "_cut", (F.col("_ties") > F.col("_r")).alias("_tied"), (F.col("_r") - F.col("_less")).alias("_need"))
    cuts = written(cuts, "cuts")
    met = rows.join(cuts, F.col("_class").eqNullSafe(F.col("_key")), "left")
    mine = F.struct("_d", F.col(key).alias("_k"))
    side = lambda train: F.when(train, "train").otherwise("test").alias(out)
    if cuts.where("_tied").isEmpty():
        return met.select(*df.columns, side(mine <= F.col("_cut")))  # no cut: a class without train rows
    at_cut = F.coalesce(F.col("_tied") & (mine == F.col("_cut")), F.lit(False))
    of_key = F.row_number().over(W.partitionBy("_class").orderBy("_d"))  # of the rows of one key
    tied = met.where(at_cut).select(*df.columns, side(of_key <= F.col("_need")))
    return met.where(~at_cut).select(*df.columns, side(mine <= F.col("_cut"))).unionByName(tied)


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    return ranked(df, label, key, seed).withColumn(out, F.pmod("_rank", F.lit(k))).drop("_rank", "_all")


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the first 13 digits of the hash."""
    return F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bootstrap(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows as df, drawn with replacement inside each class, so that every label stays."""
    rows = ranked(df, label, key, seed)
    picks = rows.select(label, (F.floor(uniform(seed + 1, key) * F.col("_all")) + 1).alias("_rank"))
    return picks.join(rows.drop("_all"), [label, "_rank"]).select(*df.columns)


def weighted_choice(df: DataFrame, value: str, weight: str, keys: DataFrame, key: str, seed: int = 0, sectors: int = 4096) -> DataFrame:
    """(key, value): for each key one of the values, in proportion to weight, by the inverse of the cumulative weights.

    Weights add up in parts of the ordered values. Draws and intervals meet by the sector of [0, 1) they lie in, so that a
    draw is compared with its sector's values alone and nothing is broadcast."""
    total = df.agg(F.sum(weight)).first()[0]
    rows, high = running_sums(df.select(value, weight), [], value, [weight]), F.col(f"run_{weight}")
    marks = rows.select(value, ((high - F.col(weight)) / total).alias("_low"), (high / total).alias("_high")).where("_low < _high")
    sector = lambda c: F.floor(c * sectors).cast("int")
    marks = marks.withColumn("_sector", F.explode(F.sequence(sector(F.col("_low")), sector(F.col("_high")))))
    drawn = keys.withColumn("_u", uniform(seed, key)).withColumn("_sector", sector(F.col("_u")))
    return drawn.join(marks, "_sector").where((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))).select(key, value)


def round_robin(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows taken from the groups in turn. A group's place counts over the parts of its hashed order."""
    return ranked(df, group, key, seed).orderBy("_rank", group).limit(n).drop("_rank", "_all")


def interval_sample(df: DataFrame, order: str, key: str, n: int, group: str, seed: int = 0) -> DataFrame:
    """One row from each of n equal parts of every group's ranking. The place in the ranking counts over parts of the order, so
    that no task sorts a whole group; of each tile the first row in hashed order is one aggregate."""
    rows = ranked_by(df, [group], order, [key])
    base, more = F.floor(F.col("_all") / n), F.pmod(F.col("_all"), F.lit(n))  # the first tiles have one row more
    i = F.col("_rank") - 1
    tile = F.when(i < more * (base + 1), F.floor(i / (base + 1))).otherwise(more + F.floor((i - more * (base + 1)) / F.greatest(base, F.lit(1)))) + 1
    rows = rows.withColumns({"tile": tile.cast("int"), "_d": draw(seed, key)})
    first = rows.groupBy(group, "tile").agg(F.min(F.struct("_d", F.col(key).alias("_k"), F.struct(*df.columns).alias("_row"))).alias("_f"))
    return first.select("_f._row.*", "tile")


def share_per_class(df: DataFrame, label: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """floor(share x n) rows of every class, at least one, in hashed order."""
    wanted = F.greatest(F.floor(F.lit(share) * F.col("_all")), F.lit(1))
    return ranked(df, label, key, seed).where(F.col("_rank") <= wanted).drop("_rank", "_all")


def with_controls(cases: DataFrame, pool: DataFrame, key: str, times: int = 1, seed: int = 0, out: str = "control") -> DataFrame:
    """cases (out 0) and, of pool, times as many rows that are none of them (out 1), first in hashed order. The place in that order
    counts over its parts, so that however many are drawn, no task holds them all. Too small a pool is an error; columns that
    one side lacks are null."""
    wanted = times * cases.count()
    fresh = pool.join(cases.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    placed = ranked(fresh.withColumn("_class", F.lit(1)), "_class", key, seed)
    found = placed.select(F.max("_all")).first()[0] or 0
    if found < wanted:
        raise ValueError(f"the pool has {found} rows that are no cases, {wanted} are wanted")
    drawn = placed.where(F.col("_rank") <= wanted).drop("_class", "_rank", "_all")
    return cases.withColumn(out, F.lit(0)).unionByName(drawn.withColumn(out, F.lit(1)), allowMissingColumns=True)


def two_classes_even(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class cut down to the size of the rarest."""
    return cap_majority(df, label, key, 1, seed)


def class_quota(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in equal shares over the classes; the first classes, by name, take what does not divide."""
    names = df.select(label).distinct()
    by = W.partitionBy(F.lit(1))  # one row per class
    quota = names.withColumns({"_i": F.row_number().over(by.orderBy(label)), "_k": F.count("*").over(by)})
    quota = quota.select(label, (F.floor(F.lit(n) / F.col("_k")) + (F.col("_i") <= F.pmod(F.lit(n), F.col("_k"))).cast("long")).alias("_quota"))
    return per_class(df.join(quota, label), label, key, F.col("_quota"), seed).drop("_quota")


def top_up_report(df: DataFrame, pool: DataFrame, label: str, key: str, target: int | None = None) -> DataFrame:
    """Every class of df but unknown and other: its size n, the fresh rows of pool (found), those that top_up adds (added), and
    whether pool has any (hit)."""
    fresh = pool.join(df.select(key), key, "left_anti").groupBy(label).agg(F.count("*").alias("found"))
    out = _class_sizes(df, label, target).withColumnRenamed("_n", "n").join(fresh, label, "left")
    out = out.withColumn("found", F.coalesce("found", F.lit(0)))
    added = F.least("found", F.greatest(F.col("_to") - F.col("n"), F.lit(0)))
    return out.withColumns({"added": added, "hit": F.col("found") > 0}).drop("_to")


def distinct_samples(df: DataFrame, label: str, key: str, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of every class, no two of a class alike in columns: of such rows the one of the largest key stands."""
    return per_class(keep_last(df, [label, *columns], [F.desc(key)]), label, key, n, seed)
