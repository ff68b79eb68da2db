"""Nearest-string joins and token similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.similarity import common_substring
from .jaro import closest_rows
from .metric import meet
from .steps import written


def _rare_grams(texts: DataFrame, column: str, counts: DataFrame, n: int) -> DataFrame:
    """(column, g): the n pairs of letters of each text that counts(g, n) has least, unknown ones first."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, F.lit(2)))
    grams = texts.where(F.length(column) > 1).select(column, F.explode(F.array_distinct(pairs)).alias("g")).join(counts, "g", "left")
    place = F.row_number().over(W.partitionBy(column).orderBy(F.coalesce("n", F.lit(0)), "g"))
    return grams.withColumn("_r", place).where(F.col("_r") <= n).select(column, "g")


def within(own: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(value, b): the nearest target of values that have one within most edits, found by pairs of letters: an edit changes two of
    them at most, so that such strings share one of their 2 most + 1 rarest. Values of no more pairs than 2 most are left out."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("target") - 1), lambda i: F.substring("target", i, F.lit(2)))
    counts = words.where("length(target) > 1").select(F.explode(F.array_distinct(pairs)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    long = own.where(F.length("value") > 1)
    kinds = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2))))
    long = long.where(F.size(kinds) > 2 * most)
    met = _rare_grams(long, "value", counts, 2 * most + 1).join(_rare_grams(words, "target", counts, 2 * most + 1), "g").select("value", "target").distinct()
    near = met.where(F.abs(F.length("value") - F.length("target")) <= most).withColumn("d", F.levenshtein("value", "target")).where(F.col("d") <= most)
    return near.join(words, "target").groupBy("value").agg(F.min(F.struct("d", "ord", "target")).alias("b"))


def nearest(values: DataFrame, value: str, targets: DataFrame, target: str, order: str, most: int = 20_000, distance: Callable[[Column, Column], Column] = F.levenshtein, blocked: int = 2, direct: int = 500) -> DataFrame:
    """(value, target, distance): for each distinct value the nearest of the targets, the first by order of equals.

    Exact. Up to direct targets are compared with all values at once. Beyond, by edit distance, values that have a target within blocked edits are settled by a join on shared pairs of letters; only
    the others are compared with every dictionary token. The dictionary is broadcast after its size has been checked;
    beyond most entries it is dealt out in blocks of that size, each joined in turn, and the block winners meet in one
    aggregation. Values are made distinct first, which is where the work is saved."""
    own = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    words = targets.select(F.col(target).alias("target"), F.col(order).alias("ord")).where("target is not null").groupBy("target").agg(F.min("ord").alias("ord"))
    size = words.count()
    blocks = max(1, -(-size // most))
    close = within(own, words, blocked) if distance is F.levenshtein and blocked > 0 and size > direct else None
    left = own if close is None else own.join(close, "value", "left_anti")
    found = [] if close is None else [close]
    for b in range(blocks):
        part = words if blocks == 1 else words.where(F.pmod(F.xxhash64("target"), F.lit(blocks)) == b)
        pairs = left.join(F.broadcast(part)).withColumn("d", distance(F.col("value"), F.col("target")))
        found.append(pairs.groupBy("value").agg(F.min(F.struct("d", "ord", "target")).alias("b")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = out.groupBy("value").agg(F.min("b").alias("b")) if blocks > 1 else out
    return out.select("value", F.col("b.target").alias("target"), F.col("b.d").alias("distance"))


def nearest_jaro_winkler(values: DataFrame, value: str, targets: DataFrame, target: str, order: str, scores: tuple[float, ...] = (0.9, 0.75), block: int = 10_000, other: int = 100_000) -> DataFrame:
    """(value, target, distance): for each distinct value the target of the highest Jaro-Winkler score, the first by order of
    equals; distance is 1 less the score, to nine digits.

    Exact. Blocks of values meet blocks of targets; within, pairs are taken by the most that their shared letters and first letters
    allow, and a value is settled once nothing left can be as near as its best. Scores are the steps in which bounds are looked
    through. With several blocks of targets, a first pass over the highest bounds gives every value a best that all of its blocks
    go by. Values that share no letter with any target have the first target at distance 1."""
    own = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    words = targets.select(F.col(target).alias("target"), F.col(order).alias("ord")).where("target is not null").groupBy("target").agg(F.min("ord").alias("ord"))
    words = written(words.withColumn("cell", F.pmod(F.xxhash64("target"), F.lit(1))), "words")
    size = words.count()
    if not size:
        return own.select("value", F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("distance"))
    kind = words.schema["ord"].dataType.simpleString()
    rows = written(own.select("value", F.lit(None).cast("double").alias("start"), F.pmod(F.xxhash64("value"), F.lit(1)).alias("cell")), "values")

    def best(rows: DataFrame, top_only: bool) -> DataFrame:
        run = lambda a, b: closest_rows(a, b, scores, top_only)
        found = meet(rows, words, "cell", ("value", "target"), run, f"value string, d double, ord {kind}, target string", block, other)
        return found.groupBy("value").agg(F.min(F.struct("d", "ord", "target")).alias("b"))

    if size > other:
        rows = written(best(rows, True).select("value", F.col("b.d").alias("start"), F.pmod(F.xxhash64("value"), F.lit(1)).alias("cell")), "starts")
    return best(rows, False).select("value", F.col("b.target").alias("target"), F.col("b.d").alias("distance"))


def reexpress(values: DataFrame, value: str, abbreviations: DataFrame) -> DataFrame:
    """(value, text): every token of the value replaced by the expansion of its nearest token in abbreviations(token,
    expansion, ord), unless their first letters differ."""
    own = values.select(F.col(value).alias("value")).distinct()
    tokens = own.select("value", F.posexplode(F.split("value", " ")).alias("pos", "tok"))
    near = nearest(tokens, "tok", abbreviations, "token", "ord").select(F.col("value").alias("tok"), F.col("target").alias("token"))
    mapped = tokens.join(near.join(abbreviations.select("token", "expansion"), "token"), "tok", "left")
    new = F.when(F.substring("tok", 1, 1) == F.substring("expansion", 1, 1), F.col("expansion")).otherwise(F.col("tok"))
    return mapped.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("t")))).alias("p")).select("value", F.array_join(F.transform("p", lambda s: s["t"]), " ").alias("text"))


def token_similarity(pairs: DataFrame, a: str, b: str, kernel: Callable[[Column, Column], Column], least: float = 0.8) -> DataFrame:
    """Adds similarity: the mean of the best pair scores of the tokens of a and b, as many as b has tokens.

    Gates first, kernel last: a numeric token scores only itself; one letter against another first letter scores 0; so do
    tokens whose common substring is under least of the shorter one. A lone hit of a one-letter token of a scores 0."""
    own = pairs.select(a, b).distinct()
    split = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != ""))
    cells = own.select(a, b, F.size(split(F.col(b))).alias("k"), F.explode(split(F.col(a))).alias("x")).select(a, b, "k", "x", F.explode(split(F.col(b))).alias("y"))
    number = F.col("x").rlike(r"^[0-9.]+$")
    single = (F.length("x") == 1) | (F.length("y") == 1)
    apart = single & (F.substring("x", 1, 1) != F.substring("y", 1, 1))
    overlap = common_substring(F.col("x"), F.col("y")) / F.least(F.length("x"), F.length("y"))
    cells = cells.withColumn("open", ~number & ~apart & (overlap >= least))
    words = cells.where("open").select("x", "y").distinct().withColumn("s", kernel(F.col("x"), F.col("y")))
    scored = cells.join(words, ["x", "y"], "left").withColumn("s", F.when(number, (F.col("x") == F.col("y")).cast("double")).otherwise(F.coalesce("s", F.lit(0.0))))
    top = scored.withColumn("r", F.row_number().over(W.partitionBy(a, b).orderBy(F.desc("s"), "x", "y"))).where("r <= greatest(k, 1)")
    out = top.groupBy(a, b).agg(F.avg("s").alias("similarity"), F.count_if(F.col("s") > 0).alias("hits"), F.max(F.when(F.col("s") > 0, F.length("x"))).alias("size"))
    out = out.select(a, b, F.when((F.col("hits") == 1) & (F.col("size") == 1), F.lit(0.0)).otherwise(F.col("similarity")).alias("similarity"))
    return pairs.join(out, [a, b], "left").fillna(0.0, ["similarity"])


def part_features(values: DataFrame, value: str, parts: dict[str, DataFrame], finders: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """(value, then <part>_<name> and <part>_<name>_dist): for each distinct value the nearest entry of every part's
    table(text, ord), by every finder (nearest or nearest_jaro_winkler)."""
    out = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    for part, entries in parts.items():
        for name, find in finders.items():
            near = find(values, value, entries, "text", "ord")
            out = out.join(near.select("value", F.col("target").alias(f"{part}_{name}"), F.col("distance").alias(f"{part}_{name}_dist")), "value", "left")
    return out
