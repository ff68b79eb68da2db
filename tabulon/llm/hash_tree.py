"""Sharding by a hierarchical weighted hash tree: each document descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read_table


@dataclass(frozen=True)
class Tree:
    """Leaves (region, rack, shard, weight). A node weighs what its leaves weigh; shard numbers are unique."""

    leaves: tuple[tuple[int, int, int, float], ...]

    @classmethod
    def regular(cls, shards: int, per_rack: int = 5, racks: int = 2) -> Tree:
        """Regions of racks x per_rack shards of weight 1."""
        return cls(tuple((i // (per_rack * racks), i // per_rack, i, 1.0) for i in range(shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: rows move only into it, as no other subtree changes weight."""
        top = [max(x[i] for x in self.leaves) + 1 for i in range(3)]
        return Tree((*self.leaves, (top[0], top[1], top[2], weight)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        """Rows move only between the subtrees above this shard and the rest; below unchanged nodes draws stay."""
        return replace(self, leaves=tuple((*x[:3], weight) if x[2] == shard else x for x in self.leaves))

    def children(self, level: int) -> dict[int, list[tuple[int, float]]]:
        """Parent at level - 1 (-1 for the root) to its (child, weight)."""
        out: dict[int, dict[int, float]] = {}
        for leaf in self.leaves:
            parent = leaf[level - 1] if level else -1
            out.setdefault(parent, {})[leaf[level]] = out.get(parent, {}).get(leaf[level], 0.0) + leaf[3]
        return {p: sorted(c.items()) for p, c in out.items()}


def _draw(key: str, level: int, nodes: Column) -> Column:
    """The node with the least -ln(u) / weight, u from the hash of key, level and node: chosen in proportion to weight,
    and another node's weight never changes this node's draw."""
    # 52 bits of the hash, kept off 0 and 1
    u = lambda n: (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(level), n["id"]), 12).cast("double") + 0.5) / float(1 << 52)
    return F.array_min(F.transform(nodes, lambda n: F.struct((-F.log(u(n)) / n["w"]).alias("score"), n["id"].alias("id"))))["id"]


def shard_of(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Adds the shard of every row: a projection, no shuffle."""
    nodes = lambda kids: F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("w")) for i, w in kids])
    names = [f"_{out}_{i}" for i in range(3)]
    for level in range(3):
        kids = tree.children(level)
        choice = nodes(kids[-1]) if level == 0 else F.element_at(F.create_map(*[x for p, c in sorted(kids.items()) for x in (F.lit(p), nodes(c))]), F.col(names[level - 1]))
        df = df.withColumn(names[level], _draw(key, level, choice))
    return df.withColumn(out, F.col(names[2])).drop(*names)


def number_slots(df: DataFrame, group: str, order: list[str], out: str = "slot", per_bucket: int = 50_000) -> DataFrame:
    """Numbers the rows of every group from 0 without a gap, in hashed buckets of about per_bucket rows, so that no task
    sorts a whole group: counts by (group, bucket) give each bucket its first number."""
    total, groups = df.agg(F.count("*"), F.approx_count_distinct(group)).first()
    buckets = max(16, int(total // (max(1, groups) * per_bucket)) + 1)
    spread = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = spread.groupBy(group, "_b").agg(F.count("*").alias("_n"))  # groups x buckets rows
    first = counts.withColumn("_first", F.sum("_n").over(W.partitionBy(group).orderBy("_b")) - F.col("_n")).drop("_n")
    within = F.row_number().over(W.partitionBy(group, "_b").orderBy(*order)) - 1
    return spread.withColumn("_i", within).join(first, [group, "_b"]).withColumn(out, (F.col("_first") + F.col("_i")).cast("long")).drop("_b", "_i", "_first")


def shard_documents(docs: DataFrame, tree: Tree) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty, a very long one is only measured; a null id draws like any other key; repeated ids share a shard
    and get slots of their own; other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = shard_of(shard_of(rows, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    rows = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), Tree.regular(40))
