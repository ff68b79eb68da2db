"""Tables between the rounds of an operator, written in the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written and read again: its lineage ends here, so that a lost executor costs no earlier round."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every vertex of a list of links: the least vertex it reaches.

    Each round, every root takes the least root that a link of its tree leads to, and vertices skip to their root's root until
    that changes nothing; links inside a tree are left out of the next round. A table is written per round; the number of trees
    at least halves in each, so that their number is logarithmic."""
    links = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), "links")
    roots = written(links.select("x").union(links.select("y")).distinct().select(F.col("x").alias("id"), F.col("x").alias("root")), "roots")
    while not links.isEmpty():
        both = links.union(links.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("tree"), F.least("x", "y").alias("to"))
        parents = written(least, "parents")
        while True:  # every tree to the root of its chain
            up = parents.join(parents.select(F.col("tree").alias("to"), F.col("to").alias("next")), "to").select("tree", F.col("next").alias("to"))
            before, parents = parents, written(up, "parents")
            moved = not parents.exceptAll(before).isEmpty()
            drop(before)
            if not moved:
                break
        own = roots.join(parents.withColumnRenamed("tree", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        other = links.join(parents.select(F.col("tree").alias("x"), F.col("to").alias("p")), "x").join(parents.select(F.col("tree").alias("y"), F.col("to").alias("q")), "y")
        old = [links, roots, parents]
        roots, links = written(own, "roots"), written(other.where("p <> q").select(F.col("p").alias("x"), F.col("q").alias("y")).distinct(), "links")
        drop(*old)
    return roots
