"""Links lie by the side that has more ids before they become a graph."""

from pyspark.sql import functions as F

from tabulon.operators import cluster


def test_links_of_one_id_lie_together(spark, monkeypatch):
    class Fake:
        def __init__(self, **_):
            pass

        def assignClusters(self, edges):
            return edges

    monkeypatch.setattr(cluster, "PowerIterationClustering", Fake)
    links = spark.range(4000).select((F.col("id") % 7).alias("src"), (F.col("id") % 400 + 100).alias("dst"), F.lit(1.0).alias("weight"))
    for edges, many in ((links, "dst"), (links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "src")):
        out = cluster.spectral(edges, 3)
        assert out.count() == 4000
        spread = out.select(many, F.spark_partition_id().alias("p")).groupBy(many).agg(F.count_distinct("p").alias("n"))
        assert spread.agg(F.max("n")).first()[0] == 1
