"""Incremental ingest: micro-batches are made canonical, deduplicated and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.canonical import canonicalize
from ..operators.sampling import per_class


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, code: str, top_up: int | None = None) -> StreamingQuery:
    """Reads new files of source, makes code canonical, drops rows whose key the batch or an earlier batch had, and appends to
    target. A batch that is run again after a failure replaces what it wrote before, as its number is a partition.

    Keys that were seen stand in the stream's state store, and the sizes of classes in a small table per batch beside the
    checkpoint; no batch reads the target, so that its cost follows its own rows. top_up: after the first batch, a batch gives no
    class more rows than bring it to so many, and nothing to unknown and other."""
    sizes_at = f"{checkpoint}-sizes"

    def write(batch: DataFrame, number: int) -> None:
        rows, own = batch, batch.sparkSession
        before = own.read.schema(f"{code} string, _n long").parquet(f"{sizes_at}/batch={number - 1}") if number else None
        if number and top_up is not None:
            lack = F.when(F.col(code).isin("unknown", "other"), 0).otherwise(F.greatest(F.lit(top_up) - F.coalesce("_n", F.lit(0)), F.lit(0))).cast("int")
            rows = per_class(rows.join(before, code, "left").withColumn("_lack", lack), code, key, F.col("_lack")).drop("_n", "_lack")
        path = f"{target}/batch={number}"
        rows.select(*batch.columns).write.mode("overwrite").parquet(path)
        added = own.read.schema(batch.schema).parquet(path).groupBy(code).agg(F.count("*").alias("_n"))
        all_sizes = added if before is None else added.unionByName(before).groupBy(code).agg(F.sum("_n").alias("_n"))
        all_sizes.write.mode("overwrite").parquet(f"{sizes_at}/batch={number}")

    stream = canonicalize(spark.readStream.schema(schema).parquet(source), code).dropDuplicates([key])
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and time window; rows later than late are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
