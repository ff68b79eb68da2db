"""Written blocks of counts: a scan holds a row group at once, so that it must not grow with a task's input."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tabulon.llm import resample


def test_blocks_are_read_by_small_row_groups(spark, monkeypatch):
    written, plain = [], resample.materialize
    monkeypatch.setattr(resample, "materialize", lambda *args: written.append(plain(*args)) or written[-1])
    monkeypatch.setattr(resample, "BLOCK_ENTRIES", 1)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda k: F.xxhash64("id", k).cast("string")), " ")
    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    target = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resample.resample(docs, target).count() == 300
    files = [pq.ParquetFile(p).metadata for p in Path(written[0]._written_at.removeprefix("file://")).glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 300
    assert max(f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 2 << 20
