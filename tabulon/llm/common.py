"""Shared helpers of the corpus operators: tables, scratch space, Arrow text access, bitmaps, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tabulon.scratch", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tabulon-')}"
        spark.conf.set("spark.tabulon.scratch", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabulon/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "step", row_group: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back. The write's own shuffle files, which
    nothing needs any more, go when it ends. row_group: bytes of a row group, for tables of few large rows, as a scan holds
    the rows of a group (up to 4096) in memory at once."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.options(**{"parquet.block.size": row_group, "parquet.block.size.row.check.min": 8}) if row_group else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for table in tables:
        if not hasattr(table, "_written_at"):
            continue
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back, and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[at[0] : at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def tidy(run: Callable) -> Callable:
    """Wraps a function of Arrow batches: what a task needed goes back to the system at its end, as workers live on."""

    @wraps(run)
    def tidied(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def grown(array: np.ndarray, used: int, fresh: np.ndarray) -> np.ndarray:
    """array with fresh behind its first used places; its room doubles where it is too small."""
    if used + len(fresh) > len(array):
        array, old = np.empty(max(2 * len(array), used + len(fresh)), fresh.dtype), array
        array[:used] = old[:used]
    array[used : used + len(fresh)] = fresh
    return array


class ChunkTable:
    """Rows of numbers that describe words, worked out once per word: texts repeat their words. Beyond max_bytes (an estimate of
    what its words take) only words that came more than once stay, up to half of that, between two calls of rows()."""

    WORD = 200  # bytes of a short word with its place in the table

    def __init__(self, describe: Callable[[list], list[np.ndarray]], max_bytes: int = 64 << 20, thinned: Callable[[], None] | None = None):
        self.describe, self.max_bytes, self.thinned = describe, max_bytes, thinned
        self.clear()

    def clear(self) -> None:
        self.at, self.columns, self.seen, self.taken = {}, [], np.zeros(0, np.int64), 0

    def _add(self, new: list) -> None:
        size, fresh = len(self.at), self.describe(new)
        self.columns = [grown(c, size, x) for c, x in zip(self.columns, fresh, strict=True)] if self.columns else fresh
        self.seen = grown(self.seen, size, np.zeros(len(new), np.int64))
        self.at.update(zip(new, range(size, size + len(new)), strict=True))
        self.taken += self.WORD * len(new) + sum(map(len, new))

    def thin(self, most: int) -> None:
        """Keeps words that came more than once, the most frequent ones, up to most bytes."""
        words, seen = list(self.at), self.seen[: len(self.at)]
        order = np.argsort(-seen, kind="stable")[: most * len(words) // max(1, self.taken)]
        order = order[seen[order] > 1]
        own = [words[i] for i in order.tolist()]
        columns = [c[order] for c in self.columns]
        self.clear()
        if own:
            self.columns, self.seen = columns, np.zeros(len(own), np.int64)
            self.at = dict(zip(own, range(len(own)), strict=True))
            self.taken = self.WORD * len(own) + sum(map(len, own))
        if self.thinned:
            self.thinned()

    def rows(self, words: list) -> np.ndarray:
        """The row of every word; columns[k][rows] are its numbers (columns may have room behind the last row)."""
        if self.taken > self.max_bytes:
            self.thin(self.max_bytes // 2)
        get = self.at.get
        out = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing) or not self.columns:
            self._add(list(dict.fromkeys(words[i] for i in missing)))
            out[missing] = [self.at[words[i]] for i in missing]
        self.seen[: len(self.at)] += np.bincount(out, minlength=len(self.at))
        return out


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width codes (none if there are fewer)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return mix64(h)


BLOCK = 1 << 16


def bitmap(keys: DataFrame, column: str, bits: int) -> bytes:
    """A Bloom bitmap of fixed size (bits, a power of two from 65536) over a column of well mixed longs, two bits a key.

    Blocks are built on the executors; only the finished bitmap, bits / 8 bytes whatever the input, reaches the driver.
    """
    blocks = bits // BLOCK
    slots = keys.select(F.explode(F.array(F.pmod(column, F.lit(bits)), F.pmod(F.shiftrightunsigned(column, 24), F.lit(bits)))).alias("slot")).distinct()

    def build(key, rows):
        import pandas as pd

        flags = np.zeros(BLOCK, np.uint8)
        flags[rows["slot"].to_numpy() % BLOCK] = 1
        return pd.DataFrame({"block": [key[0]], "flags": [np.packbits(flags).tobytes()]})

    found = slots.groupBy(F.floor(F.col("slot") / BLOCK).cast("int").alias("block")).applyInPandas(build, "block int, flags binary").collect()
    out = bytearray(bits // 8)
    for block, flags in found:
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = flags
    assert blocks * BLOCK == bits
    return bytes(out)


def in_bitmap(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys the bitmap may hold; no false negatives."""
    packed = np.frombuffer(bits, np.uint8)
    mask = np.uint64(8 * len(packed) - 1)

    def flag(slots: np.ndarray) -> np.ndarray:
        slots = slots & mask
        return packed[(slots >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1)

    return (flag(keys) & flag(keys >> np.uint64(24))).astype(bool)


def bitmap_bits(keys: int, most: int = 1 << 28) -> int:
    """How many bits a bitmap of so many keys gets: 16 a key or more as far as most allows, a bound that stays (32 MB)."""
    bits = BLOCK
    while bits < min(16 * keys, most):
        bits *= 2
    return bits


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (id, component), the smallest id each vertex reaches.

    Alternates large-star and small-star steps, each a grouping with partial aggregation; a written table cuts the lineage
    after every round. Vertices without edges do not appear.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    spark = edges.sparkSession
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, links = links, materialize(small.where("u <> v").distinct(), "links")
        discard(last)
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    out = materialize(roots.select(F.col("u").alias("id"), "component").union(roots.select(F.col("component").alias("id"), "component").distinct()), "components")
    discard(links)
    return out
