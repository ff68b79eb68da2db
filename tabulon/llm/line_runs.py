"""Line dedup with levelled sorted runs of line hashes: every batch anti-joins the runs, then adds a run of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, materialize, read_table

HASH = ["h1", "h2"]


class Runs:
    """Sorted runs of (h1, h2) in levels; fanout runs of one level are compacted into one of the next, in one write for all
    levels that fill up at once."""

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels = fanout, []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, run: DataFrame) -> None:
        level, old = 0, []
        while level < len(self.levels) and len(self.levels[level]) + 1 >= self.fanout:
            old, self.levels[level], level = old + self.levels[level], [], level + 1
        if level == len(self.levels):
            self.levels.append([])
        for other in old:
            run = run.union(other)
        self.levels[level].append(materialize(run.repartition(*HASH).sortWithinPartitions(*HASH), "run"))
        discard(*old)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _batches(docs: DataFrame, shares: list[float]) -> list[Column]:
    """Conditions that cut the documents into ranges of ascending id that end at these shares of them; null ids come first."""
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares)).first()[0] or [])) if shares else []
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        c = F.lit(True)
        if low is not None:
            c = c & (F.col("doc_id") > low)
        if high is not None:
            c = c & (F.col("doc_id") <= high)
        out.append(c if low is not None else c | F.col("doc_id").isNull())
    return out


def even(batches: int) -> list[float]:
    return [i / batches for i in range(1, batches)]


def batch_count(docs: DataFrame, fanout: int, rows_a_batch: int = 100_000_000) -> int:
    """So many batches that two levels are compacted and read again, and more where a batch would be very large."""
    return max(2 * fanout + 1, -(-docs.count() // rows_a_batch))


TEXT = ["doc_id", "t1", "t2"]


def repeated_lines(docs: DataFrame, batches: int, min_chars: int = 10, fanout: int = 2) -> DataFrame:
    """(doc_id, t1, t2, pos) of every line to drop: its key has min_chars or more code points and a smaller doc_id holds it too.
    t1 and t2 are hashes of the text, as several texts may have one id.

    Null ids sort first and are never dropped against each other."""
    lines = docs.select(*TEXT, F.posexplode(line_array(F.col("text"))).alias("pos", "line")).select(*TEXT, "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    lines = lines.select(*TEXT, "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    runs, drops, ranges = Runs(fanout), [], _batches(docs, even(batches))
    for n, batch in enumerate(ranges):
        here = lines.where(batch)
        keys = here.groupBy(*HASH).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("null_id"))
        for i, run in enumerate(runs.all()):
            keys = keys.join(run.withColumn(f"in{i}", F.lit(True)).hint("merge"), HASH, "left")
        seen = F.lit(False)
        for i in range(len(runs.all())):
            seen = seen | F.col(f"in{i}").isNotNull()
        keys = materialize(keys.select(*HASH, "first", "last", "null_id", seen.alias("seen")), "keys")
        repeated = keys.where("seen or first < last or (null_id and first is not null)").select(*HASH, F.when(~F.col("seen") & ~F.col("null_id"), F.col("first")).alias("keeper"))
        drops.append(materialize(here.join(repeated, HASH).where("doc_id is not null and (keeper is null or doc_id <> keeper)").select(*TEXT, "pos"), "drops"))
        if n + 1 < len(ranges):
            runs.add(keys.where("not seen").select(*HASH))
        discard(keys)
    discard(*runs.all())
    out = drops[0]
    for d in drops[1:]:
        out = out.union(d)
    return out


def dedup_lines(docs: DataFrame, batches: int | None = None, min_chars: int = 10, fanout: int = 2) -> DataFrame:
    """All columns of docs, with text the kept lines joined by a line feed, plus n_lines and n_dropped.

    Keys: lines stripped of blanks, A-Z lower-cased. A key of min_chars or more that several documents hold stays only in
    that of the smallest id, with all its lines there. Null and empty texts are one empty line. Rows that repeat an id
    are one document: they lose the same lines, and none for each other. An input column named n_lines or n_dropped is
    replaced; other columns may have any names."""
    new = ("n_lines", "n_dropped")
    others = [c for c in docs.columns if c.lower() not in (*new, "doc_id", "text")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.struct(*([f"`{c}`" for c in others] or [F.lit(0).alias("none")])).alias("others"))
    drops = repeated_lines(rows.drop("others"), batches or batch_count(rows, fanout), min_chars, fanout)
    at = drops.groupBy(*TEXT).agg(F.collect_set("pos").alias("at"))
    out = rows.join(at.hint("shuffle_hash"), TEXT, "left")
    lines = line_array(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "at")  # places are distinct and stay in order
    out = out.withColumn("lines", lines).withColumn("kept", F.when(F.col("at").isNotNull(), kept))
    out = out.withColumns({"text": F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n")), "n_lines": F.size("lines").cast("long"), "n_dropped": F.when(F.col("at").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")})
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[own.get(c.lower(), F.col("others").getField(c)).alias(c) for c in docs.columns if c.lower() not in new], *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.first, k.doc_id) = k.doc_id AS keep FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
