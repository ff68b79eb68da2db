"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

Of every run of SPAN bytes one position is an anchor: that of its least 16-byte hash (winnowing). Equal runs have equal anchors,
so that suffixes need to be sorted at anchors only. A batch's suffix array is its anchors sorted by their first 16 bytes;
it is merge-scanned with the levels before it, and levels of equal size merge. Ties, prefixes that several texts have, are
then refined by the bytes around them, which may lie on both sides of an anchor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, read_table, small_batches, text_bytes, tidy
from .line_runs import _batches, even

GRAM = 16
_PIECE = 8 << 20


def anchors(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie back to back (offsets at): position, first and last start of the runs it stands for."""
    n, low = len(data), np.uint64((1 << 24) - 1)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    found = []
    for begin in range(0, n - span + 1, _PIECE):
        h = data[begin : begin + _PIECE + span - 1].astype(np.uint64)
        step, base = 1, 0x9E3779B97F4A7C15
        while step < GRAM:
            h = h[:-step] * np.uint64(base) + h[step:]
            base, step = base * base & 0xFFFFFFFFFFFFFFFF, step * 2
        h = mix64(h)
        h = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost
        width, size = span - GRAM + 1, 1
        while size * 2 <= width:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        if size < width:
            h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
        start = np.flatnonzero(doc[begin : begin + len(h)] == doc[begin + span - 1 : begin + span - 1 + len(h)])
        found.append((start + begin, (low - (h[start] & low)).astype(np.int64) + begin))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)]))
    return pos[first], start[first], start[np.append(first[1:], len(start)) - 1]


def prefixes(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The 16 bytes from each position on as two longs whose order is that of the bytes."""
    grams = np.ascontiguousarray(data[pos[:, None] + np.arange(GRAM)]).view(">u8").astype(np.uint64)
    return (grams ^ np.uint64(1 << 63)).view(np.int64)


def suffix_rows(docs: DataFrame, span: int) -> DataFrame:
    """Of docs(v, text): (p1, p2, v), the prefix at every anchor of every distinct text v, mostly once for each task that meets
    the text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in small_batches(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            codes = batch.column("v").to_pylist()
            new = np.zeros(len(codes), bool)
            for i, v in enumerate(codes):
                if v not in met:
                    new[i] = True
                    if len(met) >= 100_000:
                        met.clear()
                    met.add(v)
            pos, _, _ = anchors(data, at, span)
            doc = np.searchsorted(at, pos, "right") - 1
            keep = new[doc]
            p, v = prefixes(data, pos[keep]), np.array(codes, np.int64)[doc[keep]]
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1])), pa.array(v)], names=["p1", "p2", "v"])

    return docs.select("v", "text").mapInArrow(run, "p1 long, p2 long, v long")


class Levels:
    """Sorted arrays of (p1, p2, v) with one v for each prefix; two of one level become one of the next, in one write for all
    levels that fill up at once."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []

    def all(self) -> list[DataFrame]:
        return [x for x in self.levels if x is not None]

    def add(self, rows: DataFrame) -> None:
        """rows: one for each prefix that no level has, of a written table that discard() may delete with the level."""
        at, old, own = 0, [], rows
        while at < len(self.levels) and self.levels[at] is not None:
            old.append(self.levels[at])
            self.levels[at], at = None, at + 1
        if at == len(self.levels):
            self.levels.append(None)
        for other in old:
            rows = rows.union(other)
        if old:
            rows = materialize(rows.repartition("p1", "p2").sortWithinPartitions("p1", "p2"), "level")
            discard(own, *old)
        self.levels[at] = rows


def merge_scan(rows: DataFrame, every: bool = False) -> DataFrame:
    """The rows whose prefix several texts have (shared), by one pass over sorted rows; one row is carried from batch to batch.
    every: rows have old too (they are of a level); all distinct rows return, with shared, and head for one row of each prefix
    that no level has."""
    names = ["p1", "p2", "v"]
    order = ["p1", "p2", *[F.desc("old")] * every, "v"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)] * every, False

        def put(columns, shared, head):
            if every:
                arrays = [pa.array(c) for c in (*columns[:3], shared, head & ~columns[3])]
            else:
                arrays = [pa.array(c[shared]) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, names=names + ["shared", "head"] * every)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
            new = np.concatenate([[True], ~(same & (columns[2][1:] == columns[2][:-1]))])
            columns = [c[new] for c in columns]
            same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
            head = ~np.concatenate([[joined], same])
            shared = ~head
            shared[:-1] |= same
            held, joined = [c[-1:] for c in columns], bool(shared[-1])
            if len(head) > 1:
                yield put([c[:-1] for c in columns], shared[:-1], head[:-1])
        if len(held[0]):
            yield put(held, np.array([joined]), np.array([not joined]))

    schema = "p1 long, p2 long, v long" + ", shared boolean, head boolean" * every
    return rows.select(*names, *["old"] * every).repartition("p1", "p2").sortWithinPartitions(*order).mapInArrow(run, schema)


ROWS = "p1 long, p2 long, doc_id long, tag long, start long, stop long, hot boolean, body binary"
NAMES = ["p1", "p2", "doc_id", "tag", "start", "stop", "hot", "body"]
OUT = ["what", "doc_id", "tag", "a", "b", "body"]


def contents(texts: DataFrame, span: int) -> DataFrame:
    """texts(doc_id, tag, text, shared: the prefixes in question, each with hot) to rows of ROWS: body has the bytes of all runs
    that the anchor stands for. Bodies that the task has met in a smaller id are settled here: they make rows without body,
    joined where they touch. Those, and bodies of hot prefixes, go to a place drawn from the id, so that what is very common
    does not meet in one task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        as_key = lambda x: mix64(x[:, 0].view(np.uint64) * np.uint64(3) + mix64(np.ascontiguousarray(x[:, 1]).view(np.uint64) + mix64(np.ascontiguousarray(x[:, 2]).view(np.uint64))))
        for batch in small_batches(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            pos, first, last = anchors(data, at, span)
            if not len(pos):
                continue
            p = prefixes(data, pos)
            doc = np.searchsorted(at, pos, "right") - 1
            lists = batch.column("shared")
            flat = lists.flatten()
            wanted = as_key(np.column_stack([flat.field("p1").to_numpy(), flat.field("p2").to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64))
            hot = flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            own_keys = as_key(np.ascontiguousarray(np.column_stack([p, doc]).astype(np.int64)))
            keep = np.flatnonzero(np.isin(own_keys, wanted))
            if not len(keep):
                continue
            is_hot = np.isin(own_keys[keep], wanted[hot])
            whole = data.tobytes()
            ids, tags, base = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), at[doc[keep]].tolist()
            rows = []
            for d, q1, q2, a, b, z, h in zip(doc[keep].tolist(), p[keep, 0].tolist(), p[keep, 1].tolist(), first[keep].tolist(), (last[keep] + span).tolist(), base, is_hot.tolist(), strict=True):
                body, own, tag = whole[a:b], ids[d], tags[d]
                if least.get(body, own) < own:
                    if rows and rows[-1][7] is None and rows[-1][2] == own and rows[-1][3] == tag and rows[-1][5] >= a - z:
                        rows[-1][5] = max(rows[-1][5], b - z)
                    else:
                        rows.append([own, tag, own, tag, a - z, b - z, False, None])
                    continue
                if len(least) >= 50_000:
                    least.clear()
                least[body] = own
                rows.append([own, a - z, own, tag, a - z, b - z, True, body] if h else [q1, q2, own, tag, a - z, b - z, False, body])
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.bool_() if i == 6 else pa.binary()) for i, c in enumerate(columns)], names=NAMES)

    return texts.select("doc_id", "tag", "text", "shared").mapInArrow(run, ROWS)


def repeats(rows: DataFrame, span: int, limit: int = 300_000) -> DataFrame:
    """Of ROWS: (doc_id, tag, a, b) for bytes a to b that runs from smaller ids cover (what 0).

    Rows come sorted by prefix and id. The runs of one prefix are kept in memory, limit at most: beyond it they are put out
    (what 2, body a run, with the smallest id that has it), and so are the bodies that follow, and those of hot prefixes
    (what 1), to be grouped by run."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, whole, over, first = None, {}, {}, False, None  # first: a prefix's only body so far, not yet in seen
        for batch in batches:
            settled, crowded = pc.is_null(batch.column("body")), batch.column("hot")
            for what, rows in ((0, batch.filter(settled)), (1, batch.filter(crowded))):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, what, np.int32)), *(rows.column(c) for c in ("doc_id", "tag", "start", "stop", "body"))], names=OUT)
            batch = batch.filter(pc.invert(pc.or_(settled, crowded)))
            out: list[tuple] = []
            for tag, (p1, p2, doc, start, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "doc_id", "start", "body")), strict=True)):  # tag: by its row
                if (p1, p2) != key:
                    key, seen, whole, over, first = (p1, p2), {}, {}, False, None
                    whole[body], first = doc, (body, doc)
                    continue
                if whole.get(body, doc) < doc:
                    out.append((0, doc, tag, start, start + len(body), None))
                    continue
                if len(whole) < limit:
                    whole.setdefault(body, doc)
                if over:
                    out.append((1, doc, tag, start, start + len(body), body))
                    continue
                if first:
                    seen, first = dict.fromkeys([first[0][i : i + span] for i in range(len(first[0]) - span + 1)], first[1]), None
                own = [body[i : i + span] for i in range(len(body) - span + 1)]
                if seen.keys().isdisjoint(own):
                    seen.update(dict.fromkeys(own, doc))
                else:
                    begin = end = -1
                    for i in [i for i, w in enumerate(own) if seen.setdefault(w, doc) < doc]:
                        if begin >= 0 and i <= end:
                            end = i + span
                        else:
                            if begin >= 0:
                                out.append((0, doc, tag, start + begin, start + end, None))
                            begin, end = i, i + span
                    if begin >= 0:
                        out.append((0, doc, tag, start + begin, start + end, None))
                if len(seen) > limit:
                    over = True
                    out += [(2, d, None, 0, span, w) for w, d in seen.items()]
                    seen = {}
            if out:
                what, doc, at, a, b, body = zip(*out, strict=True)
                tag = pc.fill_null(batch.column("tag").take(pa.array(at, pa.int32())), 0)
                yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(doc, pa.int64()), tag, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(body, pa.binary())], names=OUT)

    rows = rows.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "doc_id", "start")
    return rows.mapInArrow(run, "what int, doc_id long, tag long, a long, b long, body binary")


def grouped_runs(rest: DataFrame, span: int) -> DataFrame:
    """The same for the rows that repeats() put out, run by run (known by two hashes) with partial aggregation."""
    part = lambda i: F.substring("body", i, F.lit(span))
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("body") - span + 1), lambda i: F.struct(F.xxhash64(part(i)).alias("r1"), F.xxhash64(F.lit(7), part(i)).alias("r2"))))
    runs = rest.select("what", "doc_id", "tag", "a", at.alias("i", "run")).select("what", "doc_id", "tag", (F.col("a") + F.col("i")).alias("a"), "run.r1", "run.r2")
    # written first, so that the join is one that Spark splits where a run is very common
    least = materialize(runs.groupBy("r1", "r2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "least")
    return runs.where("what = 1").join(least, ["r1", "r2"]).where("least < doc_id").select("doc_id", "tag", "a", (F.col("a") + span).alias("b"))


def schedule(rows: int, rows_a_batch: int) -> list[float]:
    """Where batches end: an eighth, an eighth, a quarter, a half, so that later batches scan no more rows in levels than they bring;
    equal batches of rows_a_batch where half of the rows are more than that."""
    return [1 / 8, 1 / 4, 1 / 2] if rows <= 2 * rows_a_batch else even(-(-rows // rows_a_batch))


def cut_repeats(docs: DataFrame, span: int = 50, batches: int | None = None, limit: int = 300_000, hot: int = 10_000, rows_a_batch: int = 100_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay).

    A byte goes if a run of span bytes over it also starts in a document of a smaller id. Null text is empty. Rows with a null
    id keep all their bytes and take none from others; rows that repeat an id are one document, each with its own text. Prefixes
    that more than hot texts have are settled run by run instead of in one task. There are four batches or more, see
    schedule(), so that levels merge and are read again."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"v": F.xxhash64("text"), "w": F.xxhash64(F.lit(7), "text")})
    known = docs.where("doc_id is not null")
    codes = known.select("doc_id", "v", "w", F.octet_length("text").alias("n"))
    heads = materialize(codes.where(F.col("n") >= span).groupBy("v", "w").agg(F.min("doc_id").alias("head")), "heads")
    taken = [r[0] for r in heads.groupBy("v").count().where("count > 1").select("v").collect()]  # equal hashes of different texts: next to none
    if taken:  # there the second hash takes the place of the first
        second = F.when(F.col("v").isin(taken), F.col("w")).otherwise(F.col("v"))
        docs, known, codes, heads = (x.withColumn("v", second) for x in (docs, known, codes, heads))
    # ids that have several texts: these are told apart by a tag, their code
    several = heads.groupBy("head").count().where("count > 1").select("head", F.lit(True).alias("several"))
    heads = materialize(heads.join(several, "head", "left").select("v", "w", "head", F.when(F.col("several"), F.col("v")).otherwise(F.lit(0)).alias("tag")), "heads")
    levels, shared = Levels(), []
    ranges = _batches(known, even(batches) if batches else schedule(known.count(), rows_a_batch))
    for k, batch in enumerate(ranges):
        scan = suffix_rows(known.where(batch), span).withColumn("old", F.lit(False))
        for level in levels.all():
            scan = scan.union(level.withColumn("old", F.lit(True)))
        if k + 1 == len(ranges):
            shared.append(materialize(merge_scan(scan), "shared"))
        else:
            seen = materialize(merge_scan(scan, True), "suffixes")
            shared.append(materialize(seen.where("shared").select("p1", "p2", "v"), "shared"))
            fresh = seen.where("head").select("p1", "p2", "v")
            fresh._written_at = seen._written_at
            levels.add(fresh)
    discard(*levels.all())
    prefix = shared[0]
    for x in shared[1:]:
        prefix = prefix.union(x)
    crowded = materialize(prefix.groupBy("p1", "p2").count().where(F.col("count") > hot).select("p1", "p2", F.lit(True).alias("hot")), "crowded")
    prefix = prefix.join(crowded, ["p1", "p2"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = prefix.groupBy("v").agg(F.collect_set(F.struct("p1", "p2", "hot")).alias("shared"))
    wanted = materialize(wanted.join(heads, "v").select(F.col("head").alias("doc_id"), "v", "tag", "shared"), "wanted")
    discard(*shared, crowded)
    bodies = contents(known.select("doc_id", "v", "text").join(wanted, ["doc_id", "v"]), span)
    found = materialize(repeats(bodies, span, limit), "repeats")
    spans = found.where("what = 0").select("doc_id", "tag", "a", "b")
    rest = found.where("what > 0")
    if not rest.isEmpty():
        spans = spans.union(grouped_runs(rest, span))
    spans = spans.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    spans = spans.join(wanted.select("doc_id", "v", "tag"), ["doc_id", "tag"]).select("doc_id", "v", "spans")
    copies = codes.join(heads, ["v", "w"]).where("doc_id <> head").select("doc_id", "v", F.lit(True).alias("copy")).distinct()
    facts = spans.join(copies, ["doc_id", "v"], "full")
    return apply_spans(docs.join(facts, ["doc_id", "v"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans"))


def apply_spans(rows: DataFrame) -> DataFrame:
    """Cuts spans (a, b), sorted by a, out of the UTF-8 bytes; a copy loses all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            whole = data.tobytes()
            out = []
            for i, (copy, spans) in enumerate(zip(batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                text = whole[at[i] : at[i + 1]]
                if copy:
                    spans = [{"a": 0, "b": len(text)}] if text else []
                kept, end, removed, n = [], 0, 0, 0
                for s in spans or ():
                    a, b = s["a"], s["b"]
                    if n and a <= end:
                        removed += max(0, b - end)
                        end = max(end, b)
                    else:
                        kept.append(text[end:a])
                        n, removed, end = n + 1, removed + b - a, b
                kept.append(text[end:])
                out.append((len(text), removed, n, b"".join(kept)))
            n, removed, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
