"""Jaccard join of word shingles by PartEnum signatures, and the groups that its links connect.

Sets of one band of sizes that link differ in H features at most. The feature domain (64-bit shingle hashes) is cut into n1
first-level partitions of THIRDS second-level ones, n1 so large that in some first-level partition two linked sets differ in
one feature at most, that is in one second-level partition. Every subset that leaves one second-level partition out makes a
signature: the features of the others. A set that may differ in H features loses so many signatures at most, so that linked
sets share one of the fullest that they show, in an order that both know (fill, then value)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bitmap, bitmap_bits, components, discard, in_bitmap, materialize, mix64, read_table, small_batches, text_bytes, tidy, window_hashes

#: Second-level partitions of a first-level one; subsets leave one of them out.
THIRDS = 3
#: Bits of a signature that name how full it is (the fullest come first) and its band.
FILL_BITS, BAND_BITS = 6, 6


def bands(m: int, percent: int) -> range:
    """Bands (2^b to 2^(b+1) - 1 features) that hold the larger one of a pair in which a set of m features may be."""
    return range(m.bit_length() - 1, (m * 100 // percent).bit_length())


@lru_cache(maxsize=100_000)
def most_apart(m: int, band: int, percent: int) -> int:
    """The most features in which a set of m may differ from one that it links with, the larger one being of that band; -1 if
    there is none."""
    low = -(-m * percent // 100) if band == m.bit_length() - 1 else 1 << band
    other = np.arange(low, min(m * 100 // percent, (2 << band) - 1) + 1)
    common = -(-percent * (m + other) // (100 + percent))
    apart = (m + other - 2 * common)[common <= np.minimum(m, other)]
    return int(apart.max(initial=-1))


@lru_cache(maxsize=None)
def first_level(band: int, percent: int) -> int:
    """How many first-level partitions a band has: half of the most features in which any two of its sets differ, and one."""
    return 2 * ((2 << band) - 1) * (100 - percent) // (100 + percent) // 2 + 1


def shown(m: int, band: int, percent: int) -> int:
    """How many signatures a set shows: one more than it may lose. Features that differ cost two each while they lie in
    partitions of their own, and one each beyond that."""
    apart, n = most_apart(m, band, percent), first_level(band, percent)
    return min(2 * apart, n + apart) + 1 if apart >= 0 else 0


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """All signatures that a sorted set of features shows."""
    m, out = len(features), []
    for band in bands(m, percent) if m else ():
        if not (show := shown(m, band, percent)):
            continue
        size = THIRDS * first_level(band, percent)
        part = (((features >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)  # rises with the features
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, fill = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        sums[part[first]] = np.add.reduceat(features, first)
        fill[part[first]] = np.diff(np.append(first, m))
        own = mix64(sums + np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, THIRDS)
        fill = fill.reshape(-1, THIRDS)
        left = mix64((own.sum(1, keepdims=True, dtype=np.uint64) - own).ravel())
        empty = (1 << FILL_BITS) - 1 - np.minimum((fill.sum(1, keepdims=True) - fill).ravel(), (1 << FILL_BITS) - 1)
        sig = (empty.astype(np.uint64) << np.uint64(64 - FILL_BITS)) | (left >> np.uint64(FILL_BITS + BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(band)
        out.append(np.partition(sig, show - 1)[:show] if show < len(sig) else sig)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Shingles:
    """Sorted distinct shingle hashes of texts: A-Z lower-cased, words between blanks, width words each; fewer words are one.

    A word's hash is a polynomial over its bytes, taken from running sums over the whole batch, then mixed with its length."""

    BASE = 0x9E3779B97F4A7C15
    LETTERS = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
    BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

    def __init__(self, width: int):
        self.width, self.powers, self.inverse = width, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (and the end)."""
        data, at = text_bytes(column)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            steps = [np.full(size, x, np.uint64) for x in (self.BASE, pow(self.BASE, -1, 1 << 64))]
            for row in steps:
                row[0] = 1
            self.powers, self.inverse = (np.multiply.accumulate(row) for row in steps)
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        inside = ~self.BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True  # words do not go on into the next text
        begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.LETTERS[data] * self.powers[:n], dtype=np.uint64)])
        return mix64((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.searchsorted(begin, at)

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        codes, at = self._words(column)
        hashes, out, width = window_hashes(codes, self.width), [], self.width
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            out.append(np.unique(hashes[a : b - width + 1] if n >= width else window_hashes(codes[a:b], n) + np.uint64(n) if n else codes[:0]))
        return out


def set_codes(features: np.ndarray, bits: int) -> tuple[int, int]:
    """Two hashes of a whole set: the code by which it goes (of so many bits), and one that tells sets of equal codes apart."""
    a, b = int(np.add.reduce(features, dtype=np.uint64)), int(np.bitwise_xor.reduce(features))
    key = a.to_bytes(8, "little") + b.to_bytes(8, "little") + len(features).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(key) >> (64 - bits), int(np.add.reduce(mix64(features), dtype=np.uint64)) >> 1


def vertex(codes: tuple[int, int], taken: frozenset[int]) -> int:
    """A set's code, or its second one (negative) where different sets have the first."""
    return -1 - codes[1] if codes[0] in taken else codes[0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def set_rows(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """doc_id, n_shingles and the two codes of the document's set (null for an empty one)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in small_batches(batches, "text", 1 << 20):
            sets = shingles(batch.column("text"))
            codes = [set_codes(s, bits) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], *zip(*codes, strict=True)))], names=["doc_id", "n_shingles", "v", "w"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, v long, w long")


def signature_rows(docs: DataFrame, width: int, percent: int, bits: int, taken: frozenset[int]) -> DataFrame:
    """(sig, v) of every set, mostly once for each task that meets the set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = Shingles(width), set()
        for batch in small_batches(batches, "text", 1 << 20):
            sigs, codes = [], []
            for s in shingles(batch.column("text")):
                if len(s) and (v := vertex(set_codes(s, bits), taken)) not in met:
                    if len(met) >= 100_000:
                        met.clear()
                    met.add(v)
                    own = signatures(s, percent)
                    sigs.append(own)
                    codes.append(np.full(len(own), v, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), pa.array(np.concatenate(codes))], names=["sig", "v"])

    return docs.select("text").mapInArrow(run, "sig long, v long")


def shared_rows(rows: DataFrame) -> DataFrame:
    """Those (sig, v) whose sig several v have. The rows of a partition come sorted; one row is carried from batch to batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, v, joined = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether it matched the one before

        def emit(sig, v, joined, last):
            same = sig[1:] == sig[:-1]
            hit = np.concatenate([[joined], same])
            hit[:-1] |= same
            n = len(sig) if last else len(sig) - 1
            return pa.RecordBatch.from_arrays([pa.array(sig[:n][hit[:n]]), pa.array(v[:n][hit[:n]])], names=["sig", "v"]), bool(hit[-1] and same[-1]) if len(same) else joined

        for batch in batches:
            if not batch.num_rows:
                continue
            sig, v = np.concatenate([sig, batch.column("sig").to_numpy()]), np.concatenate([v, batch.column("v").to_numpy()])
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (v[1:] != v[:-1])])
            sig, v = sig[new], v[new]
            out, joined = emit(sig, v, joined, False)
            sig, v = sig[-1:], v[-1:]
            if out.num_rows:
                yield out
        if len(sig) and joined:
            yield emit(sig, v, joined, True)[0]

    return rows.repartition("sig").sortWithinPartitions("sig", "v").mapInArrow(run, "sig long, v long")


def fetch_sets(docs: DataFrame, vertices: DataFrame, width: int, bits: int, taken: frozenset[int]) -> DataFrame:
    """(v, features) of vertices(v, doc_id), worked out again from the text of doc_id. A bitmap of these ids, of a size with a
    bound, passes over most other texts; the join then leaves what it let through. Texts without id are always read."""
    ids = vertices.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"))
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "h", bitmap_bits(ids.count())))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in small_batches(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            keys = np.array([0 if d is None else xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42) for d in ids], np.uint64)
            batch = batch.filter(pa.array(in_bitmap(seen.value, keys) | np.array([d is None for d in ids])))
            if not batch.num_rows:
                continue
            sets = [s for s in shingles(batch.column("text")) if len(s)]
            if sets:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([vertex(set_codes(s, bits), taken) for s in sets], pa.int64()), lists], names=["v", "features"])

    found = docs.select("doc_id", "text").mapInArrow(run, "v long, features array<long>")
    return found.groupBy("v").agg(F.first("features").alias("features")).join(vertices.select("v"), "v", "left_semi")


def shareable(sets: DataFrame) -> DataFrame:
    """(v, most): how many features of v some other of the sets has, which bounds what it can have in common with any."""
    features = sets.select("v", F.explode("features").alias("f"))
    alone = features.groupBy("f").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").groupBy("v").agg(F.count("*").alias("alone"))
    return sets.select("v", F.size("features").alias("_n")).join(alone, "v", "left").select("v", (F.col("_n") - F.coalesce("alone", F.lit(0))).alias("most"))


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with common and total (sizes of intersection and union) and linked."""
    out = pairs.join(sets.select(F.col("v").alias("a"), F.col("features").alias("fa")), "a").join(sets.select(F.col("v").alias("b"), F.col("features").alias("fb")), "b")
    out = out.select("a", "b", F.size(F.array_intersect("fa", "fb")).alias("common"), F.size("fa").alias("na"), F.size("fb").alias("nb"))
    out = out.withColumn("total", F.col("na") + F.col("nb") - F.col("common"))
    return out.select("a", "b", "common", "total", (100 * F.col("common") >= percent * F.col("total")).alias("linked"))


def candidates(docs: DataFrame, sizes: DataFrame, width: int, percent: int, bits: int, taken: frozenset[int]) -> DataFrame:
    """(sig, v, size, weight) of the signatures that several sets show; weight is how much of the set others have, large in the
    middle of a group."""
    shared = materialize(shared_rows(signature_rows(docs, width, percent, bits, taken)), "shared")
    counts = shared.groupBy("sig").agg(F.count("*").alias("n"))
    rows = shared.join(counts, "sig").join(sizes.select("v", "size"), "v")
    out = materialize(rows.withColumn("weight", F.sum("n").over(W.partitionBy("v"))).select("sig", "v", "size", "weight"), "cand")
    discard(shared)
    return out


def linked_sets(docs: DataFrame, sizes: DataFrame, width: int, percent: int, bits: int, taken: frozenset[int]) -> DataFrame:
    """Links (a, b), a written table, whose components are those of all links.

    Sets of which too many features are nobody else's are left out. Within every signature all members are first compared with
    one leader, which settles most groups in linear work. Members that are left in another component than their leader are then
    compared with those members of the same leader that neither their own features nor the triangle inequality of the Jaccard
    distance rule out."""
    posted = candidates(docs, sizes, width, percent, bits, taken)
    vertices = materialize(posted.select("v").distinct().join(sizes, "v").select("v", "doc_id"), "vertices")
    sets = materialize(fetch_sets(docs, vertices, width, bits, taken), "sets")
    cand = posted.join(shareable(sets), "v").where(100 * F.col("most") >= percent * F.col("size"))
    heads = cand.groupBy("sig").agg(F.max(F.struct("weight", "v", "size", "most")).alias("head"), F.count("*").alias("n")).where("n > 1")
    cand = cand.join(heads.select("sig", F.col("head.v").alias("head"), F.col("head.size").alias("head_size"), F.col("head.most").alias("head_most")), "sig")
    cand = materialize(cand, "cand")
    discard(posted, vertices)

    def near(x, y, p, q):  # by size x, y and features that others have p, q
        common = F.least(p, q)
        return 100 * common >= percent * (x + y - common)

    first = materialize(compare(cand.where("v <> head").where(near(F.col("size"), F.col("head_size"), F.col("most"), F.col("head_most"))).select(F.col("head").alias("a"), F.col("v").alias("b")).distinct(), sets, percent), "first")
    links = first.where("linked").select("a", "b")
    groups = components(links)
    far = cand.join(first.select(F.col("a").alias("head"), F.col("b").alias("v"), "common", (1 - F.col("common") / F.col("total")).alias("apart")), ["head", "v"], "left")
    # without a comparison the sizes alone bound the distance
    far = far.withColumn("apart", F.when(F.col("v") == F.col("head"), F.lit(0.0)).otherwise(F.col("apart")))
    far = far.withColumns({"low": F.coalesce("apart", 1 - F.least("size", "head_size") / F.greatest("size", "head_size")), "high": F.coalesce("apart", F.lit(1.0))})
    far = far.join(groups.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    far = far.join(groups.select(F.col("id").alias("head"), F.col("component").alias("main")), "head", "left").withColumn("main", F.coalesce("main", "head"))
    far = materialize(far.select("head", "v", "size", "most", F.when(F.col("v") == F.col("head"), F.col("most")).otherwise(F.col("common")).cast("int").alias("common"), "low", "high", "component", "main").distinct(), "far")
    heads = far.groupBy("v").agg(F.sort_array(F.collect_set("head")).alias("heads"))  # no more than a set's signatures
    far = far.join(heads, "v")
    out = far.where("component <> main")
    gap = 1 - percent / 100 + 1e-9
    x, y = out.alias("x"), far.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.v") < F.col("y.v"))
    # a pair that has several leaders is compared under the first
    once = once & (F.col("x.head") == F.array_min(F.array_intersect("x.heads", "y.heads")))
    # what both can have in common: inside the leader, and outside it where others have it too
    inside = F.least("x.common", "y.common") + F.greatest(F.lit(0), F.least(F.col("x.most") - F.col("x.common"), F.col("y.most") - F.col("y.common")))
    common = F.coalesce(inside, F.least("x.most", "y.most"))
    once = once & (100 * common >= percent * (F.col("x.size") + F.col("y.size") - common))
    apart = once & (F.col("x.component") != F.col("y.component")) & near(F.col("x.size"), F.col("y.size"), F.col("x.most"), F.col("y.most")) & (F.col("x.low") - F.col("y.high") <= gap) & (F.col("y.low") - F.col("x.high") <= gap)
    rest = x.join(y, (F.col("x.head") == F.col("y.head")) & apart).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()
    rest = rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    out = materialize(links.union(compare(rest, sets, percent).where("linked").select("a", "b")), "links")
    discard(cand, sets, first, far, groups)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 63) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, the smallest doc_id that links reach.

    Documents link when the sets of their width-word shingles have percent / 100 or more of their union in common. A text of
    fewer words is one shingle; one without words (null, empty, blank) links with nothing. Repeated ids are one document in
    all but the row count; rows with a null id keep the smallest id of their group, or null. Sets go by a code of so many bits;
    sets that differ in a second hash of 63 bits are told apart where their codes do not."""
    docs = docs.select("doc_id", "text")
    rows = materialize(set_rows(docs, width, bits), "rows")
    sizes = rows.where("v is not null").groupBy("v").agg(F.min("w").alias("w"), F.max("w").alias("other"))
    taken = frozenset(r[0] for r in sizes.where("w <> other").select("v").collect())  # at 63 bits about three among 10^10 sets
    if taken:
        rows = rows.withColumn("v", F.when(F.col("v").isin(list(taken)), -1 - F.col("w")).otherwise(F.col("v")))
    sizes = materialize(rows.where("v is not null").groupBy("v").agg(F.first("n_shingles").cast("int").alias("size"), F.min("doc_id").alias("doc_id")), "sizes")
    links = linked_sets(docs, sizes, width, percent, bits, taken)
    groups = components(links)
    own = materialize(sizes.join(groups.withColumnRenamed("id", "v"), "v", "left").select("v", "doc_id", "component"), "own")
    # written first, so that the join below is one that Spark splits where a component holds much of the table
    least = materialize(own.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    ids = materialize(own.join(least, "component", "left").select("v", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")), "ids")
    discard(links, groups, own, least, sizes)
    return rows.join(ids, "v", "left").select("doc_id", "n_shingles", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
