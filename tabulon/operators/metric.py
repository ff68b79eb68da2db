"""Vectors in cells round pivots: near pairs, density clusters, nearest neighbours of all rows, spanning forests.

Work on pairs is dealt out in blocks of bounded size: rows of a cell are cut into blocks, and every two blocks that may hold near
pairs meet in a task of their own, so that neither a full cell nor a group of copies ever has to fit one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .steps import components, drop, written

#: Rows that pivots and settings are fitted on, drawn by a hash: a stated bound, whatever the table.
SAMPLE = 2000


def _sample(df: DataFrame, key: str, vector: str, n: int, seed: int) -> np.ndarray:
    """About n vectors, drawn by a hash of their keys."""
    share = min(1.0, n / max(1, df.count()))
    rows = df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(vector).limit(2 * n)
    return np.array([list(r[0]) for r in rows.collect()], np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of both, from differences where they are so near that the usual expansion would lose them."""
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    close = np.argwhere(square < 1e-6 * ((a**2).sum(1)[:, None] + 1e-300))
    d = np.sqrt(np.maximum(square, 0))
    if len(close):
        d[close[:, 0], close[:, 1]] = np.sqrt(((a[close[:, 0]] - b[close[:, 1]]) ** 2).sum(1))
    return d


def usual_radius(df: DataFrame, key: str, vector: str, n: int = 500, seed: int = 1) -> float:
    """Half way between the least and the median distance of about n rows."""
    x = _sample(df, key, vector, n, seed)
    d = _distances(x, x)[np.triu_indices(len(x), 1)]
    return float((np.median(d) + d.min()) / 2) if len(d) else 0.0


def pivots(df: DataFrame, key: str, vector: str, n: int, seed: int = 1) -> np.ndarray:
    """n rows of a sample, each the farthest from those before it."""
    x = _sample(df, key, vector, SAMPLE, seed)
    if not len(x):
        return x
    chosen, d = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def file_in_cells(df: DataFrame, vector: str, centers: np.ndarray, also: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """df with cell (the nearest center) and cells (array): the further ones that also(distances, own cell) names for each row."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, cell int, cells array<int>"
    shipped = df.sparkSession.sparkContext.broadcast(centers)  # as many rows as there are cells

    def run(batches):
        for rows in batches:
            if len(rows):
                d = _distances(np.array(rows[vector].tolist(), np.float64), shipped.value)
                own = d.argmin(1)
                yield rows.assign(cell=own.astype(np.int32), cells=[np.asarray(c, np.int32) for c in also(d, own)])

    return df.mapInPandas(run, schema)


def meet(left: DataFrame, right: DataFrame, cell: str, keys: tuple[str, str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = 1000, other: int | None = None) -> DataFrame:
    """run(left rows, right rows) on every two blocks of a cell's rows on both sides; a block has about block rows (on the right about
    other, if given), drawn by a hash of the row's key. Rows go to as many tasks as the other side has blocks in the cell."""
    def blocks(df: DataFrame, name: str, block: int) -> DataFrame:
        return df.groupBy(cell).agg(F.ceil(F.count("*") / block).cast("int").alias(name))  # a row per cell

    size = blocks(left, "_nl", block).join(blocks(right, "_nr", other or block), cell)
    own = lambda df, key, n, other, mine, theirs: df.join(F.broadcast(size), cell).withColumn(mine, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_nl", "_nr")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    a = own(left, keys[0], "_nl", "_nr", "_a", "_b")
    b = own(right, keys[1], "_nr", "_nl", "_b", "_a")
    return a.groupBy(cell, "_a", "_b").cogroup(b.groupBy(cell, "_a", "_b")).applyInPandas(run, schema)


@dataclass
class Block:
    """Rows of one cell: rising ids, vectors, how many rows of the table each stands for, whether it is core."""

    name: int
    id: np.ndarray
    v: np.ndarray
    n: np.ndarray
    core: np.ndarray


def pack(filed: DataFrame, block: int) -> DataFrame:
    """Blocks of about block rows of filed(id, v, n, cell, cells and perhaps core), a written row each: of one cell and near one set
    of borders, as long as there are enough such rows. pairs() needs no copies of rows."""
    core = F.col("core") if "core" in filed.columns else F.lit(False)
    rows = filed.withColumn("_in", F.size("cells") == 0).select("id", "v", "n", "cell", "cells", "_in", core.alias("core"))
    size = rows.groupBy("cell", "_in").agg(F.ceil(F.count("*") / block).cast("int").alias("_of"))  # two rows a cell
    rows = rows.join(F.broadcast(size), ["cell", "_in"]).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_of")))
    own = rows.groupBy("cell", "_in", "_b").agg(F.array_sort(F.collect_list(F.struct("id", "v", "n", "core"))).alias("r"), F.array_distinct(F.flatten(F.collect_set("cells"))).alias("near"))
    name = F.col("cell").cast("long") * 2 + F.col("_in").cast("int")
    return written(own.select((name * (1 << 32) + F.col("_b")).alias("name"), "cell", "near", *[F.col(f"r.{c}").alias(c) for c in ("id", "n", "core")], F.flatten("r.v").alias("v")), "blocks")


def meet_blocks(blocks: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(pairs) over every two blocks, each with itself too, whose rows may be within reach of each other: of one cell, or each near
    the border of the other's. pairs yields (block, block, whether they are one). A product that reads the written blocks anew, so
    that nothing but what run yields is shuffled, however many blocks there are."""
    names = ("name", "cell", "near", "id", "v", "n", "core")
    x, y = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "xy")
    by_border = F.array_contains("x_near", F.col("y_cell")) & F.array_contains("y_near", F.col("x_cell"))
    near = (F.col("x_name") <= F.col("y_name")) & ((F.col("x_cell") - F.col("y_cell") == 0) | by_border)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    met = x.hint("shuffle_replicate_nl").join(y, near).drop("x_cell", "x_near", "y_cell", "y_near")

    def block(rows: pd.DataFrame, i: int, side: str) -> Block:
        ids = np.asarray(rows[f"{side}_id"].iloc[i])
        v = np.asarray(rows[f"{side}_v"].iloc[i], np.float64).reshape(len(ids), -1)
        return Block(int(rows[f"{side}_name"].iloc[i]), ids, v, np.asarray(rows[f"{side}_n"].iloc[i], np.int64), np.asarray(rows[f"{side}_core"].iloc[i], bool))

    def pairs(batches):
        for batch in batches:  # few rows at a time: each is two blocks
            for start in range(batch.num_rows):
                rows = batch.slice(start, 1).to_pandas()
                a, b = block(rows, 0, "x"), block(rows, 0, "y")
                yield a, b, a.name == b.name

    def work(batches):
        for out in run(pairs(batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, kinds, preserve_index=False)

    return met.mapInArrow(work, schema)


class _Forest:
    """Which ids are of one component, as far as links have shown; the least id names it."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = self.up[x]
        return x

    def join(self, ids: np.ndarray, others: np.ndarray, hits: np.ndarray) -> None:
        """Rows ids[i] and others[j] are linked where hits[i, j]; of these, a row's first link, then what that leaves apart."""
        if not hits.any():
            return
        x = np.array([self.root(i) for i in ids.tolist()])
        y = np.array([self.root(i) for i in others.tolist()])
        names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y, most = at[: len(x)], at[len(x) :], len(names)
        label = np.arange(most)  # of the roots
        while True:
            low = np.where(hits, label[y][None], most).min(1)
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, np.where(hits, new[x][:, None], most).min(0))
            new = new[new]
            if (new == label).all():
                break
            label = new
        for i in np.flatnonzero(label != np.arange(most)):
            self.up[names[i].item()] = names[label[i]].item()

    def links(self) -> pd.DataFrame:
        ids = list(self.up)
        out = pd.DataFrame({"id": ids, "to": [self.root(i) for i in ids], "d": -1.0})
        return out[out["id"] != out["to"]]


def _nearest_edges(edges: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(edges).sort_values(["d", "to"]).drop_duplicates("id")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.float64)


def dbscan(df: DataFrame, key: str, vector: str, eps: float, least: int, cells: int = 16, seed: int = 1, block: int = 1000) -> DataFrame:
    """(key, cluster, core): density clusters of all rows by Euclidean distance. A row is core if least rows, itself included, lie
    within eps; core rows within eps of each other are of one cluster, named by its least key; another row joins the cluster of
    its nearest core row within eps (ties: the least key), or none (null).

    Exact. A row is filed under its nearest pivot, and told which borders of other pivots it lies within eps of; blocks of rows meet if
    they are of one cell or near each other's. Rows of equal vectors count as one row with a weight; rows with a null vector are in no cluster."""
    rows = df.where(F.col(vector).isNotNull()).groupBy(F.col(vector).alias("v")).agg(F.min(key).alias("id"), F.count("*").alias("n"))
    rows = written(rows, "vectors")
    centers = pivots(rows, "id", "v", cells, seed)
    if not len(centers):
        return df.select(key, F.lit(None).cast(df.schema[key].dataType).alias("cluster"), F.lit(False).alias("core"))
    between = _distances(centers, centers)

    def near_borders(d: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """A row within eps of one beyond the border of two pivots is within eps of that border."""
        at = np.arange(len(own))
        gap = d**2 - (d[at, own] ** 2)[:, None]
        inside = gap <= 2 * (eps * (1 + 1e-9) + 1e-12) * between[own]
        inside[at, own] = False
        return [np.flatnonzero(x) for x in inside]

    filed = written(file_in_cells(rows, "v", centers, near_borders), "filed")
    kind = rows.schema["id"].dataType.simpleString()

    def count(pairs) -> Iterator[pd.DataFrame]:
        """How much weight each row has within eps, summed up over all pairs of blocks of the task."""
        sums: dict = {}
        for a, b, same in pairs:
            hits = _distances(a.v, b.v) <= eps
            for block, near in ((a, hits @ b.n), (b, None if same else hits.T @ a.n)):
                if near is not None:
                    sums[block.name] = (block.id, sums[block.name][1] + near if block.name in sums else near)
        for ids, near in sums.values():
            yield pd.DataFrame({"id": ids, "n": near})[near > 0]

    counts = meet_blocks(pack(filed, block), count, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("near"))
    flags = written(counts.select("id", (F.col("near") >= least).alias("core")), "flags")

    def link(pairs) -> Iterator[pd.DataFrame]:
        """Of core rows only what spans their components in the blocks of the task; of other rows the nearest core row."""
        spans, edges, waiting = _Forest(), [], 0
        for a, b, same in pairs:
            d = _distances(a.v, b.v)
            near = d <= eps
            spans.join(a.id[a.core], b.id[b.core], near[a.core][:, b.core])
            for x, y, far, hit in ((a, b, d, near), *(() if same else ((b, a, d.T, near.T),))):
                far = np.where(hit[~x.core][:, y.core], far[~x.core][:, y.core], np.inf)
                if far.size:
                    best, to = far.min(1), y.id[y.core]
                    at = np.where(far == best[:, None], np.arange(len(to))[None], len(to)).min(1)  # ids of a block rise
                    edges.append(pd.DataFrame({"id": x.id[~x.core], "to": to[at], "d": best})[np.isfinite(best)])
                    waiting += len(edges[-1])
            if waiting > 500_000:
                edges = [_nearest_edges(edges)]
                waiting = 0
        yield spans.links()
        if edges:
            yield _nearest_edges(edges)

    found = written(meet_blocks(pack(filed.join(flags, "id"), block), link, f"id {kind}, to {kind}, d double"), "found")
    tree = components(found.where("d < 0"), "id", "to").withColumnRenamed("root", "cluster")
    core = flags.where("core").join(tree, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"), F.lit(True).alias("core"))
    core = written(core, "core")
    edge = found.where("d >= 0").groupBy("id").agg(F.min(F.struct("d", "to")).alias("b")).select("id", F.col("b.to").alias("to"))
    edge = edge.join(core.select(F.col("id").alias("to"), "cluster"), "to").select("id", "cluster", F.lit(False).alias("core"))
    named = rows.select("v", "id").join(core.union(edge), "id", "left")
    out = df.select(key, F.col(vector).alias("v")).join(named.drop("id"), "v", "left")
    return out.select(key, "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def cell_index(df: DataFrame, key: str, vector: str, cells: int, recall: float = 0.95, k: int = 5, seed: int = 1) -> tuple[np.ndarray, int]:
    """(centers, probes): a coarse index fitted on about SAMPLE rows. Centers are means of the sample by a few rounds of k-means; probes
    is how many cells a row has to look at for the given share of its k nearest rows, as the sample itself has it."""
    x = _sample(df, key, vector, SAMPLE, seed)
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(10):
        own = _distances(x, centers).argmin(1)
        centers = np.array([x[own == c].mean(0) if (own == c).any() else centers[c] for c in range(len(centers))])
    if len(x) <= k + 1:
        return centers, max(1, len(centers))
    to = _distances(x, centers)
    own, order = to.argmin(1), to.argsort(1, kind="stable")
    d = _distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = d.argsort(1, kind="stable")[:, :k]
    place = np.empty_like(order)
    place[np.arange(len(x))[:, None], order] = np.arange(len(centers))[None]
    at = np.sort(place[np.arange(len(x))[:, None], own[near]].ravel())
    return centers, int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1


def _nearest(x: np.ndarray, y: np.ndarray, own: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y, whose ids others rise, but for a row's own. A product in single precision
    leaves out what is farther than its error allows; the rest is ranked exactly, by distance to nine digits, then id."""
    most, middle = min(k, len(y)) - 1, y.mean(0)
    p, q = x - middle, y - middle
    size, far = (p**2).sum(1), (q**2).sum(1)
    i = j = None
    if max(size.max(), far.max()) < 1e30:
        rough = far.astype(np.float32)[None] - 2 * (p.astype(np.float32) @ q.astype(np.float32).T)  # less the row's own square
        at = np.minimum(np.searchsorted(others, own), len(others) - 1)
        same = np.flatnonzero(others[at] == own)
        rough[same, at[same]] = np.inf
        limit = np.partition(rough, most, axis=1)[:, most].astype(np.float64)
        slack = 1e-5 * (size + far.max()) + 1e-8 * np.sqrt(size + far.max()) + 1e-16
        i, j = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
    if i is not None and len(i) <= 8 * k * len(x):
        d = np.round(np.sqrt(((x[i] - y[j]) ** 2).sum(1)), 9)
    else:  # many equal rows, or numbers too large
        d = np.round(_distances(x, y), 9)
        d[own[:, None] == others[None]] = np.inf
        i, j = np.nonzero((d <= np.partition(d, most, axis=1)[:, most][:, None]) & np.isfinite(d))
        d = d[i, j]
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], d[kept]


def neighbours(queries: DataFrame, df: DataFrame, key: str, vector: str, index: tuple[np.ndarray, int], k: int, block: int = 8000) -> DataFrame:
    """(key, neighbour, distance, rank): for each query row its k nearest other rows of df among those in the cells that it looks at,
    by Euclidean distance to nine digits, then key. All rows are filed; pairs are ranked exactly; null vectors find nothing and are not
    found."""
    centers, probes = index
    nothing = lambda d, own: [np.zeros(0, np.int32)] * len(own)
    first = lambda d, own: list(d.argsort(1, kind="stable")[:, :probes])
    rows = file_in_cells(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")), "v", centers, nothing).drop("cells")
    look = file_in_cells(queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")), "v", centers, first)
    look, rows = written(look.select("id", "v", F.explode("cells").alias("cell")), "look"), written(rows, "cells")

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"][:0], "neighbour": a["id"][:0], "distance": np.zeros(0)})
        b = b.sort_values("id")
        ids, others, x, y = a["id"].to_numpy(), b["id"].to_numpy(), _matrix(a["v"]), _matrix(b["v"])
        found = []
        for start in range(0, len(a), 256):
            own = ids[start : start + 256]
            i, j, d = _nearest(x[start : start + 256], y, own, others, k)
            found.append((own[i], others[j], d))
        out = pd.DataFrame(dict(zip(("id", "neighbour", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
        return out[np.isfinite(out["distance"])]

    kind = df.schema[key].dataType.simpleString()
    near = meet(look, rows, "cell", ("id", "id"), rank, f"id {kind}, neighbour {kind}, distance double", block)
    place = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("id", key)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, weight): the minimum spanning forest of links (a, b, weight), the lesser (weight, a, b) first of equals.

    Each round every tree takes its lightest link outward and trees that are linked become one; so their number at least halves, and
    rounds are logarithmic. Links inside a tree, and all but the lightest between two trees, are left out of the next round."""
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    links = written(links.select(F.struct("weight", "a", "b").alias("e"), F.col("a").alias("x"), F.col("b").alias("y")), "links")
    kept = None
    while not links.isEmpty():
        both = links.select("x", "e").union(links.select("y", "e"))
        taken = written(both.groupBy("x").agg(F.min("e").alias("e")).select("e").distinct().join(links, "e"), "taken")
        kept = taken.select("e") if kept is None else kept.union(taken.select("e"))
        tree = components(taken, "x", "y")
        p, q = tree.select(F.col("id").alias("x"), F.col("root").alias("p")), tree.select(F.col("id").alias("y"), F.col("root").alias("q"))
        other = links.join(p, "x").join(q, "y").where("p <> q").select("e", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        before, links = links, written(other.groupBy("x", "y").agg(F.min("e").alias("e")).select("e", "x", "y"), "links")
        drop(before)
    return (kept if kept is not None else links.select("e")).select("e.a", "e.b", "e.weight")


def single_linkage(edges: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster): the k clusters that merging along the lightest links leaves, named by their least id; with more than k
    separate parts in the graph, those. nodes (id): rows that may have no link."""
    edges = written(edges, "edges")  # read by the forest and by the ids: what made the links runs once
    forest = written(spanning_forest(edges), "forest")
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id")))
    ids = written((ids.union(nodes.select("id")) if nodes is not None else ids).distinct(), "ids")
    parts = ids.count() - forest.count()
    cut = forest.orderBy(F.desc("weight"), F.desc("a"), F.desc("b")).limit(max(0, k - parts))  # fewer than k rows
    roots = components(forest.join(F.broadcast(cut) if k < 10_000 else cut, ["a", "b"], "left_anti"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def affinity_clusters(links: DataFrame, preference: float, damping: float = 0.7, rounds: int = 60, every: int = 5, settled: int = 3) -> DataFrame:
    """(id, exemplar) by affinity propagation along links(a, b, s): s is how well b would stand for a, preference how well a row would
    stand for itself. All other pairs count as impossible. A row that no exemplar is linked to, or that chose itself, is its own.

    Messages between two rows are columns of their link; each round is one grouping by a (over its links, so a row must have a bounded
    number of them, as links to its nearest rows are) and one by b (summed up before the shuffle). Every few rounds the links are
    written; it ends when the exemplars have stayed for settled such writes, or after rounds."""
    ids = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    one = links.where("a <> b").groupBy("a", "b").agg(F.max("s").alias("s"))
    rows = one.union(ids.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(float(preference)).alias("s")))
    rows = written(rows.select("a", "b", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("v")), "messages")
    keep = lambda old, new: F.lit(damping) * F.col(old) + F.lit(1 - damping) * new
    same, positive = F.col("a") == F.col("b"), F.greatest(F.col("r"), F.lit(0.0))
    last, stayed = None, 0
    for k in range(rounds):
        tops = rows.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.col("v") + F.col("s")), False), 1, 2).alias("t"))
        best, next_best = F.col("t")[0], F.get(F.col("t"), F.lit(1))
        rival = F.when(F.col("v") + F.col("s") == best, next_best).otherwise(best)
        alone = F.abs(F.col("s")) + 1  # nothing else to choose
        rows = rows.join(tops, "a").select("a", "b", "s", keep("r", F.coalesce(F.col("s") - rival, alone)).alias("r"), "v")
        sums = rows.groupBy("b").agg(F.sum(F.when(~same, positive)).alias("p"), F.max(F.when(same, F.col("r"))).alias("own"))
        p = F.coalesce("p", F.lit(0.0))
        new = F.when(same, p).otherwise(F.least(F.lit(0.0), F.col("own") + p - positive))
        rows = rows.join(sums, "b").select("a", "b", "s", "r", keep("v", new).alias("v"))
        if (k + 1) % every == 0 or k + 1 == rounds:
            rows = written(rows, "messages")
            now = rows.where(same & (F.col("r") + F.col("v") > 0)).agg(F.count("*"), F.sum(F.xxhash64("a").cast("decimal(38,0)"))).first()
            stayed, last = (stayed + 1 if now == last else 0), now
            if stayed >= settled:
                break
    chosen = rows.where(same & (F.col("r") + F.col("v") > 0)).select(F.col("a").alias("b"))
    to = rows.where("a <> b").join(chosen, "b").groupBy("a").agg(F.max(F.struct("s", (-F.col("b")).alias("n"))).alias("m"))
    to = to.join(chosen.withColumnRenamed("b", "a"), "a", "left_anti").select(F.col("a").alias("id"), (-F.col("m.n")).alias("exemplar"))
    return ids.join(to, "id", "left").select("id", F.coalesce("exemplar", "id").alias("exemplar"))
