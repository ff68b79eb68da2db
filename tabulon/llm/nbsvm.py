"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model by dual
coordinate descent (Naive Bayes support vectors)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkTable, hash_text, mix64, read_table, small_batches, tidy

_RUNS = [(re.compile(p), r) for p, r in ((r"[^\W\d_a-zß-öø-ÿ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"\d+", "9"), (r"([^\w\s])\1+", r"\1\1"))]


def _shape(word: str) -> str:
    for pattern, into in _RUNS:
        word = pattern.sub(into, word)
    return word


def _describe(words: list[str]) -> list[np.ndarray]:
    return [np.array([hash_text("w" + w.lower()) for w in words], np.uint64), np.array([hash_text("s" + _shape(w)) for w in words], np.uint64)]


class Indicators:
    """Distinct hashed features of a text: its words, the shapes of its words, and pairs and triples of shapes in a row."""

    def __init__(self, bits: int):
        self.mask, self.table = np.uint64((1 << bits) - 1), ChunkTable(_describe)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += text.replace("\n", " \n ").split(" ")
            ends.append(len(words))
        rows = self.table.rows(words)
        word, shape = (c[rows] for c in self.table.columns)
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            s = shape[a:b]
            grams = [word[a:b], s]
            h = s
            for j in (1, 2):
                h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[j:])
                grams.append(h)
            out.append(np.unique(np.concatenate(grams) & self.mask).astype(np.int32))
        return out


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log((alpha + documents of class 1 with the feature) / their sum) minus the same for class 0; 0 for unseen features."""
    flat, n = np.concatenate(rows), np.array([len(r) for r in rows])
    p = np.bincount(flat, np.repeat(y > 0, n).astype(float), size)
    q = np.bincount(flat, np.repeat(y <= 0, n).astype(float), size)
    r = np.log((alpha + p) / (alpha * np.count_nonzero(p + q) + p.sum())) - np.log((alpha + q) / (alpha * np.count_nonzero(p + q) + q.sum()))
    r[(p + q) < 2] = 0
    return r


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost x hinge losses; both classes weigh the same in all. Rows are scaled to length 1."""
    w, bias = np.zeros(len(r)), 0.0
    values = [r[i] / (np.linalg.norm(r[i]) or 1.0) for i in rows]
    square = np.array([v @ v + 1.0 for v in values])
    upper = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    dual, draw = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(y)).tolist():
            at, v = rows[i], values[i]
            step = (1.0 - y[i] * (w[at] @ v + bias)) / square[i]
            new = min(max(dual[i] + step, 0.0), upper[i])
            if (d := (new - dual[i]) * y[i]) != 0.0:
                w[at] += d * v
                bias += d
                dual[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3 * cost:
            break
    return w, bias


def margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[i] @ r[i] / (np.linalg.norm(r[i]) or 1.0) + bias for i in rows])


def platt(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins of rows that the model has not seen, by Newton's method."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, c = np.column_stack([m, np.ones(len(m))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * c)
        c += step
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def fit_rows(rows: list[np.ndarray], label: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """The features that count, their log-count ratios and weights (interleaved), bias, and Platt's two numbers."""
    y = np.where(label > 0, 1.0, -1.0)
    if len(y) < 10 or len(set(y.tolist())) < 2:  # nothing to tell apart: the share of label 1, for every text
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return np.zeros(0, np.int32), np.zeros((0, 2)), 0.0, 0.0, float(np.log(share / (1 - share)))
    names = np.unique(np.concatenate(rows))
    rows = [np.searchsorted(names, r).astype(np.int32) for r in rows]  # only features that occur take room
    seen, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        own = [rows[i] for i in np.flatnonzero(fold != k)]
        if len(set(y[fold != k].tolist())) < 2:
            continue
        r = log_count_ratios(own, y[fold != k], len(names))
        w, bias = dual_coordinate_descent(own, r, y[fold != k], cost, rounds)
        seen[fold == k] = margins([rows[i] for i in np.flatnonzero(fold == k)], r, w, bias)
    slope, offset = platt(seen, y)
    r = log_count_ratios(rows, y, len(names))
    w, bias = dual_coordinate_descent(rows, r, y, cost, rounds)
    used = np.flatnonzero(r != 0)
    return names[used].astype(np.int32), np.column_stack([r[used], w[used]]), bias, slope, offset


def train_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Labelled documents to fit on: never those whose crc32(doc_id) mod 4 is 2; about max_rows at most, drawn by a hash of the id.
    Rows that repeat id and text count once; where the ids drawn have more than twice max_rows rows, these are drawn by a hash of
    id and text, to about max_rows, so that the bound holds however many rows an id has."""
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).groupBy("doc_id").agg(F.min(label).alias("_label"))
    drawn = lambda share, *keys: F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30))
    known = known.where(drawn(min(1.0, max_rows / max(1, known.count())), "doc_id"))
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    n = docs.select("doc_id").join(known.select("doc_id"), "doc_id").count()
    if n > 2 * max_rows:
        rows = rows.where(drawn(max_rows / n, F.lit("rows"), "doc_id", "text"))
    return rows.dropDuplicates(["doc_id", "text"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, bits: int = 21, cost: float = 1.0, rounds: int = 15) -> tuple:
    """The model, fitted in one task on a sample bounded by max_rows (documented bound: its features, not the corpus, meet there)."""

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Indicators(bits)
        for batch in small_batches(batches, "text"):
            rows = own([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label").cast(pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "features"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=mix64(rows["doc_id"].fillna(-1).to_numpy().astype(np.int64).astype(np.uint64))).sort_values(["order", "doc_id"]).head(2 * max_rows)
        used, pair, bias, slope, offset = fit_rows([np.frombuffer(f, np.int32) for f in rows["features"]], rows["label"].to_numpy(), cost, rounds)
        return pd.DataFrame({"used": [used.tobytes()], "pair": [pair.astype(np.float64).tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    sample = train_rows(docs, labels, label, max_rows).mapInArrow(features, "doc_id long, label int, features binary")
    row = sample.groupBy(F.lit(1).alias("one")).applyInPandas(solve, "used binary, pair binary, bias double, slope double, offset double").first()
    return (b"", b"", 0.0, 0.0, 0.0, bits) if row is None else (bytes(row[0]), bytes(row[1]), row[2], row[3], row[4], bits)


def score(docs: DataFrame, model: tuple, out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row of docs, from its text alone (null counts as empty)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.drop(out)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, pair, bias, slope, offset, bits = shipped.value
        own, used, pair = Indicators(bits), np.frombuffer(used, np.int32), np.frombuffer(pair).reshape(-1, 2)
        r, w = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
        r[used], w[used] = pair[:, 0], pair[:, 1]
        for batch in small_batches(batches, "text"):
            m = margins(own([t or "" for t in batch.column("text").to_pylist()]), r, w, bias)
            p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, out])

    return fields.mapInArrow(run, T.StructType([*fields.schema.fields, T.StructField(out, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit_args) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on). Null or repeated ids are scored like any other row;
    without usable labels every text gets the same score. Columns of these names are replaced."""
    out = score(docs, fit(docs, labels, **fit_args))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")
