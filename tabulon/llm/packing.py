"""Packing into fixed-length sequences: first-fit decreasing by a tournament tree of capacities, in randomised groups."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkTable, grown, read_table, small_batches, tidy

END = 2
_TOKENIZERS: dict = {}


def word_tokenizer(path: str):
    """A table of token ids by word. The tokenizer never joins or normalises across a space or line feed, so that the ids of
    a text are those of its words one after the other; a word's ids come from the tokenizer the first time it is met."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _TOKENIZERS[path] = WordIds(tokenizer)
    return _TOKENIZERS[path]


def _fold(text: str) -> str:
    """Lower-cased where that cannot differ from what the tokenizer does first: in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordIds:
    MARK = "\x01"

    def __init__(self, tokenizer):
        self.tokenizer, self.table, self.flat = tokenizer, ChunkTable(self.describe, 96 << 20, self.compact), np.zeros(0, np.uint32)
        self.used = 0
        mark = self.ids(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def describe(self, words: list[str]) -> list[np.ndarray]:
        """Start and size of every word's ids in flat; many words are encoded in one text, a mark between them."""
        if not self.table.at:
            self.flat, self.used = np.zeros(0, np.uint32), 0
        flat, sizes = [], []
        for i in range(0, len(words), 5000):
            own = words[i : i + 5000]
            ids = self.ids(f" {self.MARK} ".join(own))
            at = np.flatnonzero(ids == self.mark) if self.mark is not None else ()
            if len(at) == len(own) - 1:
                sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
                flat.append(np.delete(ids, at))
            else:  # a word has the mark itself
                each = [self.ids(w) for w in own]
                sizes.append(np.array([len(x) for x in each]))
                flat.append(np.concatenate(each))
        n = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        starts = self.used + np.cumsum(n) - n
        for ids in flat:
            self.flat = grown(self.flat, self.used, ids)
            self.used += len(ids)
        return [starts, n]

    def compact(self) -> None:
        """Leaves in flat only the ids of words that the table still has."""
        if not self.table.columns:
            self.flat, self.used = np.zeros(0, np.uint32), 0
            return
        starts, sizes = self.table.columns
        before = np.cumsum(sizes) - sizes
        self.flat = self.flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        self.table.columns, self.used = [before, sizes], len(self.flat)

    def rest(self, most: int = 16 << 20) -> None:
        """Between tasks only the most frequent words stay, so that the next task need not meet them anew."""
        self.table.thin(most)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts back to back, each with END behind it; the offset of each text."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += _fold(text).replace("\n", " ").split(" ")
            ends.append(len(words))
        rows = self.table.rows(words)
        starts, sizes = (c[rows] for c in self.table.columns)
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])
        ends = before[np.array(ends)]
        return np.insert(self.flat[at], ends[1:], np.uint32(END)), ends + np.arange(len(ends))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of every document's ids: cuts at multiples of capacity."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer)
        for batch in small_batches(batches, "text"):
            ids, at = encode([t or "" for t in batch.column("text").to_pylist()])
            rows = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for s in range(a, b, capacity):
                    e = min(s + capacity, b)
                    rows.append((doc, s - a, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes()), b - a))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encode.rest()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, items by falling size; each goes into the first bin with room. The tree holds in every
    node the largest room below it, so that the first such bin is found on one way down."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, group_docs: int = 2048, seed: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with END. Pieces of capacity ids fill a sequence each; what is left of the documents is packed by
    falling length within groups of about group_docs documents, drawn by a hash, so that a group has all lengths and fits
    one task. Null and empty texts give one piece of one id. Every row counts as a document, repeated and null ids too; rows
    equal in both id and text meet in one group."""
    groups = max(1, -(-docs.count() // group_docs))
    pieces = cut_pieces(docs, tokenizer, capacity).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), capacity)
        sequence = (key[0].as_py() << 24) + np.array(bins, np.int64)
        return rows.drop_columns("g").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    return pieces.groupBy("g").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
