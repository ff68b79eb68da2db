"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders, windows of the
templates meet in a hash join, and along the passage each slot value of the item must stand against one value of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ChunkTable, bitmap, bitmap_bits, discard, hash_text, in_bitmap, materialize, read_table, small_batches, tidy, window_hashes

UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k j kj w kw kwh v a hz "
    "dollar dollars euro euros cent cents pound pounds percent degree degrees mph kmh".split()
)
NOTHING, BREAK, WORD, NUMBER, UNIT, QUANTITY, NAME = range(7)
PLACE = {NUMBER: "\x00number", QUANTITY: "\x00quantity", NAME: "\x00name"}


def _describe(words: list[str]) -> list[np.ndarray]:
    """Hash of the bare lower-cased word, its kind, whether it is capitalised, whether it ends a sentence."""
    raw, kind, capital, ends = [], [], [], []
    for w in words:
        bare = w.strip("\"'`.,;:!?()[]{}<>|*#%&$_-/\\~^+=…“”‘’«»¡¿")
        low = bare.lower()
        if w == "\n":
            k = BREAK
        elif not bare:
            k = NOTHING
        elif any(c.isdigit() for c in bare) and not any(c.isalpha() for c in bare.rstrip("kKmMbBthsdrnxX")):
            k = NUMBER
        elif bare[0].isdigit() and low.lstrip("0123456789.,") in UNITS:
            k = QUANTITY
        else:
            k = UNIT if low in UNITS else WORD
        raw.append(hash_text(low))
        kind.append(k)
        capital.append(k == WORD and bare[0].isupper() and bare[1:].islower())
        ends.append(k == BREAK or w.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"))
    return [np.array(raw, np.uint64), np.array(kind, np.uint8), np.array(capital, bool), np.array(ends, bool)]


class Templates:
    """Texts as codes, twice: word by word, and as tokens, in which a number, a number with its unit, and a run of names (one
    capital and small letters, inside a sentence) are one placeholder each."""

    def __init__(self):
        self.table = ChunkTable(_describe)
        self.place = np.zeros(7, np.uint64)
        for k, text in PLACE.items():
            self.place[k] = hash_text(text)

    def __call__(self, texts: list[str]):
        """raw codes of the words, their texts (indices), their places in words, words; codes of the tokens, which of them are
        slots, and the first word of each token (and one behind the last)."""
        words: list[str] = []
        sizes = []
        for text in texts:
            own = text.replace("\n", " \n ").split(" ")
            words += own
            words.append("\n")
            sizes.append(len(own) + 1)
        row = self.table.rows(words)
        raw, kind, capital, ends = (c[row] for c in self.table.columns)
        doc = np.repeat(np.arange(len(texts)), sizes)
        some = np.flatnonzero((kind != NOTHING) | ends)  # a mark on its own, as in "word .", still ends a sentence
        first = np.concatenate([[True], ends[some][:-1]])
        kind[some] = np.where(capital[some] & ~first, NAME, kind[some])
        told = np.flatnonzero(kind >= WORD)
        raw, kind, doc = raw[told], kind[told], doc[told]
        after = np.concatenate([[False], doc[1:] == doc[:-1]])[: len(doc)]  # the word before is of the same text
        before = np.concatenate([np.zeros(1, kind.dtype), kind[:-1]])[: len(kind)]
        unit = (kind == UNIT) & after & (before == NUMBER)
        kind[(kind == UNIT) & ~unit] = WORD
        begin = np.flatnonzero(~(unit | ((kind == NAME) & after & (before == NAME))))
        of = kind[begin]
        begin = np.append(begin, len(told))
        of[(of == NUMBER) & (np.diff(begin) == 2)] = QUANTITY
        return raw, doc, told, words, np.where(of >= NUMBER, self.place[of], raw[begin[:-1]]), of >= NUMBER, begin


def exact_windows(raw, doc, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of words inside one text, all in small letters: a passage is found whatever its case and
    the word before it."""
    at = np.flatnonzero(doc[width - 1 :] == doc[: max(0, len(doc) - width + 1)])
    return at, (window_hashes(raw, width) ^ np.uint64(0x5555555555555555))[at]


def template_windows(codes, slot, doc, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of tokens, where a window has placeholders, but no more than half of it, which would say too little."""
    at = np.flatnonzero(doc[width - 1 :] == doc[: max(0, len(doc) - width + 1)])
    slots = np.concatenate([[0], np.cumsum(slot)])
    held = (slots[width:] - slots[:-width])[at] if len(at) else at
    at = at[(held > 0) & (held * 2 <= width)]
    return at, window_hashes(codes, width)[at]


SCHEMA = {"pos": "int", "first": "int", "last": "int", "width": "int", "h": "long", "exact": "boolean", "slot_at": "array<int>", "slot_text": "array<string>", "n_words": "int"}


def window_rows(df: DataFrame, keys: list[str], width: int, widths: list[int] | None, seen: object = None) -> DataFrame:
    """Windows of every text: pos (by words if exact, else by tokens), their first and last words, and the values in their slots.
    widths None: one width per text, its own length if it is shorter than width; else all those widths. seen: a broadcast
    bitmap; only windows whose hash it may hold are returned."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in small_batches(batches, "text"):
            raw, doc, told, words, codes, slot, begin = templates([t or "" for t in batch.column("text").to_pylist()])
            token_doc = doc[begin[:-1]]
            sides = []
            for own in (doc, token_doc):
                size = np.bincount(own, minlength=batch.num_rows)
                sides.append((size, np.cumsum(size) - size))
            n_words, from_word = sides[0]
            out: list[list] = [[] for _ in range(len(SCHEMA) + 1)]
            for w in widths or range(1, width + 1):
                for exact, own, (size, origin), (at, h) in ((True, doc, sides[0], exact_windows(raw, doc, w)), (False, token_doc, sides[1], template_windows(codes, slot, token_doc, w))):
                    keep = in_bitmap(seen.value, h) if seen is not None else np.ones(len(h), bool)
                    if widths is None:
                        keep &= np.minimum(size[own[at]], width) == w
                    for i, x in zip(at[keep].tolist(), h[keep].tolist(), strict=True):
                        d = int(own[i])
                        a, b = (i, i + w) if exact else (int(begin[i]), int(begin[i + w]))
                        slots = [] if exact else np.flatnonzero(slot[i : i + w]).tolist()
                        values = [" ".join(words[told[j]].lower().strip(".,;:!?\"'()") for j in range(begin[i + s], begin[i + s + 1])) for s in slots]
                        row = (d, i - int(origin[d]), a - int(from_word[d]), b - 1 - int(from_word[d]), w, x - (1 << 64) if x >> 63 else x, exact, slots, values, int(n_words[d]))
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
            if out[0]:
                types = [*[pa.int32()] * 4, pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32()]
                arrays = [*(batch.column(k).take(pa.array(out[0])) for k in keys), *(pa.array(c, t) for c, t in zip(out[1:], types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *SCHEMA])

    types = dict(df.dtypes) | SCHEMA
    return df.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in [*keys, *SCHEMA]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_words: int = 5, coverage: float = 0.5) -> DataFrame:
    """One row per document and benchmark item of which it holds at least the share coverage of windows of width words:
    doc_id, item_id, n_windows (of the item found), coverage, n_slots (of the item that were compared).

    A window is found by its words, whatever their case, or by its template: tokens, in which a number, a number with its unit
    and a run of names are one placeholder each. Items shorter than width are one window. Those of fewer than min_words words
    are found by their words alone, as a template of so few says too little; null and empty texts match nothing. Along one
    alignment each slot value of the item must always stand against one value of the text; where one does not, the templates
    that hold it do not count. Two values of the item may stand against one of the text, as new parameters may be equal by
    chance. Rows that repeat a doc_id are aligned text by text and count as one document; rows with a null id are left out. A
    Bloom bitmap of the benchmark's windows, of a size with a bound, thins the documents' windows before the hash join; the join
    decides. A pair is made only where a document holds one of the windows that few items share: an item has so many of them
    that coverage cannot be reached without one."""
    spark = docs.sparkSession
    own = F.least("n_words", F.lit(width))
    items = window_rows(benchmark, ["item_id"], width, None).where(F.col("item_id").isNotNull() & (F.col("exact") | (F.col("n_words") >= min_words)))
    # the windows of words that this one stands for
    stands = F.sequence(F.col("first"), F.greatest(F.col("first"), F.col("last") - own + 1))
    items = items.select("item_id", F.col("pos").alias("item_pos"), "width", "h", "exact", F.col("slot_at").alias("item_at"), F.col("slot_text").alias("item_slots"), stands.alias("stands"), (F.col("n_words") - own + 1).alias("total"))
    items = materialize(items.distinct(), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # width values at most
    seen = spark.sparkContext.broadcast(bitmap(items.select("h"), "h", bitmap_bits(8 * items.count())))
    found = window_rows(docs.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"], width, widths or [width], seen).where(F.col("doc_id").isNotNull())
    found = materialize(found, "found")  # used twice, made by one scan of the texts
    key, text = ["h", "width", "exact"], ["doc_id", "text_key"]
    # windows in the order of how many items share what stands for them: one of the first total - least + 1 must be found
    shared = items.groupBy(*key).agg(F.count_distinct("item_id").alias("n"))
    crowd = items.join(shared, key).select("item_id", "total", "n", F.explode("stands").alias("at")).groupBy("item_id", "total", "at").agg(F.max("n").alias("n"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy("n", "at"))
    rare = crowd.withColumn("place", place).where(F.col("place") <= F.col("total") - F.ceil(F.col("total") * coverage - 1e-9) + 1)
    rare = rare.groupBy("item_id").agg(F.collect_set("at").alias("rare"))  # at most an item's windows
    keys = items.join(rare, "item_id").where(F.arrays_overlap("stands", "rare")).select(*key, "item_id").distinct()
    chosen = found.select(*key, *text).join(keys, key).select(*text, "item_id").distinct()
    pairs = found.join(chosen, text).join(items, [*key, "item_id"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    pairs = materialize(pairs.where(F.col("exact") | (F.col("slot_at") == F.col("item_at"))), "pairs")
    discard(found)
    line = [*text, "item_id", "shift"]
    slots = pairs.where(~F.col("exact")).select(*line, F.explode(F.arrays_zip("item_slots", "slot_text")).alias("s"))
    values = slots.groupBy(*line, F.col("s.item_slots").alias("value")).agg(F.min("s.slot_text").alias("low"), F.max("s.slot_text").alias("high"))
    checked = values.groupBy(*line).agg(F.count("*").alias("n_slots"), F.collect_list(F.when(F.col("low") != F.col("high"), F.col("value"))).alias("conflicts"))  # at most an item's slots
    pairs = pairs.join(checked, line, "left").where(F.col("exact") | ~F.arrays_overlap("item_slots", "conflicts"))
    out = pairs.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("stands"))).alias("at"), F.max("total").alias("total"), F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"))
    share = F.size("at") / F.col("total")
    return out.where(share >= coverage).select("doc_id", "item_id", F.size("at").cast("long").alias("n_windows"), F.round(share, 6).alias("coverage"), "n_slots")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
