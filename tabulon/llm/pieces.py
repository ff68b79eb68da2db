"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking over longest matches."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import read_table, small_batches, tidy

SPACE = "▁"


class Memo(dict):
    """What make() gives for a string, worked out when it is first asked for. Two generations bound it: when the newer one
    takes max_bytes it becomes the older one, and what is asked for again moves on."""

    def __init__(self, make, max_bytes: int = 64 << 20):
        super().__init__()
        self.make, self.max_bytes, self.old, self.taken = make, max_bytes, {}, 0

    def __missing__(self, key: str) -> bytes:
        if self.taken > self.max_bytes:
            self.old, self.taken = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.taken += 200 + 2 * len(key) + len(value)
        return value


class Surfaces:
    """What a model's ids stand for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        bytes_of = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        odd = "a  Ａ́ ①  b"  # a model that normalises, trims or leaves out the first space changes this
        if len(bytes_of) != 256 or any(sp.is_unused(i) for i in every) or sp.normalize(odd) != SPACE + odd.replace(" ", SPACE):
            raise ValueError("only models with byte fallback, a leading space and no normalisation")
        self.byte = [bytes_of[b] for b in range(256)]
        self.hidden = {i for i in every if sp.is_control(i)}
        self.surface = [bytes([self.byte.index(i)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        self.bytes = set(self.byte)
        self.spaced = {i for p, i in self.id.items() if p.startswith(SPACE)}

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: one leading space goes, bytes that form no character become U+FFFD each."""
        first = next((i for i in ids if i not in self.hidden), None)
        skip = int(first in self.spaced)
        if self.hidden.isdisjoint(ids):
            try:
                return b"".join(map(self.surface.__getitem__, ids))[skip:].decode("utf-8")
            except UnicodeDecodeError:
                pass
        return self._lenient(ids)[skip:]

    def _lenient(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.bytes:
                run += self.surface[i]
                continue
            while run:
                size = next((k for k in range(1, 5) if k <= len(run) and _is_character(run[:k])), 0)
                out.append(run[:size].decode("utf-8") if size else "�")
                run = run[size or 1 :]
            if i is not None:
                out.append(self.surface[i].decode("utf-8"))
        return "".join(out)


class PieceModel(Surfaces):
    """A model's pieces and scores. Merging joins, again and again, the neighbours whose piece has the highest score, the
    leftmost of equal ones. A run of pieces is what merging gives exactly if it gives every two neighbours back as they are."""

    def __init__(self, path: str):
        super().__init__(path)
        self.rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: self.rank[s] for p, s in self.score.items()}
        common = Counter(self.rank[p] for p in self.id if len(p) > 1)
        self.tied = {c for p, r in self.rank.items() if common[r] > 1 for c in p}
        self.walks, self.last, self.first = True, {}, {}
        own = [p for p in self.id if len(p) == 1 or self.grow(p)]  # others never come out of merging
        self.shorter: dict[str, str | None] = {}
        have = set(own)
        self.finder = ahocorasick.Automaton()
        for p in own:
            prefixes = (p[:k] for k in range(len(p) - 1, 0, -1))
            self.shorter[p] = next((q for q in prefixes if len(q) == 1 or q in have), None)
            if len(p) > 1:  # a character alone is what is left where nothing else fits
                self.finder.add_word(p[::-1], p)
        self.finder.make_automaton()
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.memo = Memo(self.encode_chunk)
        #: Texts fall into chunks that no piece crosses: before a run of spaces and round line feeds, as far as the pieces allow.
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        lines = not any("\n" in p for p in self.id)
        within = f"[^{SPACE}\n]" if lines else f"[^{SPACE}]"
        self.chunks = (lambda t: [t]) if crossing else re.compile(f"{SPACE}*{within}+|{SPACE}+" + "|\n+" * lines).findall

    def merge(self, symbols: list[str], border: int = -1) -> list[str] | None:
        """What merging gives; None if it joins across the border (a number of characters)."""
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return symbols
            if border >= 0 and sum(map(len, symbols[: at + 1])) == border:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def grow(self, piece: str) -> bool:
        """Merges a piece's characters and files how its last and its first symbol grow, each with the rank of the next merge."""
        symbols, firsts, lasts, before = list(piece), [], [], -1
        while len(symbols) > 1:
            found = [(self.rank[x], k) for k, x in enumerate(map(str.__add__, symbols, symbols[1:])) if x in self.rank]
            if not found:
                return False
            rank, at = min(found)
            self.walks &= before <= rank
            before = rank
            if at == 0:
                firsts.append((symbols[0], rank))
            if at == len(symbols) - 2:
                lasts.append((symbols[-1], rank))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        self.first[piece], self.last[piece] = firsts, lasts
        return True

    def _compatible(self, left: str, right: str) -> bool:
        """Merges the two again, along the symbols at their border: does one across it come first? Where merges of a piece are
        not in the order of their ranks, or pieces share a score, all symbols are merged again."""
        if not self.walks or left[-1] in self.tied and right[0] in self.tied:
            return self.merge([*left, *right], len(left)) is not None
        rank, never = self.rank.get, len(self.rank)
        lasts, firsts = self.last.get(left, ()), self.first.get(right, ())
        i = j = 0
        x, after_x = lasts[0] if lasts else (left, never)
        y, after_y = firsts[0] if firsts else (right, never)
        while True:
            across = rank(x + y, never)
            if across < after_x and across <= after_y:
                return across == never
            if after_x <= after_y:
                if after_x == never:
                    return True
                i += 1
                x, after_x = lasts[i] if i < len(lasts) else (left, never)
            else:
                j += 1
                y, after_y = firsts[j] if j < len(firsts) else (right, never)

    def split(self, text: str) -> list[str]:
        """The pieces of a text, characters outside the vocabulary by themselves."""
        n = len(text)
        longest = dict(reversed(list(self.finder.iter(text[::-1])))).get  # matches of one end come longest first: the last to be set
        shorter, compatible, open_at, out, at = self.shorter.get, self.compatible, bytearray(b"\x01") * (n + 1), [], 0
        piece = longest(n - 1, text[0]) if n else None
        while piece is not None:
            end = at + len(piece)
            if open_at[end] and (not out or compatible(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest(n - 1 - at, text[at]) if at < n else None
                continue
            piece = shorter(piece)
            if piece is None:  # nothing fits behind the last piece: it ends at a failed position
                open_at[at] = 0
                piece = out.pop()
                at -= len(piece)
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        pieces = (chunk,) if chunk in self.shorter else self.split(chunk)
        ids = list(map(self.id.get, pieces))
        if None in ids:
            ids = [i for p in pieces for i in ((self.id[p],) if p in self.id else [self.byte[b] for b in p.encode("utf-8")])]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, chunks)), np.int32)


def _is_character(b: bytes) -> bool:
    try:
        return len(b.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(2)
def surfaces(path: str) -> Surfaces:
    return Surfaces(path)


def _with(df: DataFrame, column: str, new: str, kind: str, run) -> DataFrame:
    """df with a column that run makes of batches of another one; a column of the new name is replaced."""
    rest = [c for c in df.columns if c != new]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]) if rest else F.struct(F.lit(0).alias("c0"))
    packed = df.select(row.alias("row"), F.col(column).alias("given"))
    made = packed.mapInArrow(run, packed.select("row").schema.add("made", DataType.fromDDL(kind)))
    return made.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(rest)], F.col("made").alias(new))


def encode(df: DataFrame, model: str, column: str = "text") -> DataFrame:
    """df with ids array<int>: what the model makes of the whole text, without begin or end ids.

    Null and empty texts have no ids. Long texts are taken in chunks that no piece crosses, so that only their own length bounds
    memory. Every row stands for itself, repeated ones too; other columns stay (one named ids is replaced); an empty table gives none."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in small_batches(batches, "given"):
            ids = [own.encode(t or "") for t in batch.column("given").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], names=["row", "made"])

    return _with(df, column, "ids", "array<int>", run)


def decode(df: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """df with decoded string: the text of an array of ids; null arrays count as empty and give an empty text. Other columns stay
    (one named decoded is replaced)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = surfaces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                given = part.column("given")
                ids, at = given.flatten().to_numpy().tolist(), np.concatenate([[0], np.cumsum(given.value_lengths().fill_null(0).to_numpy())]).tolist()
                made = pa.array([own.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), made], names=["row", "made"])

    return _with(df, column, "decoded", "string", run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = decode(encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text"), model)
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
