"""Secret scan with one deterministic automaton for all rules: subset construction, minimisation, transition arrays.

The combined automaton reads every byte once and yields where matches end. From these ends an automaton of the reversed rule
walks back to where they start, and the rule's own automaton reads the match, longest first, and says whether it counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table, small_batches, text_bytes, tidy

KEYWORDS = "password|passwd|secret|token|api_?key"
_ANYCASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KEYWORDS)
_ASSIGN = rf"({_ANYCASE})[\"']?\x20*[:=]\x20*[\"']?"
#: kind: regex of a match, and regex of those matches that count (the others still take up their text).
RULES = {
    "assign": (_ASSIGN + "[A-Za-z0-9+/_.=-]+", _ASSIGN + "[A-Za-z0-9+/_.=-]{6,}"),
    "access": ("AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16,}"),
    "hex": ("[0-9a-f]{24,}", "[0-9a-f]{24,}"),
    "pem": ("-----BEGIN [A-Z]*\\x20?PRIVATE KEY-----", "-----BEGIN [A-Z]*\\x20?PRIVATE KEY-----"),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10,}"),
}
BASE = ("assign", "access", "hex")
#: Rules of one automaton: each has a bit of a long.
MOST = 63
#: Bytes of one code point that is not ASCII: first byte, then how many follow.
_WIDE = ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))
_ASCII = (1 << 128) - 1


def _mask(low: int, high: int) -> int:
    return (1 << high + 1) - (1 << low)


_ESCAPES = {"d": _mask(48, 57), "w": _mask(48, 57) | _mask(65, 90) | _mask(97, 122) | 1 << 95, "s": _mask(9, 13) | 1 << 32}


class Nfa:
    """Thompson's construction over UTF-8 bytes; sets are 256-bit masks. Literals, ., classes (also negated ones), groups,
    | ? * + {n} {n,} {n,m}, escapes of ASCII marks, \\xNN, \\d, \\w and \\s (these of ASCII); anything else is an error."""

    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, text: str) -> tuple[int, int]:
        self.text, self.i = text, 0
        out = self._either()
        if self.i < len(text):
            raise self._error("unbalanced )")
        return out

    def reversed(self) -> Nfa:
        """The same states, every way turned round."""
        out = Nfa()
        for _ in self.moves:
            out.state()
        for x, row in enumerate(self.moves):
            for mask, y in row:
                out.moves[y].append((mask, x))
        for x, row in enumerate(self.free):
            for y in row:
                out.free[y].append(x)
        return out

    def _error(self, what: str) -> ValueError:
        return ValueError(f"{what} at {self.i} in {self.text!r}")

    def _next(self) -> str:
        return self.text[self.i : self.i + 1]

    def _either(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            x, y = self._row()
            self.free[a].append(x)
            self.free[y].append(b)
            if self._next() != "|":
                return a, b
            self.i += 1

    def _row(self) -> tuple[int, int]:
        first = last = self.state()
        while self._next() not in ("", "|", ")"):
            begin = self.i
            x, y = self._atom()
            low, high = self._times()
            end, copies = self.i, [(x, y)]
            for _ in range(max(low, 1 if high is None else high) - 1):
                self.i = begin
                copies.append(self._atom())
            self.i = end
            for n, (p, q) in enumerate(copies):
                self.free[last].append(p)
                if n >= low:  # this one and those behind it may be left out
                    self.free[last].append(copies[-1][1])
                last = q
            if high is None:
                self.free[copies[-1][1]].append(copies[-1][0])
        return first, last

    def _times(self) -> tuple[int, int | None]:
        c = self._next()
        if c and c in "?*+":
            self.i += 1
            times = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif m := re.compile(r"\{(\d+)(?:(,)(\d*))?\}").match(self.text, self.i):
            self.i = m.end()
            times = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
            if times[1] == 0 or times[1] is not None and times[1] < times[0]:
                raise self._error("empty count")
        else:
            return 1, 1
        if self._next() and self._next() in "?*+{":
            raise self._error("repeated repeat")
        return times

    def _one(self, in_class: bool) -> tuple[int, bool]:
        """Mask of the next character or escape, and whether it is one byte."""
        c = self._next()
        self.i += 1
        if c == "\\":
            c = self._next()
            self.i += 1
            if c in _ESCAPES:
                return _ESCAPES[c], False
            if m := re.compile("[0-7][0-9A-Fa-f]").match(self.text, self.i) if c == "x" else None:
                self.i += 2
                return 1 << int(m[0], 16), True
            if c in "nrt" and c:
                return 1 << ord({"n": "\n", "r": "\r", "t": "\t"}[c]), True
            if not c or c.isalnum() or ord(c) > 127:
                raise self._error("unknown escape")
        elif not c or ord(c) > 127 or not in_class and c in "^$*+?{}])":
            raise self._error("cannot build this")
        return 1 << ord(c), True

    def _atom(self) -> tuple[int, int]:
        c = self._next()
        if c == "(":
            self.i += 1
            if self.text.startswith("?:", self.i):
                self.i += 2
            out = self._either()
            if self._next() != ")":
                raise self._error("missing )")
            self.i += 1
            return out
        wide = False
        if c == ".":
            self.i += 1
            mask, wide = _ASCII & ~(1 << 10), True
        elif c == "[":
            self.i += 1
            if wide := self._next() == "^":
                self.i += 1
            mask, empty = 0, True
            while empty or self._next() != "]":
                low, single = self._one(True)
                if self._next() == "-" and self.text[self.i + 1 : self.i + 2] not in ("]", ""):
                    self.i += 1
                    high, other = self._one(True)
                    if not (single and other) or high < low:
                        raise self._error("bad range")
                    low = _mask(low.bit_length() - 1, high.bit_length() - 1)
                mask, empty = mask | low, False
            self.i += 1
            mask = _ASCII & ~mask if wide else mask
        elif c == "" or c > "\x7f":
            if not c:
                raise self._error("nothing to repeat")
            self.i += 1
            x = last = self.state()
            for byte in c.encode():
                y = self.state()
                self.moves[last].append((1 << byte, y))
                last = y
            return x, last
        else:
            mask, _ = self._one(False)
        x, y = self.state(), self.state()
        self.moves[x].append((mask, y))
        for low, high, more in _WIDE if wide else ():  # one code point of several bytes
            last, then = x, _mask(low, high)
            for left in range(more, -1, -1):
                z = self.state() if left else y
                self.moves[last].append((then, z))
                last, then = z, _mask(0x80, 0xBF)
        return x, y


class Dfa:
    """next[state * width + classes[byte]] is the next state times width; accepts has the kinds (bits) by the same number.

    way "scan": state 0 is the start, and a match may begin at any byte. "match": only at the first byte; dead is the state
    without way on. "back": the reversed rules; state 0 has no match under way (dead), and the class inject begins one."""

    def __init__(self, regexes: list[str], way: str):
        if len(regexes) > MOST:
            raise ValueError(f"no more than {MOST} rules in one automaton")
        nfa = Nfa()
        ends: dict[int, int] = {}
        begin = nfa.state()
        pairs = [nfa.add(text) for text in regexes]
        if way == "back":
            nfa = nfa.reversed()
            pairs = [(b, a) for a, b in pairs]
        for k, (a, b) in enumerate(pairs):
            nfa.free[begin].append(a)
            ends[b] = 1 << k
        masks = sorted({m for row in nfa.moves for m, _ in row})
        kinds: dict[tuple, int] = {}
        self.classes = np.array([kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)], np.uint8)
        symbols = len(kinds)
        self.inject, self.width = symbols, symbols + (way == "back")
        sample = {int(c): b for b, c in enumerate(self.classes)}

        def closed(state: int) -> int:
            """The states that can be reached without a byte, as bits; only those that move or end count."""
            seen, todo = {state}, [state]
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return sum(1 << s for s in seen if nfa.moves[s] or s in ends)

        base = closed(begin)
        step = [[(c, closed(t)) for m, t in row for c in range(symbols) if m >> sample[c] & 1] for row in nfa.moves]
        start = 0 if way == "back" else base
        number, order, table, kinds_of = {start: 0}, [start], [], []
        for states in order:
            row, kinds = [base if way == "scan" else 0] * symbols + [states | base] * (way == "back"), 0
            while states:
                s = (states & -states).bit_length() - 1
                states &= states - 1
                kinds |= ends.get(s, 0)
                for c, got in step[s]:
                    row[c] |= got
            for got in row:
                if got not in number:
                    number[got] = len(order)
                    order.append(got)
            table.append([number[got] for got in row])
            kinds_of.append(kinds)
        self._minimise(np.array(table, np.int64), np.array(kinds_of, np.int64))
        loops = (self.next.reshape(-1, self.width)[:, :symbols] == np.arange(len(self.next) // self.width)[:, None] * self.width).all(1) & (self.accepts[:: self.width] == 0)
        self.dead = int(np.flatnonzero(loops)[0]) * self.width if way != "scan" and loops.any() else -1
        self.next_list, self.accept_list, self.class_list = (None, None, None) if way == "scan" else (self.next.tolist(), self.accepts.tolist(), self.classes.tolist())

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Moore's refinement: states stay together while no byte class tells them apart."""
        part = np.unique(accepts, return_inverse=True)[1]
        odd = mix64(np.arange(1, self.width + 1)) | np.uint64(1)
        while True:
            rows = (part[table].astype(np.uint64) * odd).sum(1, dtype=np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            finer = np.unique(mix64(rows), return_inverse=True)[1].ravel()  # 64-bit hashes stand for the rows
            if finer.max() == part.max():
                break
            part = finer
        first = np.unique(part, return_index=True)[1]
        rank = np.argsort(np.argsort(first))  # the start comes first
        part, first = rank[part], np.sort(first)
        self.next = (part[table[first]] * self.width).astype(np.int32).ravel()
        self.accepts = np.repeat(accepts[first], self.width)
        self.size = len(first)

    def hits(self, data: np.ndarray, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of last bytes) and kinds at which something is accepted. The text is cut into lanes that step together;
        a lane whose true start, the end of the lane before it, was another state than assumed is stepped again until
        both ways meet."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        steps = -(-n // lanes)
        cls = np.full(steps * lanes, self.classes[0xFF], np.int32)
        cls[:n] = self.classes[data]
        cls = np.ascontiguousarray(cls.reshape(lanes, steps).T)
        seen = np.empty((steps, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(steps):
            state = self.next[state + cls[t]]
            seen[t] = state
        assumed = np.zeros(lanes, np.int32)
        while True:
            true = np.concatenate([[0], seen[-1, :-1]]).astype(np.int32)
            lane = np.flatnonzero(true != assumed)
            if not len(lane):
                break
            assumed[lane] = true[lane]
            state = true[lane]
            for t in range(steps):
                state = self.next[state + cls[t, lane]]
                apart = state != seen[t, lane]
                lane, state = lane[apart], state[apart]
                if not len(lane):
                    break
                seen[t, lane] = state
        flags = self.accepts[seen]
        t, lane = np.nonzero(flags)
        return lane * steps + t, flags[t, lane]

    def starts(self, data: bytes, ends: list[int]) -> list[int]:
        """Way "back": where the matches start whose last bytes are at ends (rising); each byte is read once at most."""
        nxt, acc, classes, width = self.next_list, self.accept_list, self.class_list, self.width
        out, state, k, i = [], self.dead, len(ends) - 1, -1
        while k >= 0 or state != self.dead:
            if state == self.dead:
                i = ends[k]
            if k >= 0 and ends[k] == i:
                state, k = nxt[state + self.inject], k - 1
            state = nxt[state + classes[data[i]]]
            if acc[state]:
                out.append(i)
            i -= 1
            if i < 0:
                break
        return out[::-1]

    def longest(self, data: bytes, i: int) -> tuple[int, int]:
        """Way "match": the end of the longest match that starts at i (-1: none) and its kinds."""
        nxt, acc, classes, dead = self.next_list, self.accept_list, self.class_list, self.dead
        state, end, kinds, n = 0, -1, 0, len(data)
        while i < n and (state := nxt[state + classes[data[i]]]) != dead:
            i += 1
            if acc[state]:
                end, kinds = i, acc[state]
        return end, kinds


@lru_cache(maxsize=8)
def automata(rules: tuple[tuple[str, str], ...]) -> tuple[list[tuple[int, Dfa]], list[tuple[Dfa, Dfa]]]:
    """The combined automata, one for every MOST rules with the number of its first rule, and for each rule those that walk back and
    that read a match (kind 0: it matches, 1: it counts)."""
    scans = [(low, Dfa([r[0] for r in rules[low : low + MOST]], "scan")) for low in range(0, len(rules), MOST)]
    return scans, [(Dfa([match], "back"), Dfa([match, counts], "match")) for match, counts in rules]


def spans_of(data: bytes, ends: dict[int, list[int]], pairs: list[tuple[Dfa, Dfa]]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points of the leftmost longest matches that count and do not overlap, by start and then rule;
    ends has the last bytes of each rule's matches."""
    found = []
    for rule, own in ends.items():
        back, match = pairs[rule]
        free = 0
        for a in back.starts(data, own):
            if a >= free:
                free, kinds = match.longest(data, a)
                if kinds >> 1:
                    found.append((a, rule, free))
    if not found:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in sorted(found)]


def find_secrets(docs: DataFrame, rules: dict = RULES, key: str = "doc_id") -> DataFrame:
    """key and spans, an array of (kind, start, end) in code points: one row per row of docs, so repeated and null keys too;
    whole texts, however long, null as empty. Other columns are ignored.

    rules: kind to the regex of a match and the regex of those matches that count; neither may match nothing. Up to MOST rules are
    read in one pass over the bytes, more in one pass for every MOST. Texts are kept apart by a byte that UTF-8 does not have,
    so that no match crosses them."""
    for kind, row in rules.items():
        if any(re.fullmatch(r, "") for r in row):
            raise ValueError(f"rule {kind} matches nothing")
    scans, pairs = automata(tuple(tuple(r) for r in rules.values()))
    kinds = list(rules)
    kind_type = dict(docs.dtypes)[key]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            n = batch.num_rows
            apart = np.full(len(data) + n, 0xFF, np.uint8)
            apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
            ends: dict[int, dict[int, list[int]]] = {}
            for low, scan in scans:
                where, flags = scan.hits(apart)
                order = np.argsort(where, kind="stable")
                where, flags = where[order], flags[order]
                doc = np.searchsorted(at[1:] + np.arange(1, n + 1), where, "right")
                where = where - doc - at[doc]  # in its own text
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else ()
                for a, b in zip(first, [*first[1:], len(doc)], strict=False):
                    found = {low + k: own.tolist() for k in range(min(MOST, len(kinds) - low)) if len(own := where[a:b][(flags[a:b] >> k & 1).astype(bool)])}
                    ends.setdefault(int(doc[a]), {}).update(found)
            spans: list[list] = [[] for _ in range(n)]
            for i, own in ends.items():
                spans[i] = [{"kind": kinds[k], "start": s, "end": e} for s, k, e in spans_of(data[at[i] : at[i + 1]].tobytes(), own, pairs)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(spans, spans_type)], names=[key, "spans"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind_type}, spans array<struct<kind:string,start:long,end:long>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(of(BASE)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
