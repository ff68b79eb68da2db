"""String and vector similarity. Levenshtein is built in; Jaro-Winkler and the common-subsequence ratio run as Arrow UDFs,
meant for distinct pairs."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; null if both are empty."""
    return F.nullif(F.size(F.array_intersect(a, b)), F.lit(-1)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if one of them is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def affinity(similarity: Column, sigma: float = 0.5) -> Column:
    return F.exp(-((1 - similarity) ** 2) / (2 * sigma**2))


def _jaro(a: str, b: str) -> float:
    reach, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2  # whole transpositions
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity plus scale for each of up to four equal first letters; 0.1 for two empty strings, 0 for one."""
    if not a or not b:
        return 0.1 if a == b else 0.0
    s, p = _jaro(a, b), 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return s + p * scale * (1 - s)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bit-parallel steps."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = at.get(c, 0) & row
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in whole percent; 0.1 for two empty strings, 0 for one."""
    if not a or not b:
        return 0.1 if a == b else 0.0
    return round(200 * common_subsequence(a, b) / (len(a) + len(b))) / 100


def _udf(f):
    def over(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: dict = {}
        return pd.Series([seen[p] if (p := (a or "", b or "")) in seen else seen.setdefault(p, f(*p)) for a, b in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(over, "double")


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _udf(jaro_winkler)(a, b)


def ratio_column(a: Column, b: Column) -> Column:
    return _udf(ratio)(a, b)


class SuffixAutomaton:
    """All substrings of a text, as the states of a smallest automaton: built and walked in time that follows the texts' lengths."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            own = self._state(self.size[last] + 1, {}, 0)
            p, last = last, own
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = own
                p = self.link[p]
            if p < 0:
                continue
            q = self.next[p][c]
            if self.size[q] == self.size[p] + 1:
                self.link[own] = q
                continue
            clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
            self.link[own] = self.link[q] = clone
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = clone
                p = self.link[p]

    def _state(self, size: int, steps: dict[str, int], link: int) -> int:
        self.next.append(steps)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def longest_in(self, text: str) -> str:
        """The longest substring that text has too, the first in text of equals."""
        state = n = best = end = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if n > best:
                best, end = n, i + 1
        return text[end - best : end]


def longest_common_substring(a: str, b: str) -> str:
    return SuffixAutomaton(b).longest_in(a)


def _over_pairs(f, kind: str):
    """f of two texts as a column function; texts of b that come again in a batch share their automaton."""
    def over(x: pd.Series, y: pd.Series) -> pd.Series:
        own: dict[str, SuffixAutomaton] = {}
        return pd.Series([f((own[b] if b in own else own.setdefault(b, SuffixAutomaton(b))).longest_in(a)) if a is not None and b is not None else None for a, b in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(over, kind)


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring; null if a text is null."""
    return _over_pairs(len, "int")(a, b)


def common_substring_text(a: Column, b: Column) -> Column:
    """The longest common substring, the first in a of equals; null if a text is null."""
    return _over_pairs(str, "string")(a, b)


def _prefix_lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequences of a and every prefix of b, in bit-parallel steps."""
    at: dict = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        m = at.get(c, 0) & row
        row = (row + m | row - m) & full
    out = [0]
    for bit in reversed(format(row, f"0{len(b)}b") if b else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def _common_of_two(a: list, b: list) -> list:
    """A longest common subsequence of two, by halving a where both halves together have most: memory follows the lengths."""
    if not a or not b:
        return []
    if len(a) == 1:
        return a if a[0] in b else []
    mid = len(a) // 2
    head, tail = _prefix_lengths(a[:mid], b), _prefix_lengths(a[mid:][::-1], b[::-1])[::-1]
    cut = max(range(len(b) + 1), key=lambda j: head[j] + tail[j])
    return _common_of_two(a[:mid], b[:cut]) + _common_of_two(a[mid:], b[cut:])


def _suffix_table(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of all suffixes of two texts."""
    codes = {c: i for i, c in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[c] for c in b], np.int64)
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = table[i + 1].copy()
        row[:-1] = np.maximum(row[:-1], table[i + 1, 1:] + (y == codes[a[i]]))
        table[i] = np.maximum.accumulate(row[::-1])[::-1]
    return table


def common_subsequence_of(texts: list, most: int = 50_000) -> list:
    """A longest common subsequence of texts or token lists.

    Two are solved by halving. More are searched (the first of equals in the order of symbols is returned) in layers of reached places, one layer per length: a place goes no further if what
    is left of any two neighbouring texts cannot beat the best found, to begin with by a narrow search. A layer of more than most
    places is not kept: each of its places is then followed in depth by itself, with the same bounds, so that memory stays bounded
    and the result is exact (the time to find it may grow without bound, as the problem is hard in the number of texts)."""
    if not texts or not all(texts):
        return []
    lists = [list(t) for t in texts]
    if len(lists) == 1:
        return lists[0]
    if len(lists) == 2:
        return _common_of_two(*lists)
    symbols = sorted(set(lists[0]).intersection(*lists[1:]))
    lists = [[x for x in t if x in set(symbols)] for t in lists]
    places = [{s: [j for j, x in enumerate(t) if x == s] for s in symbols} for t in lists]
    tables = [_suffix_table(a, b) if len(a) * len(b) <= 30_000_000 else None for a, b in zip(lists, lists[1:], strict=False)]

    def bound(at: tuple) -> int:
        return min([len(t) - i - 1 for t, i in zip(lists, at, strict=True)] + [int(t[at[j] + 1, at[j + 1] + 1]) for j, t in enumerate(tables) if t is not None])

    def steps(at: tuple) -> list[tuple]:
        out = []
        for s in symbols:
            step = []
            for own, i in zip(places, at, strict=True):
                k = bisect_right(own[s], i)
                if k == len(own[s]):
                    break
                step.append(own[s][k])
            else:
                out.append((tuple(step), s))
        return out

    def spelled(link) -> list:
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return out[::-1]

    start = tuple(-1 for _ in lists)
    layer, best, depth = {start: None}, None, 0
    while layer:  # a narrow search first
        reached = {to: (s, link) for at, link in layer.items() for to, s in steps(at)}
        layer = dict(sorted(reached.items(), key=lambda x: -bound(x[0]))[:40])
        depth += bool(layer)
    found = depth - 1  # what is as long as its find is looked for again, in the order of symbols
    layer, depth = {start: None}, 0
    while layer and len(layer) <= most:
        reached = {}
        for at, link in layer.items():
            for to, s in steps(at):
                if to not in reached and depth + 1 + bound(to) > found:
                    reached[to] = (s, link)
        layer, depth = reached, depth + 1
        if layer and depth > found:
            found, best = depth, next(iter(layer.values()))
    for root, link in layer.items():  # a layer too large: in depth
        stack = [(root, link, depth)]
        while stack:
            at, link, n = stack.pop()
            if n > found:
                found, best = n, link
            if n + bound(at) > found:
                stack += [(to, (s, link), n + 1) for to, s in reversed(steps(at))]
    return spelled(best)


def common_subsequence_column(texts: Column) -> Column:
    """A longest common subsequence of the texts of an array column."""
    def over(x: pd.Series) -> pd.Series:
        return pd.Series(["".join(common_subsequence_of([t or "" for t in row])) if row is not None else None for row in x], dtype=object)

    return F.pandas_udf(over, "string")(texts)
