"""Jaro-Winkler between a block of values and a block of targets, over whole arrays of pairs, best bounds first."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..functions.similarity import jaro_winkler

#: Pairs, or entries of a matrix of bounds, that are held at once.
AT_ONCE = 1 << 20
#: Distances are told apart to nine digits; bounds are this much wider.
SLACK = 2e-9
_ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


class Block:
    """Texts by class: texts of the same letters and the same first four share all bounds."""

    def __init__(self, texts: list[str], letters: dict[str, int]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        of: dict[tuple[str, str], int] = {}
        self.cls = np.array([of.setdefault(("".join(sorted(t)), t[:4]), len(of)) for t in texts], np.int64)
        self.by_class = np.argsort(self.cls, kind="stable")
        self.size = np.bincount(self.cls, minlength=len(of))
        self.start = np.cumsum(self.size) - self.size
        self.counts = np.zeros((len(of), len(letters) + 1), np.int16)
        for k, (own, _) in enumerate(of):
            np.add.at(self.counts[k], [letters.get(c, len(letters)) for c in own], 1)
        self.counts = self.counts[:, :-1]
        self.first = np.array([[ord(c) for c in head] + [0] * (4 - len(head)) for _, head in of], np.int64).reshape(-1, 4)
        self.wide = np.array([len(own) for own, _ in of], np.int64)
        self.codes = np.full((max(self.length, default=0), len(texts)), len(letters), np.int64)
        for k, t in enumerate(texts):
            self.codes[: len(t), k] = [letters.get(c, len(letters)) for c in t]

    def places(self, kinds: int) -> np.ndarray:
        """By text and letter: the places of the letter, as bits; only for texts of up to 64 letters."""
        out = np.zeros((len(self.texts), kinds + 1), np.uint64)
        for i in range(min(64, len(self.codes))):
            some = np.flatnonzero((self.length > i) & (self.length <= 64))
            out[some, self.codes[i, some]] |= np.uint64(1 << i)
        out[:, kinds] = 0  # letters that only one side has
        return out.ravel()


def bounds(a: Block, rows: slice, b: Block) -> np.ndarray:
    """By class of a and class of b: the most their score can be, from the letters they share and their first letters; 0 without any."""
    mine, shape = a.counts[rows], (len(a.wide[rows]), len(b.wide))
    shared = np.zeros(shape, np.int16)
    for k in range(b.counts.shape[1]):
        p, q = np.flatnonzero(mine[:, k]), np.flatnonzero(b.counts[:, k])
        if 2 * len(p) * len(q) > shared.size:
            shared += np.minimum(mine[:, k, None], b.counts[None, :, k])
        elif len(p) and len(q):
            shared[np.ix_(p, q)] += np.minimum(mine[p, k, None], b.counts[None, q, k])
    one, two = np.maximum(a.wide[rows], 1)[:, None], np.maximum(b.wide, 1)[None]
    score = (shared / one + shared / two + 1) / 3
    same, lift = np.ones(shape, bool), np.zeros(shape, np.int8)
    for k in range(4):
        same &= (a.first[rows, k, None] == b.first[None, :, k]) & (a.first[rows, k, None] > 0)
        lift += same
    return np.where(shared > 0, score + 0.1 * lift * (1 - score), 0.0)


def scores(a: Block, x: np.ndarray, b: Block, y: np.ndarray, places: np.ndarray, kinds: int) -> np.ndarray:
    """jaro_winkler() of the pairs of texts x of a and y of b; the same steps, letter by letter over all pairs at once. Used places are
    bits of a word, so that targets of over 64 letters are compared one by one."""
    out, long = np.zeros(len(x)), b.length[y] > 64
    for k in np.flatnonzero(long):
        out[k] = jaro_winkler(a.texts[x[k]], b.texts[y[k]])
    if long.any():
        x, y = x[~long], y[~long]
    if not len(x):
        return out
    n, m, at = a.length[x], b.length[y], y * (kinds + 1)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    if (reach == reach[0]).all() and (m == m[0]).all():
        reach, far = reach[:1], m[:1]
    else:
        far = m
    used, hit = np.zeros(len(x), np.uint64), []
    for i in range(n.max()):
        high = np.minimum(far, i + reach + 1)
        low = np.minimum(np.maximum(0, i - reach), high)
        free = places[at + a.codes[i, x]] & (_ONES[high] ^ _ONES[low]) & ~used
        bit = free & (~free + np.uint64(1))
        used |= bit
        hit.append(bit != 0)
    hits, odd, left = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), used
    for i, own in enumerate(hit):
        bit = left & (~left + np.uint64(1))
        odd += own & ((places[at + a.codes[i, x]] & bit) == 0)
        hits += own
        left = np.where(own, left ^ bit, left)
    some = np.maximum(hits, 1)
    jaro = np.where(hits > 0, (hits / n + hits / m + (hits - odd // 2) / some) / 3, 0.0)
    first_a, first_b = a.first[a.cls[x]], b.first[b.cls[y]]
    lift = np.cumprod((first_a == first_b) & (first_a > 0), axis=1).sum(1)
    out[~long] = jaro + lift * 0.1 * (1 - jaro)
    return out


def closest(values: list[str], targets: list[str], steps: tuple[float, ...], start: np.ndarray | None = None, top_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place of the target) for each value: of targets in their order, the first of the least distance to nine digits. Values
    keep to pairs that can come as near as start. top_only stops after each value's highest bound, which need not find its best.

    Bounds are taken from the highest down, those under the next of steps only for values that are not settled before."""
    letters: dict[str, int] = {}
    for c in sorted(set("".join(values)) & set("".join(targets))):
        letters[c] = len(letters)
    kinds = len(letters)
    a, b = Block(values, letters), Block(targets, letters)
    places = b.places(kinds)
    best, where = np.ones(len(values)), np.zeros(len(values), np.int64)
    empty = targets.index("") if "" in targets else None
    if empty is not None:
        none = a.length == 0
        best[none], where[none] = 0.9, empty
    limit = np.minimum(best, start) if start is not None else best.copy()
    height = max(1, 4 * AT_ONCE // max(1, len(b.wide)))

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        d = np.round(1 - scores(a, x, b, y, places, kinds), 9)
        near = d <= limit[x] + SLACK
        x, y, d = x[near], y[near], d[near]
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
        x, y, d = x[first], y[first], d[first]
        better = (d < best[x]) | ((d == best[x]) & (y < where[x]))
        best[x[better]], where[x[better]] = d[better], y[better]
        limit[x] = np.minimum(limit[x], d)

    for begin in range(0, len(a.wide), height):
        most = bounds(a, slice(begin, begin + height), b)
        inside = a.by_class[(a.cls[a.by_class] >= begin) & (a.cls[a.by_class] < begin + height)]
        own = a.cls[inside] - begin
        ceiling = most.max(1) if most.shape[1] else np.zeros(len(most))
        before = np.full(len(most), np.inf)
        for step in (*steps, 0.0) if not top_only else (0.0,):
            worst = np.full(len(most), -np.inf)
            np.maximum.at(worst, own, limit[inside])
            low = np.maximum(np.maximum(step, 1 - worst - SLACK), ceiling if top_only else 0.0)
            u, v = np.nonzero((most >= low[:, None]) & (most < before[:, None]) & (most > 0))
            before = np.minimum(before, low)
            if not len(u):
                continue
            bound = most[u, v]
            order = np.lexsort((-bound, u))
            u, v, bound = u[order], v[order], bound[order]
            fresh = np.r_[True, u[1:] != u[:-1]]
            rise = np.cumsum(fresh | np.r_[True, bound[1:] != bound[:-1]])
            level = rise - rise[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            order = np.argsort(level, kind="stable")
            u, v, bound, level = u[order], v[order], bound[order], level[order]
            ends = np.searchsorted(level, np.arange(level[-1] + 2))
            for p, q in zip(ends[:-1], ends[1:], strict=True):
                reachable = np.full(len(most), -np.inf)
                reachable[u[p:q]] = bound[p:q]
                active = limit[inside] + SLACK >= 1 - reachable[own]
                if not active.any():
                    if (limit[inside] + SLACK < 1 - ceiling[own]).all():
                        break
                    continue
                rows, size = inside[active], np.bincount(own[active], minlength=len(most))
                offset = np.cumsum(size) - size
                many = size[u[p:q]] * b.size[v[p:q]]
                end = np.cumsum(many)
                for s in range(0, int(end[-1]), AT_ONCE):
                    pair = np.arange(s, min(s + AT_ONCE, int(end[-1])))
                    e = np.searchsorted(end, pair, "right")
                    pair -= (end - many)[e]
                    i, j = np.divmod(pair, b.size[v[p:q]][e])
                    compare(rows[offset[u[p:q]][e] + i], b.by_class[b.start[v[p:q]][e] + j])
    return best, where


def closest_rows(a: pd.DataFrame, b: pd.DataFrame, steps: tuple[float, ...], top_only: bool) -> pd.DataFrame:
    """(value, d, ord, target) for the rows (value, start) of a against the rows (target, ord) of b."""
    if not len(a) or not len(b):
        return pd.DataFrame({"value": a["value"][:0], "d": np.zeros(0), "ord": b["ord"][:0], "target": b["target"][:0]})
    b = b.sort_values(["ord", "target"], na_position="first", ignore_index=True)
    start = None if a["start"].isna().all() else a["start"].fillna(1.0).to_numpy(float)
    d, at = closest(a["value"].tolist(), b["target"].tolist(), steps, start, top_only)
    return pd.DataFrame({"value": a["value"].to_numpy(), "d": d, "ord": b["ord"].to_numpy()[at], "target": b["target"].to_numpy()[at]})
