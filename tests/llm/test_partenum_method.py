"""PartEnum: subsets of second-level partitions are what links meet by; other thresholds; sets whose codes collide."""

import re

import numpy as np
import pytest
from test_corpus import shingles

from tabulon.llm import partenum


def test_only_subsets_agree():
    """Two sets that differ by one feature in every first-level partition, which only subsets can see past."""
    percent, m = 80, 127
    band = m.bit_length() - 1
    n = partenum.first_level(band, percent)
    draw = np.random.default_rng(3)
    width = (1 << 64) // (n * partenum.THIRDS)
    # the features of a stand well inside second-level partitions; b lacks the last one of each first-level partition
    rows = [[(p * partenum.THIRDS + j) * width + int(draw.integers(width // 4, width // 2)) for j in range(partenum.THIRDS) for _ in range(3)] for p in range(n)]
    a = np.sort(np.array([x for row in rows for x in row], np.uint64))[:m]
    b = np.sort(np.array([x for row in rows for x in row[:-1]], np.uint64))
    b = b[np.isin(b, a)]
    common = len(np.intersect1d(a, b))
    assert 100 * common >= percent * (len(a) + len(b) - common)
    part = lambda s: (((s >> np.uint64(32)) * np.uint64(n * partenum.THIRDS)) >> np.uint64(32)) // np.uint64(partenum.THIRDS)
    assert all(set(a[part(a) == p]) != set(b[part(b) == p]) for p in np.unique(part(a))[:-1])
    assert set(partenum.signatures(a, percent)) & set(partenum.signatures(b, percent))


@pytest.mark.parametrize("percent", [50, 60, 70, 75, 80, 90])
def test_links_at_the_limit_meet(percent):
    draw = np.random.default_rng(percent)
    for m in (1, 2, 3, 4, 5, 7, 9, 15, 31, 33, 64, 127, 130, 500):
        for band in partenum.bands(m, percent):
            low = -(-m * percent // 100) if band == m.bit_length() - 1 else 1 << band
            for other in range(low, min(m * 100 // percent, (2 << band) - 1) + 1, max(1, m // 12)):
                common = -(-percent * (m + other) // (100 + percent))
                if common <= min(m, other):
                    pool = np.unique(draw.integers(0, 2**64, 2 * (m + other), dtype=np.uint64))
                    pool = draw.permutation(pool)
                    a, b = np.sort(pool[:m]), np.sort(np.concatenate([pool[:common], pool[m : m + other - common]]))
                    assert set(partenum.signatures(a, percent)) & set(partenum.signatures(b, percent)), (m, other)


def plain(rows, percent):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return {d: (len(s), min(rows[k][0] for k in range(len(rows)) if group[k] == group[i])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


@pytest.mark.parametrize("percent,bits", [(70, 63), (80, 6)])
def test_components(spark, percent, bits):
    """Short and long texts that lose or change some words; with codes of 6 bits most sets share theirs with others."""
    draw, rows = np.random.default_rng(percent), []
    words = [f"w{i}" for i in range(300)]
    for n in (2, 5, 6, 7, 8, 9, 12, 30, 80, 200):
        for _ in range(3):
            base = list(draw.choice(words, n))
            rows.append(base)
            for _ in range(3):
                copy = list(base)
                for _ in range(int(draw.integers(0, max(2, n // 15)))):
                    copy[int(draw.integers(0, len(copy)))] = str(draw.choice(words))
                rows.append(copy[: len(copy) - int(draw.integers(0, max(2, n // 8)))] or copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, bits=bits).collect()}
    assert got == plain(rows, percent)
    assert re.match("w", rows[0][1])
