"""I-Match against a plain version of it: lexicon, subsets, codes, likeness, order of rows that share an id."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash

from tabulon.llm import imatch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(text, *lead):
    seed = 42
    for x in lead:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(4, "little"), seed)
    return signed(xxhash.xxh64_intdigest(text.encode(), seed))


def long_hash(values, *ints):
    seed = 42
    for x in values:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed)
    for x in ints:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(4, "little"), seed)
    return signed(seed)


def plain_terms(text):
    return {text_hash(w) for w in re.findall(r"[^\W_]+", text.lower())}


def plain_codes(text, words):
    own, out = sorted(plain_terms(text) & words), []
    for j, rate in enumerate(imatch.RATES):
        some = [t for t in own if long_hash([t], j) % (1 << rate) == 0]
        out.append(long_hash(some) % 65535 + 1 if some else 0)
    return out


def like(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


@pytest.mark.parametrize("rows_a_bucket", [4000, 5])
def test_against_plain(spark, rows_a_bucket):
    draw = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(120)]
    weight = 1 / np.arange(1, 121)
    rows = [(int(i) if i % 9 else None, " ".join(draw.choice(vocabulary, draw.integers(1, 60), p=weight / weight.sum()))) for i in range(60)]
    rows += [(7, "one more text under this id word50 word51"), (7, "and another word52"), (7, "and another word52"), (100, None), (101, ""), (1 << 60, "far off word50"), (30, rows[30][1])]
    low, high = 0.05, 0.3
    texts = [(d, t or "") for d, t in rows]
    count = {}
    for _, t in texts:
        for x in plain_terms(t):
            count[x] = count.get(x, 0) + 1
    words = {t for t, n in count.items() if max(2, math.ceil(low * len(texts))) <= n <= math.floor(high * len(texts))}
    assert words
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]), text_hash(r[1], 7)))
    want = []
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, g, h = (plain_codes(x, words) for x in (t, edited, after))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04x}" for x in f), "".join(f"{x:04x}" for x in g), like(f, g), like(f, h)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in imatch.fingerprints(docs, low, high, rows_a_bucket).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(set(x[3]) == {"0"} for x in want) > 0 and any(x[3] != "0" * len(x[3]) for x in want)
