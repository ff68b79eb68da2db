import hashlib
import math
import re
import zlib

from tabulon.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def found(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % 10000 for r in runs], len(words)


def plain(docs, target, share=0.05, least=20):
    own = [(k, *found(t)) for k, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, b, _ in own:
        for x in b:
            s[x] += 1
    for text in target:
        for x in found(text)[0]:
            t[x] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for k, b, n in own:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in b)
        rows.append((k, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: math.floor(share * len(able))])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    out = rows(resample.query(spark, small))
    assert out == plain(docs, target)
    assert sum(r[4] is not None for r in out) > 3


def test_odd_rows(spark):
    words = "Alpha beta gamma Ünï ÉA x1 ".split()
    texts = [None, "", "...", "one", "one two", "x" * 50000] + [" ".join(words[(k * j) % 6] for j in range(k + 15)) for k in range(40)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[20])]
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in docs], "doc_id long, text string, id string, part int")
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "item_id long, text string")
    assert rows(resample.resample(df, target, share=0.3)) == plain(docs, ["alpha beta gamma", None], 0.3)
    assert resample.resample(df.limit(0), target).count() == 0
    assert rows(resample.resample(df, target.limit(0), share=0.3)) == plain(docs, [], 0.3)


def test_repeated_rows_have_ranks_of_their_own(spark):
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame([(7, text)] * 300 + [(8, text)], "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    ranks = sorted(r.rank for r in resample.resample(df, target, share=0.5).collect() if r.rank)
    assert ranks == list(range(1, 151))


def test_blocks_are_bounded(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = resample.column_sums(resample.count_blocks(docs, "doc_id"))
    monkeypatch.setattr(resample, "BLOCK_ENTRIES", 500)
    blocks = resample.count_blocks(docs, "doc_id").collect()
    assert len(blocks) > 20 and sum(len(b.ids) for b in blocks) == docs.count()
    assert all(len(b.indptr) == len(b.ids) + 1 and b.indptr[-1] == len(b.indices) == len(b.data) for b in blocks)
    assert sum(sum(b.data) for b in blocks) == whole.sum()
