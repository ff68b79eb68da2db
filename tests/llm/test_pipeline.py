"""Every stage of the pipeline against a brute-force version of it on that stage's own input."""

import corpus_pipeline
from test_corpus import shingles

from tabulon.llm import nbsvm
from tabulon.llm.common import materialize, read_table


def words(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def test_stages(spark, small):
    docs = read_table(spark, small, "documents")
    items = {r.item_id: words(r.text) for r in read_table(spark, small, "benchmark").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, small))
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            break
        assert out.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r for r in after}
        if name == "quality classifier":
            good = {r.doc_id for r in nbsvm.quality(docs, read_table(spark, small, "labels")).where("predicted = 1").collect()}
            assert set(after) == good and all(after[d] == before[d] for d in good)
        elif name == "line dedup":
            first = {}
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            for d in sorted(before):
                for x in before[d].text.split("\n"):
                    first.setdefault(key(x), d)
            want = {d: "\n".join(x for x in r.text.split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, r in before.items()}
            assert {d: r.text for d, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "n-gram Jaccard join":
            sets = {d: shingles(r.text) for d, r in before.items()}
            group = {d: d for d in sets}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            for _ in range(len(links) + 1):
                for a, b in links:
                    group[a] = group[b] = min(group[a], group[b])
            assert set(after) == {d for d in group if group[d] == d}
        else:
            leaked = set()
            for d, r in before.items():
                w = words(r.text)
                runs = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
                for item in items.values():
                    own = [tuple(item[i : i + 8]) for i in range(len(item) - 7)]
                    if own and sum(x in runs for x in own) >= 0.5 * len(own):
                        leaked.add(d)
            assert set(after) == set(before) - leaked
        docs = out


def test_rows_that_share_a_hash_are_told_apart(spark):
    rows = [(k % 40 if k % 7 else None, f"text {k % 25}" if k % 11 else None) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (3, 64):
        for columns in (["doc_id", "text"], ["text"]):
            out = corpus_pipeline.with_row(docs, *columns, bits=bits).collect()
            assert len(out) == 200
            names = {}
            for r in out:
                names.setdefault(r["_row"], set()).add(tuple(r[c] for c in columns))
            assert all(len(v) == 1 for v in names.values()) and len(names) == len({tuple(r[c] for c in columns) for r in out})
