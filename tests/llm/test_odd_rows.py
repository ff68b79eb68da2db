"""Every operator and stage on a table with null ids, nulls in every column, repeated rows, a very long text and columns
whose names clash with those of the results."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from tabulon.llm import hash_tree, imatch, line_runs, nbsvm, packing, partenum, secrets_dfa, suffix_levels, templates, url_rules

PATH = public_tokenizers.path("word_bpe_49k.json")
BIG = (1 << 60) + 1
TEXT = "the lamp in the old harbour was lit by hand every evening until the keeper moved to town"
LONG = " ".join(f"word{i % 5000}" for i in np.random.default_rng(5).integers(0, 10**6, 60_000))
#: doc_id, text, then columns that clash.
ROWS = [(None, None), (None, TEXT), (None, TEXT), (1, TEXT), (1, TEXT), (2, TEXT), (3, None), (4, ""), (5, LONG), (BIG, LONG + " end"), (BIG + 1, "\n \n\t\n"), (BIG + 2, "short")]
CLASH = "component long, spans string, kept string, score string, predicted string, shard string, slot string, size string, n_lines string, h1 long, v long, g long, bucket int, h long"


@pytest.fixture(scope="module")
def odd(spark):
    n = CLASH.count(",") + 1
    rows = [(d, t, None, None, None, *[None] * n) for d, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


WHOLE = sorted((d for d, _ in ROWS), key=lambda x: (x is not None, x))


@pytest.mark.parametrize(
    "run",
    [partenum.near_duplicates, line_runs.dedup_lines, suffix_levels.cut_repeats, imatch.fingerprints, secrets_dfa.find_secrets, lambda d: hash_tree.shard_documents(d, hash_tree.Tree.regular(40))],
    ids=["partenum", "line_runs", "suffix_levels", "imatch", "secrets", "hash_tree"],
)
def test_one_row_each(odd, run):
    assert ids(run(odd)) == WHOLE


def test_groups(odd):
    """Rows without id belong to the group of their text."""
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(d, n, c) for d, n, c in [(None, 0, None), (None, 14, 1), (None, 14, 1), (1, 14, 1), (1, 14, 1), (2, 14, 1), (3, 0, 3), (4, 0, 4), (BIG + 1, 0, BIG + 1), (BIG + 2, 1, BIG + 2), (5, 59996, 5), (BIG, 59997, 5)]], key=str)


def test_lines(odd):
    """Rows without id come first: they keep a line that others have too."""
    got = sorted(((r.doc_id, r.text) for r in line_runs.dedup_lines(odd).collect()), key=str)
    gone = {1, 2}
    assert got == sorted(((d, "" if d in gone else t or "") for d, t in ROWS), key=str)


def test_spans(odd):
    """Rows without id lose nothing and take nothing from others; a repeated id is one document."""
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_levels.cut_repeats(odd).collect()), key=str)
    lost = {2: len(TEXT), BIG: len(LONG)}
    # of the longer text the last run that starts in both ends with LONG
    assert got == sorted(((d, len(t or ""), lost.get(d, 0), int(d in lost)) for d, t in ROWS), key=str)


def test_slots(odd):
    by = {}
    for r in hash_tree.shard_documents(odd, hash_tree.Tree.regular(40)).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_packing(odd):
    rows = packing.pack(odd, PATH, capacity=512, group_docs=4).collect()
    assert {r.doc_id for r in rows} == set(WHOLE)
    total = {d: 0 for d in WHOLE}
    for r in rows:
        total[r.doc_id] += r.length
    for d in (1, None):
        assert total[d] == sum(r.doc_tokens for r in rows if r.doc_id == d and r.start == 0)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 512


def test_quality(spark, odd):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 0, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    out = nbsvm.quality(odd, labels)
    assert ids(out) == WHOLE and out.where("score is null or not score between 0 and 1").count() == 0


def test_leaks(spark, odd):
    items = spark.createDataFrame([(1, TEXT, 0), (1, TEXT, 0), (None, TEXT, 0), (2, None, 0), (3, "", 0)], "item_id long, text string, h long")
    assert {(r.doc_id, r.item_id) for r in templates.find_leaks(odd, items).collect()} == {(1, 1), (2, 1)}


def test_urls(spark):
    pages = spark.createDataFrame([(None, None, "a", "b"), (1, "http://x.net/", "a", "b"), (1, "http://x.net/", "a", "b"), (2, "", None, None), (3, "://", None, None), (4, "http://y.net/" + "z" * 200_000, None, None)], "page_id long, url string, host string, rule string")
    out = url_rules.judge_urls(pages)
    assert sorted((r.rule or "") for r in out.collect()) == ["", "", "", "net/", "net/", "net/"] and sorted(out.columns) == sorted(["page_id", "url", "host", "path", "rule", "verdict"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, small, odd, name):
    """Rows without id pass all stages but those that judge the text or the row alone."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, small)
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    if name != "quality classifier":
        assert out.where("doc_id is null").count() == 3
