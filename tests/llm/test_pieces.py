import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "b", "the", "ing", "\n", "\t", "▁", "日", "本", "é", "é", "\0", "\U0001f600", "tion", "'", "23", ".", " " * 7, "<s>", "</s>", "<0x41>", "�", "т", "ре"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_as_library(text):
    text = text.encode("utf-8", "ignore").decode()
    own, library = pieces.piece_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = library.encode(text)
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.sampled_from([28705, 259, 200, 229])), max_size=10))
def test_any_ids_decode(ids):
    assert pieces.piece_model(PATH).decode(ids) == sentencepiece.SentencePieceProcessor(model_file=PATH).decode(ids)


def test_walk_along_borders_is_merging_again():
    own = pieces.piece_model(PATH)
    assert own.walks
    some = sorted(own.shorter)[::97]
    for a in some:
        for b in some[::7]:
            assert own._compatible(a, b) == (own.merge([*a, *b], len(a)) is not None)


def test_memo_keeps_to_its_bound():
    memo = pieces.Memo(lambda s: s.encode(), max_bytes=3000)
    for k in range(500):
        assert memo[f"w{k % 30}"] == f"w{k % 30}".encode()
        assert len(memo) + len(memo.old) < 40


def test_odd_rows(spark, library):
    texts = [None, "", " ", "one two  three", "one two  three", "x" * 30000, "日本" * 5000, "a\0b\n\n c", " " * 5000]
    rows = spark.createDataFrame([(k if k else None, t, "mine", k) for k, t in enumerate(texts)], "doc_id long, text string, ids string, row int")
    got = pieces.decode(pieces.encode(rows, PATH), PATH).orderBy("row").collect()
    assert [list(r.ids) for r in got] == [library.encode(t or "") for t in texts]
    assert [r.decoded for r in got] == [library.decode(library.encode(t or "")) for t in texts]
    assert [r.text for r in got] == texts
    assert pieces.encode(rows.limit(0), PATH).count() == 0


def test_query(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {}
    for k, t in texts.items():
        ids = library.encode(t)
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.query(spark, small).collect()} == want
