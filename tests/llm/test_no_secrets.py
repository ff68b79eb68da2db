"""A table none of whose texts has a match."""

from tabulon.llm import secrets_dfa


def test_no_match_at_all(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.spans) for r in secrets_dfa.find_secrets(docs).collect()) == [(1, []), (2, []), (3, [])]
