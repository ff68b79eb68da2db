"""Benchmark items that a document holds in other surroundings, cases or with one value changed."""

from tabulon.llm import templates

LONG = "Alice paid 12 euros for 3 kg of apples and then walked back home with Bob along the river before 7 pm"


def leaks(spark, docs, *items):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect())


def test_case_and_word_before(spark):
    docs = [(1, 'he asked, "What is the capital of France?"'), (2, LONG.lower()), (3, f"so {LONG.upper()} then"), (4, "what is the capital of a firm")]
    assert leaks(spark, docs, "What is the capital of France?", LONG) == [(1, 0), (2, 1), (3, 1)]


def test_conflicting_value(spark):
    """One changed value takes its own windows out, not the whole passage."""
    item = f"the crew of 12 sailed at dawn with bread and water for the long way, {LONG}"
    docs = [(1, item.replace("crew of 12", "crew of 15")), (2, LONG.replace("12", "45").replace("7 pm", "9 pm")), (2, LONG.replace("12", "46").replace("7 pm", "8 pm")), (3, "Alice paid 12 euros for 3 kg of apples and then went away")]
    assert leaks(spark, docs, item, LONG) == [(1, 0), (1, 1), (2, 1)]
