"""Rows that share an id but not a text, levels that are read again, and columns of awkward names."""

import pytest

from tabulon.llm import line_runs, suffix_levels

ONE = "common long line one, with so many words that it has more than fifty bytes"
TWO = "another unique line, which stands once in all of this table, whatever its row"


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_of_one_id(spark, batches):
    docs = spark.createDataFrame([(1, ONE), (2, ONE), (2, TWO), (2, f"{TWO} too\n{ONE}"), (3, f"{TWO}\n{TWO}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_runs.dedup_lines(docs, batches=batches).collect())
    assert got == sorted([(1, ONE, 0), (2, "", 1), (2, TWO, 0), (2, f"{TWO} too", 1), (3, "", 2)])


@pytest.mark.parametrize("hot", [10_000, 1])
def test_bytes_of_one_id(spark, hot):
    docs = spark.createDataFrame([(1, ONE), (2, ONE), (2, TWO), (2, TWO + ONE), (3, TWO), (4, "x" + TWO), (5, "y" + TWO)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_levels.cut_repeats(docs, hot=hot).collect())
    a, b = len(ONE), len(TWO)
    assert got == sorted([(1, a, 0, 0), (2, a, a, 1), (2, b, 0, 0), (2, a + b, a, 1), (3, b, b, 1), (4, b + 1, b, 1), (5, b + 1, b, 1)])


def test_line_columns(spark):
    docs = spark.createDataFrame([(1, ONE, 1, 2, 3, "a"), (2, ONE, 4, 5, 6, "b")], "doc_id long, text string, _id int, _at int, others int, `x.y` string")
    got = sorted(tuple(r) for r in line_runs.dedup_lines(docs).collect())
    assert got == [(1, ONE, 1, 2, 3, "a", 1, 0), (2, "", 4, 5, 6, "b", 1, 1)]


def test_compacted_runs_are_read(spark, monkeypatch):
    """Lines whose first holder lies in a compacted run: with it taken out, they would stay."""
    docs = spark.createDataFrame([(i, f"{ONE}\nline of document {i % 4} and its like") for i in range(20)], "doc_id long, text string")
    levels = []

    class Seen(line_runs.Runs):
        def all(self):
            levels.append([len(x) for x in self.levels])
            return super().all()

    monkeypatch.setattr(line_runs, "Runs", Seen)
    got = {r.doc_id: r.n_dropped for r in line_runs.dedup_lines(docs).collect()}
    assert got == {i: 2 if i > 3 else int(i > 0) for i in range(20)}
    assert any(len(x) > 1 and x[1] for x in levels) and any(len(x) > 2 and x[2] for x in levels)


def test_merged_levels_are_read(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{TWO} and again" if i in (0, 7) else f"{ONE} {i % 3}" * 2) for i in range(8)], "doc_id long, text string")
    levels = []

    class Seen(suffix_levels.Levels):
        def all(self):
            levels.append([x is not None for x in self.levels])
            return super().all()

    monkeypatch.setattr(suffix_levels, "Levels", Seen)
    got = {r.doc_id: r.n_removed for r in suffix_levels.cut_repeats(docs).collect()}
    assert got[7] == len(TWO) + 10 and got[0] == 0
    assert [False, True] in levels
