from pyspark.sql import functions as F

from tabulon.functions import similarity as sim
from tabulon.functions import text as tx
from tabulon.operators import metrics, profile, roles
from tabulon.operators.predicates import as_sql


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean_term(spark):
    assert values(spark, tx.clean_term, "A//B", "IN/OUT", "-X", "NA+ (SERUM)", "CBC 12/05/2011", None, "A A B") == ["A", "", "", "NA SERUM", "CBC", "", "A B"]


def test_distances():
    assert sim.common_subsequence("kitten", "sitting") == 4
    assert round(sim.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert (sim.jaro_winkler("", ""), sim.jaro_winkler("", "A"), sim.ratio("", ""), sim.ratio("A", "")) == (0.1, 0.0, 0.1, 0.0)


def test_levenshtein(spark):
    for b, d in (("kitten", 0), ("sitten", 1), ("sittes", 2), ("sityteng", 3), ("sittYing", 4)):
        assert spark.range(1).select(F.levenshtein(F.lit("kitten"), F.lit(b))).first()[0] == d


def test_common_substring(spark):
    row = spark.range(1).select(sim.common_substring(F.lit("MICROALBUMIN"), F.lit("ALBUMIN")), sim.common_substring(F.lit(""), F.lit("A"))).first()
    assert tuple(row) == (7, 0)


def test_fmax(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    row = metrics.fmax(rows, [], "y", "s").first()
    assert round(row["fmax"], 6) == 0.8 and row["threshold"] == 0.35


def test_weighted_median(spark):
    heavy = [(1, 7.0, 1.0), (1, 1.0, 0.5), (1, 2.0, 0.25), (1, 10.0, 0.25)]
    even = [(2, v, 1.0) for v in (1.0, 2.0, 3.0, 4.0)]
    rows = spark.createDataFrame(heavy + even, "g int, v double, w double")
    assert {r.g: r.weighted_median for r in profile.weighted_median(rows, ["g"], "v", "w").collect()} == {1: 7.0, 2: 2.5}


def test_sql_text():
    assert as_sql(["a", "b"], ["X'y"]) == "lower(a) like '%x''y%' OR lower(b) like '%x''y%'"


def test_sql_text_escapes_wildcards():
    assert as_sql(["a"], ["5%_!"]) == "lower(a) like '%5!%!_!!%' escape '!'"


def test_rows_of_xy_join_one_to_one(spark):
    rows = spark.createDataFrame([(1, 2.0, 0), (1, 2.0, 0), (1, 2.0, 0), (2, 3.0, 1)], "k int, x double, y int")
    x, y = roles.to_xy(rows, "y")
    assert x.join(y, "_row").count() == 4 and x.columns == ["_row", "k", "x"]
    x, y = roles.to_xy(rows.distinct(), "y", ["x"], keys=["k"])
    assert {(r.x, r.y) for r in x.join(y, "_row").collect()} == {(2.0, 0), (3.0, 1)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
