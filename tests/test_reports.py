"""Reports on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import reports as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_shares_with_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), (None, None), ("a", "x")], "g string, v string")
    assert rows(R.shares(df, F.col("v"), ["g"])) == sorted([("a", "x", 2, 0.666667), ("a", "y", 1, 0.333333), (None, "x", 1, 0.5), (None, None, 1, 0.5)], key=str)
    assert rows(R.shares(df, F.col("g"))) == sorted([("a", 3, 0.6), (None, 2, 0.4)], key=str)
    assert R.shares(df.limit(0), F.col("v")).count() == R.shares(df.limit(0), F.col("v"), ["g"]).count() == 0


def test_plan_and_coverage(spark):
    quotas = spark.createDataFrame([("a", 10, 4), ("b", 10, 0), (None, 5, 2)], "stratum string, size long, quota long")
    chosen = spark.createDataFrame([("a",)] * 3 + [(None,)] * 2, "c string")
    assert rows(R.selection_plan(quotas, chosen, "c")) == sorted([("a", 10, 4, 3, "within 30 %"), ("b", 10, 0, 0, "over 30 %"), (None, 5, 2, 2, "within 10 %")], key=str)
    everything = spark.createDataFrame([("a",)] * 6 + [("b",), (None,), (None,)], "c string")
    assert rows(R.coverage_of(everything, chosen, ["c"])) == sorted([("c", "a", 6, 3, 0.5), ("c", "b", 1, 0, 0.0), ("c", None, 2, 2, 1.0)], key=str)


def test_top_values_and_metrics(spark):
    counted = spark.createDataFrame([("s", "a", 3), ("s", "b", 3), ("s", "c", 1), ("t", "z", 1), ("t", None, 9)], "dimension string, value string, rows long")
    assert rows(R.top_values(counted, {"s": 2})) == sorted([("s", "a", 3), ("s", "b", 3), ("t", "z", 1), ("t", None, 9)], key=str)
    assert rows(R.scenario_statistics(counted, {"t": "T-"})) == [("T-", 9), ("T-z", 1)]
    df = spark.createDataFrame([("nan", ["x"], True, "a"), (" y", [], None, None)], "c string, l array<string>, f boolean, s string")
    got = dict(R.quality_metrics(df, ["c"], ["s"], ["s"], ["l"], ["f"]).collect())
    assert got == {"rows": 2.0, "present_c": 1.0, "distinct_s": 1.0, "true_f": 1.0, "average_l": 1.0, "source_s_a": 1.0, "source_s_none": 1.0}
    assert rows(R.rates(df, ["s"], F.col("f"))) == sorted([("a", 1, 1, 1.0), (None, 1, 0, 0.0)], key=str)
