"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import subset
from dialoom.session import spread, table

SIZE = 500


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.array_join(F.transform(F.array_sort(F.map_entries("cycle_label")), lambda e: F.concat_ws("=", e["key"], e["value"])), "+")
    return spread(table(spark, sf_dir, "testset").select("case_id", "sales_id", "message_type", "latest_message", label.alias("cycle")))


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset of the cases that covers cycle labels, types, desks and messages."""
    return subset.select(_cases(spark, sf_dir), "case_id", ("cycle", "message_type"), "sales_id", "latest_message", SIZE)


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values and the largest share of each category, in all cases and in the subset."""
    cases = _cases(spark, sf_dir)
    chosen = cases.join(p4_subset(spark, sf_dir), "case_id")
    long = [
        rows.select(F.lit(name).alias("rows"), F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in ("cycle", "message_type", "sales_id", "latest_message")])).alias("x"))
        for name, rows in (("all", cases), ("subset", chosen))
    ]
    counted = long[0].unionByName(long[1]).groupBy("rows", "x.category", "x.value").count()
    return counted.groupBy("rows", "category").agg(F.count(F.lit(1)).alias("distinct_values"), F.round(F.max("count") / F.sum("count"), 4).alias("largest_share"))


QUERIES = {"p4_subset": p4_subset, "p4_coverage": p4_coverage}
ORACLES: dict[str, str] = {}
