"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import residue
from dialoom.llm.messages import history_messages
from dialoom.session import spread, table


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spread(table(spark, sf_dir, "testset").select("case_id", "sales_id", "latest_message", "history"))
    fields = F.array(
        F.struct(F.lit("latest_message").alias("field_name"), F.array("latest_message").alias("messages")),
        F.struct(F.lit("history").alias("field_name"), history_messages(F.col("history")).alias("messages")),
    )
    return cases.select("case_id", "sales_id", F.explode(fields).alias("f")).select("case_id", "sales_id", "f.field_name", "f.messages").filter("messages is not null")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the test set that hold template residue, filler, error pages or script notices."""
    return residue.found(_fields(spark, sf_dir), ["case_id", "field_name"], "messages", "sales_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that remain when those with residue in either field are excluded."""
    fields = _fields(spark, sf_dir)
    bad = residue.found(fields, ["case_id", "field_name"], "messages", "sales_id").select("case_id").distinct()
    return table(spark, sf_dir, "testset").select("case_id", "sales_id", "latest_message").join(bad, "case_id", "left_anti")


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
ORACLES: dict[str, str] = {}
