"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import personal
from dialoom.session import spread, table


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_key, field_name, text) of the three fields."""
    cases = spread(table(spark, sf_dir, "testset").select("case_id", "latest_message", "history"))
    pick = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("latest_message", "history")]))
    first = cases.select(F.lit("testset").alias("source_table"), F.col("case_id").alias("row_key"), pick.alias("f")).select("source_table", "row_key", "f.field_name", "f.text")
    second = spread(table(spark, sf_dir, "reflow_rows").select("row_order", "sent_text")).select(
        F.lit("reflow_rows").alias("source_table"), F.col("row_order").alias("row_key"), F.lit("sent_text").alias("field_name"), F.col("sent_text").alias("text")
    )
    return first.unionByName(second).filter(F.col("text").isNotNull())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type of personal data that a field holds."""
    fields = _fields(spark, sf_dir)
    patterns = personal.induce(fields.select("text"))
    return personal.redact(fields, "text", patterns).select("source_table", "row_key", "field_name", F.explode("pii_types").alias("pii_type"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that hold personal data, with placeholders in its place."""
    fields = _fields(spark, sf_dir)
    patterns = personal.induce(fields.select("text"))
    return personal.redact(fields, "text", patterns).filter(F.size("pii_types") > 0).select("source_table", "row_key", "field_name", "redacted")


QUERIES = {"p7_found": p7_found, "p7_redacted": p7_redacted}
ORACLES: dict[str, str] = {}
