"""Queries of problem 1: nested payloads to related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import nested
from dialoom.session import spread, table


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads, in an order that a lost task finds again (equal rows are interchangeable)."""
    whole = table(spark, sf_dir, "testset").select("case_id", "rag", "thought_unit")
    dealt = spread(whole)
    return whole if dealt is whole else dealt.sortWithinPartitions("case_id", F.xxhash64("rag", "thought_unit"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of the five kinds with its positions, parents found by interval containment."""
    cases = _cases(spark, sf_dir)
    nodes = nested.label_nodes(cases, "case_id", kinds=nested.LINEAGE, with_fields=False)
    return nested.positions(nodes).withColumnRenamed("key", "case_id")


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled nodes of both payloads: the flat tables stacked, with parent links."""
    cases = _cases(spark, sf_dir)
    linked = nested.with_ancestors(nested.label_nodes(cases, "case_id"))
    return linked.select(F.col("key").alias("case_id"), "payload", "kind", "pre", "post", "depth", "pos", "field", "recall_pre", "entry_pre", "unit_pre", "fields")


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes}
ORACLES: dict[str, str] = {}
