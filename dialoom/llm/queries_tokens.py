"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import packing, tokens
from dialoom.session import spread, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


#: Sources of talk and of machine dumps, which p9_apart keeps out of each other's containers.
CONFLICTS = frozenset({("history_export", "ticket_dump"), ("class_notice", "ticket_dump")})


def _packed(spark: SparkSession, sf_dir: str, conflicts: frozenset = frozenset()) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return packing.pack(packing.sizes(documents, "doc_id", "text", "source"), table(spark, sf_dir, "pack_capacity"), conflicts)


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one, for each capacity."""
    return _packed(spark, sf_dir).select("capacity_id", "container_id", F.col("id").alias("doc_id"), "piece", "tokens")


def p9_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p9_packed, with the sources of CONFLICTS never in one container."""
    return _packed(spark, sf_dir, CONFLICTS).select("capacity_id", "container_id", F.col("id").alias("doc_id"), "piece", "tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    used = _packed(spark, sf_dir).groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    capacities = table(spark, sf_dir, "pack_capacity").select("capacity_id", "capacity_tokens")
    totals = used.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return totals.join(F.broadcast(capacities), "capacity_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


QUERIES = {"p8_ids": p8_ids, "p9_packed": p9_packed, "p9_apart": p9_apart, "p9_fill": p9_fill}
ORACLES: dict[str, str] = {}
