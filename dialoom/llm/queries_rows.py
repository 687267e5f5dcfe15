"""Queries of problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import conversations, formatting_duplicates
from dialoom.session import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered messages of the conversations that are whole and answered."""
    return conversations.rebuild(table(spark, sf_dir, "chat_messages")).select("file_id", "seq", "msg_id")


def p2_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept conversations with the number of messages of each side."""
    kept = conversations.rebuild(table(spark, sf_dir, "chat_messages"))
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "customer").alias("customer_messages"), F.count_if(F.col("role") == "sales").alias("sales_messages"))


def p2_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of kept conversations with role, time and text."""
    return conversations.with_texts(table(spark, sf_dir, "chat_messages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that repeat an earlier one of the same customer but for formatting."""
    cases = spread(table(spark, sf_dir, "testset").select("case_id", "customer_id", "latest_message"))
    return formatting_duplicates.copies(cases, "case_id", "latest_message", ["customer_id"]).withColumnRenamed("id", "case_id")


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group of equal cases with its number of copies."""
    cases = spread(table(spark, sf_dir, "testset").select("case_id", "customer_id", "latest_message"))
    return formatting_duplicates.collapse(cases, "case_id", "latest_message", ["customer_id"])


QUERIES = {"p2_found": p2_found, "p2_roles": p2_roles, "p2_dialogues": p2_dialogues, "p3_found": p3_found, "p3_collapsed": p3_collapsed}

_P2 = r"""
WITH once AS (
  SELECT file_id, msg_id, arg_min(struct_pack(t := processed_text, r := sender_role, ts := dialogue_time), struct_pack(l := loaded_at, i := row_id)) AS m
  FROM chat_messages WHERE file_id IS NOT NULL GROUP BY file_id, msg_id),
flat AS (
  SELECT file_id, msg_id, m.ts AS ts, m.t AS t, coalesce(regexp_matches(m.t, '^[\s\p{Z}]*((?i:nan|none)|\[\]|\{\})?[\s\p{Z}]*$'), TRUE) AS blank,
         lower(regexp_replace(m.r, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS r FROM once),
coded AS (
  SELECT *, CASE WHEN r IN ('客户', 'customer') THEN 'C' WHEN r IN ('csm', 'sales') OR r LIKE '销售%' THEN 'S' WHEN r IN ('系统', 'system') THEN 'Y' ELSE 'X' END AS code FROM flat),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, msg_id) AS seq FROM coded WHERE NOT blank),
ids AS (
  SELECT file_id FROM coded GROUP BY file_id HAVING count(*) = count(msg_id) AND min(msg_id) = 1 AND max(msg_id) = count(*)),
kept AS (
  SELECT file_id FROM ranked GROUP BY file_id
  HAVING count(*) FILTER (WHERE ts IS NULL OR code = 'X') = 0 AND max(seq) FILTER (WHERE code = 'S') > min(seq) FILTER (WHERE code = 'C'))
"""
ORACLES = {
    "p2_found": _P2 + "SELECT file_id, CAST(seq AS INT) AS seq, msg_id FROM ranked WHERE file_id IN (SELECT file_id FROM ids) AND file_id IN (SELECT file_id FROM kept)",
    "p2_dialogues": _P2 + "SELECT file_id, CAST(seq AS INT) AS seq, CASE code WHEN 'C' THEN 'customer' WHEN 'S' THEN 'sales' ELSE 'system' END AS role, msg_id, ts AS \"at\", t AS text FROM ranked WHERE file_id IN (SELECT file_id FROM ids) AND file_id IN (SELECT file_id FROM kept)",
    "p2_roles": _P2 + "SELECT file_id, count(*) AS messages, count(*) FILTER (WHERE code = 'C') AS customer_messages, count(*) FILTER (WHERE code = 'S') AS sales_messages FROM ranked WHERE file_id IN (SELECT file_id FROM ids) AND file_id IN (SELECT file_id FROM kept) GROUP BY file_id",
}
