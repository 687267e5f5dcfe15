"""Queries on the nested payloads' fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import payload, propagation
from dialoom.session import spread, table


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "testset").select("case_id", "rag", "thought_unit"))


def payload_fields(spark, sf_dir):
    return payload.entry_fields(_cases(spark, sf_dir), "case_id")


def unit_labels(spark, sf_dir):
    return payload.unit_labels(_cases(spark, sf_dir), "case_id")


def unit_cycle_labels(spark, sf_dir):
    return payload.unit_cycle_label(_cases(spark, sf_dir), "case_id")


def cycle_labels(spark, sf_dir):
    """The cycle label in each log row's payload, as its sorted entries."""
    label = propagation.cycle_in_payload(F.col("rag"))
    entries = F.transform(F.array_sort(F.map_entries(label)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return table(spark, sf_dir, "reflow_rows").select("row_order", F.array_join(entries, ",").alias("label"))


QUERIES = {f.__name__: f for f in (payload_fields, unit_labels, unit_cycle_labels, cycle_labels)}
ORACLES = {
    "cycle_labels": r"""SELECT row_order, CASE WHEN x <> '' THEN array_to_string(list_sort(list_transform(regexp_extract_all(x, '[''"]([^''":,{} ]+)[''"]\s*:\s*(\d+)', 0), lambda e: regexp_extract(e, '[''"]([^''"]+)[''"]', 1) || '=' || regexp_extract(e, ':\s*(\d+)', 1))), ',') END AS label
FROM (SELECT row_order, regexp_extract(replace(rag, '\"', '"'), '[''"]周期标签[''"]\s*:\s*(\{[^{}]*\})', 1) AS x FROM reflow_rows)""",
}
