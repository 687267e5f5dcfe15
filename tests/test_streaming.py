"""Streams of several micro-batches: late rows, state between batches."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dialoom.streaming import events as E

T0 = datetime(2026, 1, 1)


def stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i:04d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_no_longer_count(spark, tmp_path):
    at = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    batches = [[(at(0), "a", 1.0), (at(5), "a", 1.0)], [(at(5, 1), "a", 1.0)], [(at(0, 1), "a", 1.0), (at(4, 1), "a", 1.0)], [(at(9), "a", 1.0)]]
    events = stream(spark, tmp_path / "e", batches, "ts timestamp_ntz, kind string, value double")
    got = {r.window_start: r.events for r in E.drain(E.windowed_counts(events, "ts", "1 day", "2 days", "kind")).collect()}
    assert got == {at(0): 1, at(4): 1, at(5): 2}  # the row of day 0 in the third batch is late, the one of day 4 is not


def test_state_is_carried_over_batches(spark, tmp_path):
    rows = [[("s", "c", 1, "CSM", "L1"), ("s", "d", 2, "CSM", None)], [("s", "c", 3, "客户", None), ("s", "d", 4, "客户", None)], [("s", "c", 5, "CSM", "L2"), ("s", "c", 6, "客户", None)]]
    events = stream(spark, tmp_path / "r", rows, "sales_id string, customer_id string, row_order long, sender string, label string")
    got = {r.row_order: r.label for r in E.drain(E.fill_forward_state(events, lambda p: p["sender"] != "客户")).collect()}
    assert got == {1: "L1", 2: None, 3: "L1", 4: None, 5: "L2", 6: "L2"}


def test_staging_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("n"), F.lit(1).alias("x"))
    out = E.drain(E.staged(rows, "n"))
    assert out.count() == 1000 and out.agg(F.sum("n")).first()[0] == rows.agg(F.sum("n")).first()[0]
    assert E.drain(E.staged(rows.limit(0), "n")).count() == 0
