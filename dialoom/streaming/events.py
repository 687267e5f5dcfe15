"""Structured Streaming forms: windowed counts with late data, sessions, and a stateful fill-forward.

The runners read what a folder holds (trigger ``availableNow``) and return the sink's table, so a stream can be run
and checked like a batch query. Sinks and checkpoints lie in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoom.session import ensure_checkpoint_dir, ship


def source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema of the table."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def staged(rows: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """The rows as a stream of at least ``parts`` micro-batches, in ``order``: each part is written after the one before.

    For tables that lie in one file; cuts are approximate quantiles, rows without an order come first.
    """
    spark = rows.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    place = F.coalesce((instant(order) if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order)).cast("double"), F.lit(float("-inf")))
    marked = rows.withColumn("__place", place)
    cuts = marked.filter(F.col("__place") > float("-inf")).approxQuantile("__place", [i / parts for i in range(1, parts)], 0.01) or [0.0] * (parts - 1)
    edges = [float("-inf"), *cuts, float("inf")]
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = marked.filter((F.col("__place") >= low) & ((F.col("__place") < high) if i + 1 < parts else F.lit(True)))
        part.drop("__place").coalesce(1).write.parquet(f"{folder}/part={i:04d}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def instant(c: str) -> Column:
    """A time without zone as the instant that it is in UTC, whatever the session's zone: what event time needs."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")


def wall_time(c: str) -> Column:
    """The reverse of ``instant``."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the sink's rows.

    In ``complete`` mode each batch replaces the sink, else it is added; a batch that is run again after a failure
    replaces its own part, so every row arrives exactly once.
    """
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        part = 0 if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={part}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows and values per tumbling window of event time, or per window of ``width`` that begins every ``slide``.

    In ``append`` mode a window is given once, when the newest row is ``late`` past its end; its state is dropped then,
    and rows that come for it afterwards no longer count.
    """
    grouped = events.withColumn(at, instant(at)).withWatermark(at, late).groupBy((F.window(at, width, slide) if slide else F.window(at, width)).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(wall_time("w.start").alias("window_start"), *keys, "events", "total")


def sessions(events: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Runs of a key's rows with no pause of ``gap`` or more; given and dropped as ``windowed_counts`` are."""
    grouped = events.withColumn(at, instant(at)).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(*keys, wall_time("w.start").alias("session_start"), wall_time("w.end").alias("session_end"), "events")


def fill_forward_state(rows: DataFrame, is_anchor: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """The last anchor's label on later rows of a conversation, kept in state between micro-batches.

    ``rows``: sales_id, customer_id, row_order, sender, label. The state is one label per conversation.
    """

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in (pd.concat(list(parts)).sort_values("row_order"),):
            anchor, out = is_anchor(part).to_numpy(), []
            for label, a in zip(part["label"], anchor, strict=True):
                missing = label is None or label != label
                if a and not missing:
                    last = label
                out.append(last if missing else label)
            yield pd.DataFrame({"row_order": part["row_order"].to_numpy(), "label": out})
        if last is not None:
            state.update((last,))

    return rows.groupBy("sales_id", "customer_id").applyInPandasWithState(run, "row_order long, label string", "label string", "append", GroupStateTimeout.NoTimeout)
