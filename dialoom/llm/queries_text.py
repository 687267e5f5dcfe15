"""Query of problem 5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import lookalikes
from dialoom.session import table

#: Table, key and text column of the texts of problem 5.
LOOKALIKE_SOURCES = (("testset", "case_id", "latest_message"), ("reflow_rows", "row_order", "sent_text"), ("tagging_corpus", "conv_id", "final_context"))


def stacked(spark: SparkSession, sf_dir: str, sources: tuple = LOOKALIKE_SOURCES) -> DataFrame:
    """(source_table, row_key, text) of several tables."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), F.col(k).cast("long").alias("row_key"), F.col(c).alias("text")) for t, k, c in sources]
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is written with any of the six kinds of different characters."""
    texts = stacked(spark, sf_dir)
    words = lookalikes.vocabulary(texts)
    odd = texts.filter(lookalikes.suspect(F.col("text")))
    return lookalikes.unify(odd, "text", words).filter(F.arrays_overlap("kinds", F.array(*map(F.lit, lookalikes.KINDS)))).select("source_table", "row_key")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's text in the one form, with the kinds that were found."""
    texts = stacked(spark, sf_dir)
    return lookalikes.unify(texts, "text", lookalikes.vocabulary(texts)).select("source_table", "row_key", "unified", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


QUERIES = {"p5_found": p5_found, "p5_unified": p5_unified}
ORACLES: dict[str, str] = {}
