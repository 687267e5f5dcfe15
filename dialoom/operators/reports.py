"""Aggregate reports over cases and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank


def shares(df: DataFrame, value: Column, within: list[str] | None = None) -> DataFrame:
    """Counts of a value and their share of all rows, or of the rows of each group.

    Totals are aggregates of the counts, joined back, so no window holds all distinct values of a large group.
    """
    keys = list(within or [])
    counts = df.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    if not keys:
        total = counts.agg(F.sum("rows")).first()[0] or 0
        return counts.withColumn("share", F.round(F.col("rows") / F.lit(max(1, total)), 6))
    totals = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("rows").alias("__all"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return counts.join(totals, same).withColumn("share", F.round(F.col("rows") / F.col("__all"), 6)).select(*keys, "value", "rows", "share")


def distributions(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The histograms of several columns in one pass: (dimension, value, rows)."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in columns.items()])).alias("x"))
    return stacked.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def top_values(counted: DataFrame, most: dict[str, int]) -> DataFrame:
    """``distributions`` with, for the dimensions named, only the values of most rows (ties by value)."""
    limited = counted.filter(F.col("dimension").isin(*most))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("rows"), F.col("value")))
    cap = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    kept = limited.withColumn("__place", place).filter(F.col("__place") <= cap[F.col("dimension")]).drop("__place")
    return counted.filter(~F.col("dimension").isin(*most)).unionByName(kept)


def scenario_statistics(counted: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Histograms under prefixed names, in one table: (scenario, rows)."""
    prefix = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])[F.col("dimension")]
    return counted.filter(F.col("dimension").isin(*prefixes)).select(F.concat(prefix, F.coalesce("value", F.lit(""))).alias("scenario"), "rows")


def quality_metrics(
    df: DataFrame, columns: list[str], distinct: list[str] | None = None, sources: list[str] | None = None, lists: list[str] | None = None, flags: list[str] | None = None
) -> DataFrame:
    """Long form of one aggregate: (metric, value).

    Rows; non-blank values of ``columns``; distinct values of ``distinct``; rows of each value of ``sources``;
    average lengths of ``lists`` (of rows that have one); true values of ``flags``.
    """
    made = {"rows": F.count(F.lit(1)), **{f"present_{c}": F.count_if(~is_blank(F.col(c))) for c in columns}}
    made |= {f"distinct_{c}": F.countDistinct(c) for c in distinct or []}
    made |= {f"true_{c}": F.count_if(F.col(c)) for c in flags or []}
    made |= {f"average_{c}": F.round(F.avg(F.when(F.size(c) > 0, F.size(c))), 4) for c in lists or []}
    aggregated = df.agg(*[c.cast("double").alias(f"m{i}") for i, c in enumerate(made.values())])
    long = aggregated.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(made)])).alias("x")).select("x.*")
    if not sources:
        return long
    by_source = distributions(df, {c: F.col(c) for c in sources})
    return long.unionByName(by_source.select(F.concat_ws("_", F.lit("source"), "dimension", F.coalesce("value", F.lit("none"))).alias("metric"), F.col("rows").cast("double").alias("value")))


def rates(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Rows, rows with the flag, and their rate, for each value of ``by``."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"))
    return counted.withColumn("rate", F.round(F.col("flagged") / F.col("rows"), 6))


def selection_plan(quotas: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """Planned and actual rows of each stratum, and how far they are apart: (stratum, size, quota, actual, effect)."""
    counted = chosen.groupBy(F.col(column).alias("__stratum")).agg(F.count(F.lit(1)).alias("n"))
    joined = quotas.join(counted, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").withColumn("actual", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.select("stratum", "size", "quota", "actual", deviation_class(F.col("actual"), F.col("quota")).alias("effect"))


def coverage(everything: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """How many rows of each value are chosen of how many there are, with the rate."""
    of_all = everything.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("available"))
    of_chosen = chosen.groupBy(F.col(column).alias("chosen_value")).agg(F.count(F.lit(1)).alias("n"))
    joined = of_all.join(of_chosen, of_all["value"].eqNullSafe(of_chosen["chosen_value"]), "left")
    return joined.select("value", "available", F.coalesce("n", F.lit(0)).alias("chosen"), F.round(F.coalesce("n", F.lit(0)) / F.col("available"), 6).alias("rate"))


def coverage_of(everything: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """``coverage`` of several columns in one pass over each table: (dimension, value, available, chosen, rate)."""
    named = {c: F.col(c) for c in columns}
    picked = distributions(chosen, named).select(F.col("dimension").alias("__d"), F.col("value").alias("__v"), F.col("rows").alias("n"))
    joined = distributions(everything, named).join(picked, (F.col("dimension") == F.col("__d")) & F.col("value").eqNullSafe(F.col("__v")), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("dimension", "value", F.col("rows").alias("available"), n.alias("chosen"), F.round(n / F.col("rows"), 6).alias("rate"))


def deviation_class(actual: Column, planned: Column) -> Column:
    d = F.when(planned > 0, F.abs(actual - planned) / planned).otherwise(1.0)
    return F.when(d <= 0.1, "within 10 %").when(d <= 0.2, "within 20 %").when(d <= 0.3, "within 30 %").otherwise("over 30 %")


def key_membership(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """(key, rows): how many rows' maps hold each key, one at least (a divisor)."""
    counted = df.agg(*[F.greatest(F.count_if(F.map_contains_key(label, k)), F.lit(1)).alias(f"n{i}") for i, k in enumerate(keys)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"n{i}").alias("rows")) for i, k in enumerate(keys)])).alias("x")).select("x.*")
