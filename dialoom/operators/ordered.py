"""Ordered computations per key that do not need a whole key in one task.

Rows are cut into buckets of a bounded number of consecutive order values; a window runs within (key, bucket), one
small row per (key, bucket) carries the state across buckets. A key that holds a third of all rows is thus spread
over as many tasks as it has buckets, and no window partition exceeds ``BUCKET`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1_000_000


def _keys(keys: list[str]) -> dict[str, Column]:
    """Null-safe copies of the keys, so that null keys join like any other value."""
    return {f"__k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for i, k in enumerate(keys)}


def carry(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], ahead: bool = False, inclusive: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Add, per name, the last non-null value before each row (``ahead``: the first one after it).

    ``order`` is an integer column, unique within a key. ``inclusive`` lets a row see its own value.
    """
    names = list(_keys(keys))
    work = df.withColumns(_keys(keys)).withColumn("__b", F.floor(F.col(order) / bucket)).withColumns({f"__v_{n}": v for n, v in values.items()})
    place = F.desc(order) if ahead else F.asc(order)
    edge = 0 if inclusive else -1
    inside = Window.partitionBy(*names, "__b").orderBy(place).rowsBetween(Window.unboundedPreceding, edge)
    across = Window.partitionBy(*names).orderBy(F.desc("__b") if ahead else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if ahead else F.max_by
    last = work.groupBy(*names, "__b").agg(*[pick(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__l_{n}") for n in values])
    brought = last.select(*names, "__b", *[F.last(f"__l_{n}", ignorenulls=True).over(across).alias(f"__c_{n}") for n in values])
    local = work.withColumns({f"__w_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in values})
    joined = local.join(brought, [*names, "__b"], "left")
    added = joined.withColumns({n: F.coalesce(F.col(f"__w_{n}"), F.col(f"__c_{n}")) for n in values})
    return added.select(*df.columns, *values)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, bucket: int = BUCKET) -> DataFrame:
    """Add the running sum of ``value`` up to and with each row."""
    names = list(_keys(keys))
    work = df.withColumns(_keys(keys)).withColumn("__b", F.floor(F.col(order) / bucket)).withColumn("__v", value)
    inside = Window.partitionBy(*names, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = work.groupBy(*names, "__b").agg(F.sum("__v").alias("__s"))
    brought = sums.select(*names, "__b", F.coalesce(F.sum("__s").over(across), F.lit(0)).alias("__c"))
    joined = work.withColumn("__w", F.sum("__v").over(inside)).join(brought, [*names, "__b"])
    return joined.withColumn(out, F.col("__w") + F.col("__c")).select(*df.columns, out)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: an aggregate with map-side combining, not a window."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
