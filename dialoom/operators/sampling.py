"""Quotas, deterministic samples and de-duplication.

Random draws are replaced by the order of a hash of the row's key, so that every run and every engine draws alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.scripts import small

SALTS = 64


def hash_order(key: Column) -> Column:
    return F.md5(key.cast("string"))


def ranked(df: DataFrame, strata: list[str], order: list[Column], at_most: Column | int) -> DataFrame:
    """Rows whose place within their stratum is at most ``at_most``; adds ``place``.

    A first cut per salted share of a stratum leaves few rows for the second, so no stratum passes one task whole.
    """
    limit = F.lit(at_most) if isinstance(at_most, int) else at_most
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    cut = salted.withColumn("place", F.row_number().over(Window.partitionBy(*strata, "__salt").orderBy(*order))).filter(F.col("place") <= limit)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("place") <= limit).drop("__salt")


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """Quotas proportional to ``size``: the whole part of each share, what is left in order of the remainders
    (then names) descending, each taking as much as its stratum still holds. ``sizes``: stratum, size (few rows)."""
    every = Window.partitionBy(F.lit(0))
    pool = F.sum("size").over(every)
    share = sizes.filter("size > 0").withColumn("ideal", total * (F.col("size") / pool)).withColumn("base", F.least(F.floor("ideal"), F.col("size")))
    room = F.col("size") - F.col("base")
    left = share.withColumn("remainder", F.when(room > 0, F.col("ideal") - F.col("base")).otherwise(-1.0)).withColumn("spare", F.lit(total) - F.sum("base").over(every))
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.desc("remainder"), F.desc("stratum")).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.when(F.col("remainder") > 0, room).otherwise(0)).over(earlier), F.lit(0))
    extra = F.when(F.col("remainder") > 0, F.greatest(F.lit(0), F.least(room, F.col("spare") - taken))).otherwise(0)
    return left.select("stratum", "size", (F.col("base") + extra).cast("long").alias("quota"))


def two_phase(sizes: DataFrame, total: int = 300, guaranteed: int = 5) -> DataFrame:
    """A guaranteed number for each stratum, then what is left in proportion among those that hold more."""
    every = Window.partitionBy(F.lit(0))
    sure = F.least(F.lit(guaranteed), F.col("size"))
    first = sizes.withColumn("sure", sure).withColumn("left", F.lit(total) - F.sum("sure").over(every))
    open_ = F.col("size") > F.col("sure")
    eligible = F.sum(F.when(open_, F.col("size")).otherwise(0)).over(every)
    more = F.when(open_, (F.col("left") * (F.col("size") / eligible)).cast("long")).otherwise(0)
    return first.withColumn("eligible", eligible).select("stratum", "size", F.least(F.col("size"), F.greatest(F.lit(0), F.col("sure") + more)).cast("long").alias("quota"))


def draw(df: DataFrame, stratum: str, quotas: DataFrame, key: str) -> DataFrame:
    """As many rows of each stratum as its quota, in hash order. ``quotas`` has one row per stratum."""
    slim = quotas.select(F.col("stratum").alias(stratum), "quota").filter("quota > 0")
    joined = df.join(small(slim), stratum)
    return ranked(joined, [stratum], [hash_order(F.col(key)), F.col(key)], F.col("quota")).drop("quota", "place")


def keep_first(df: DataFrame, on: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each value of ``on``: an aggregate, so repeats are combined before they are shuffled."""
    names = [f"__d{i}" for i in range(len(on))]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    kept = df.select(*[o.alias(n) for o, n in zip(on, names, strict=True)], F.struct("*").alias("__row"), rank.alias("__rank"))
    return kept.groupBy(*names).agg(F.min_by("__row", "__rank").alias("__row")).select("__row.*")


def readmit(df: DataFrame, rules: list[tuple[Column, int]], key: str) -> DataFrame:
    """Rows that no rule marks, and up to as many of each rule's marked rows as it says, in hash order."""
    marked = df.withColumns({f"__m{i}": F.coalesce(c, F.lit(False)) for i, (c, _) in enumerate(rules)})
    none = marked
    for i in range(len(rules)):
        none = none.filter(~F.col(f"__m{i}"))
    out = none.select(*df.columns)
    for i, (_, n) in enumerate(rules):
        if n:
            back = marked.filter(F.col(f"__m{i}")).orderBy(hash_order(F.col(key)), key).limit(n)
            out = out.unionByName(back.select(*df.columns))
    return out.dropDuplicates([key])


def cycle_description(label: Column) -> Column:
    """行课期 and 服务期 first, then the others by name: ``行课期第0天 + 服务期第2天``."""
    part = lambda k, v: F.concat(k, F.lit("第"), v.cast("string"), F.lit("天"))
    rank = lambda k: F.when(k == "行课期", 0).when(k == "服务期", 1).otherwise(2)
    ordered = F.array_sort(F.transform(F.map_entries(label), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.when(F.coalesce(F.size(label), F.lit(0)) > 0, F.array_join(F.transform(ordered, lambda e: part(e["k"], e["v"])), " + ")).otherwise("未知周期")
