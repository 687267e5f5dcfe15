from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import ordered
from dialoom.operators import propagation as P
from dialoom.operators import sampling as S


def rows(spark, senders, labels=None):
    labels = labels or [None] * len(senders)
    data = [(i, "s", "c", None, x, None, b, b) for i, (x, b) in enumerate(zip(senders, labels, strict=True))]
    return spark.createDataFrame(data, "row_order long, sales_id string, customer_id string, external_id string, sender string, sop_l1 string, sop_l2 string, sop_display string")


def test_trim(spark):
    kept = P.trim_to_last_reply(rows(spark, ["客户", "CSM", "客户", "未发送", "客户"])).select("row_order").collect()
    assert sorted(r[0] for r in kept) == [0, 1, 2, 3]
    assert P.trim_to_last_reply(rows(spark, ["客户", "未发送"])).count() == 0


def schema(spark):
    data = [(0, "T", "1", 0, "A", None, "1-1"), (0, "T", "1", 1, "二次跟进", None, "1-2"), (0, "T", "1", 2, "B", None, "1-3")]
    return spark.createDataFrame(data, "task_pos int, task_theme string, task_id string, sub_pos int, sub_theme string, sub_theme_alt string, sub_id string")


def test_fill_both_ways_passes_over_follow_ups(spark):
    df = rows(spark, ["客户", "系统", "CSM", "客户"], [None, None, "B", None])
    back = P.fill_back(df, schema(spark)).drop("backfilled")
    labels = [r.sop_l2 for r in P.fill_forward(back).orderBy("row_order").collect()]
    assert labels == ["A", None, "B", "B"]


def test_fill_forward_twice_changes_nothing(spark):
    once = P.fill_forward(rows(spark, ["CSM", "客户", "客户", "CSM"], ["B", None, "X", None])).drop("filled")
    assert sorted(map(str, P.fill_forward(once).drop("filled").collect())) == sorted(map(str, once.collect()))


def test_carry_is_the_same_for_any_bucket(spark):
    data = [(k, i, v) for k in ("a", None, "b") for i, v in enumerate([None, 1, None, 2, None, None, 3, None])]
    df = spark.createDataFrame(data, "k string, o long, v int")
    for ahead in (False, True):
        got = [sorted(map(str, ordered.carry(df, ["k"], "o", {"x": F.col("v")}, ahead=ahead, bucket=b).collect())) for b in (1, 3, 1000)]
        assert got[0] == got[1] == got[2]
    sums = [sorted(map(str, ordered.running_sum(df, ["k"], "o", F.coalesce("v", F.lit(0)), "s", bucket=b).collect())) for b in (1, 3, 1000)]
    assert sums[0] == sums[1] == sums[2]


def test_ids(spark):
    labels = spark.createDataFrame([("T", "A"), ("T", "二次"), ("T", "B后"), ("T", "Z"), (None, None)], "l1 string, l2 string")
    assert {r.l2: r.sub_id for r in P.map_ids(labels, schema(spark)).collect()} == {"A": "1-1", "二次": "1-2", "B后": "1-3", "Z": None, None: None}


def test_largest_remainder(spark):
    sizes = spark.createDataFrame([("A", 7), ("B", 2), ("C", 1)], "stratum string, size long")
    assert {r.stratum: r.quota for r in S.largest_remainder(sizes, 5).collect()} == {"A": 3, "B": 1, "C": 1}


def test_two_phase(spark):
    sizes = spark.createDataFrame([("A", 100), ("B", 6), ("C", 3)], "stratum string, size long")
    assert {r.stratum: r.quota for r in S.two_phase(sizes).collect()} == {"A": 100, "B": 6, "C": 3}


def test_cycle_description(spark):
    df = spark.createDataFrame([({"服务期": 2, "行课期": 0},), (None,), ({},)], "m map<string,int>").select(S.cycle_description(F.col("m")).alias("d"))
    assert [r.d for r in df.collect()] == ["行课期第0天 + 服务期第2天", "未知周期", "未知周期"]


def test_nearest_unused(spark):
    data = [(0, "c", "客户", "hi", None), (1, "c", "CSM", "hi", "u1"), (2, "c", "客户", "hi", ""), (3, "c", "未发送", "hi", "u3"), (4, "c", "客户", "hi", None)]
    df = spark.createDataFrame(data, "row_order long, customer_id string, sender string, message string, thought_unit string")
    assert {r.row_order: r.given for r in P.nearest_unused(df).collect()} == {0: "u1", 2: "u3"}
