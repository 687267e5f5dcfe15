"""Model calls with a stand-in for the model, and the helpers beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import models
from dialoom.operators import propagation as P
from dialoom.operators import scripts as S


def test_calls_fail_batch_by_batch(spark):
    def answer(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), (None,), ("b",)], "p string").coalesce(1)
    assert [r.o for r in df.select(models.call(F.col("p"), answer, 1).alias("o")).collect()] == ["A", None, "B"]
    bad = spark.createDataFrame([("a",), ("boom",), ("b",)], "p string").coalesce(1)
    assert [r.o for r in bad.select(models.call(F.col("p"), answer, 2).alias("o")).collect()] == ["", "", "B"]


def test_judge_falls_back(spark):
    df = spark.createDataFrame([("x", "x"), ("x", None), ("y", "z")], "a string, b string")
    answer = lambda prompts: ["结果：是" if "甲x乙x" in p else "不知道" for p in prompts]
    got = models.judge(df, "甲{one}乙{two}", {"one": "a", "two": "b"}, answer, F.lit("heuristic"))
    assert [(r.a, r.b, r.verdict) for r in got.collect()] == [("x", "x", "是"), ("x", None, "heuristic"), ("y", "z", "heuristic")]


def test_words_as_tokens(spark):
    texts = spark.createDataFrame([("The cat sat",), ("dog",), ("",), (None,)], "text string")
    tree = spark.createDataFrame([(1, "the cat"), (2, "a bird")], "script_id long, script_text string")
    got = S.cosine_matches(texts, tree, 0.1, text.words).collect()
    assert [(r.text, r.script_id, round(r.similarity, 4)) for r in got] == [("The cat sat", 1, 0.8165)]


def test_times_labels_and_pairs(spark):
    rows = [(" 2026/1/2 03:04 ", "", None, "A", "B", "D"), ("soon", "a", " nan ", "A", None, "D"), (None, "a", "b", "A", "B", None)]
    df = spark.createDataFrame(rows, "t string, l1 string, l2 string, o1 string, o2 string, d string")
    got = P.coalesce_labels(df.withColumn("at", P.time_text(F.col("t"))), ("l1", "l2"), ("o1", "o2"), "d").select("at", "l1", "l2").collect()
    assert [tuple(r)[1:] for r in got] == [("A", "B"), ("a", "D"), ("a", "b")]
    assert [r.at for r in got][1:] == ["soon", None]
    cells = {'{"a": "x", "b": 2, "c": "z"}': ["x", "2"], "[1]": [], "{bad": [], None: [], '{"a": null}': [None]}
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.v for r in df.select("c", text.first_values(F.col("c")).alias("v")).collect()} == cells
