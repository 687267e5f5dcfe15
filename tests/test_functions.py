from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dialoom.functions import blank, questions, similarity, text
from dialoom.operators import scripts


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("value", "expected"), [(" NaN ", True), ("[]", True), ("{}", True), (None, True), ("　\n", True), ("0", False), ("[ ]", False)])
def test_blank(spark, value, expected):
    assert one(spark, value, blank.is_blank) is expected


@pytest.mark.parametrize(("value", "expected"), [("[]", "[]"), (" None ", ""), (None, ""), (" a ", "a")])
def test_normalise_value(spark, value, expected):
    assert one(spark, value, blank.normalise_value) == expected


def test_key_variants(spark):
    assert one(spark, "1. A B", text.key_variants) == ["1. A B", "1.AB"]


def test_split_utterance(spark):
    cases = {
        "好的，您在职吗？": ("好的，", "您在职吗？"), "谢谢": ("谢谢", ""), "行，先看。您来吗？再见": ("行，先看。", "您来吗？"), "": ("", ""),
        "好滴您在职吗？": ("好滴", "您在职吗？"), "哦哦您在职吗？": ("哦哦", "您在职吗？"), "恩恩，，您在职吗?": ("恩恩，", "，您在职吗?"), "您在职吗？": ("", "您在职吗？"),
        "先听课，再做题，行吗？": ("先听课，", "再做题，行吗？"), "先听课，今天晚上七点钟的直播能来吗？": ("先听课，", "今天晚上七点钟的直播能来吗？"), "甲<newline>乙 <newline> 丙？": ("甲<newline>乙", "丙？"),
        "  ？": ("", "？"), None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", text.split_utterance(F.col("c")).alias("s")).collect()
    assert {r.c: tuple(r.s) if r.s else None for r in rows} == cases


def test_expected_utterance(spark):
    cases = {
        '{"提醒": "a"}': ("提醒", "a"), '{"a": "1", "b": "2"}': ("", ""), '{"a": 1}': ("", ""), '"x"': ("", "x"), "[1]": ("", ""), "5": ("", ""), " 好的 ": ("", "好的"), "{坏": ("", "{坏"), None: ("", ""),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", text.expected_utterance(F.col("c")).alias("s")).collect()
    assert {r.c: tuple(r.s) for r in rows} == cases


def test_expected_utterances_of_a_tree():
    tree = {"a": {"预期话术": ["x", "y", 3], "b": {"预期话术": "z"}}, "c": [{"预期话术": {"k": "w"}}]}
    assert list(scripts.expected_utterances(tree)) == ["x", "y", "z", "w"]


def test_sentences(spark):
    assert one(spark, "a。b！<newline>c", text.sentences) == ["a", "b", "c"]
    assert one(spark, "。", text.sentences) == ["。"]
    assert one(spark, "", text.sentences) == []


def test_script_variants(spark):
    assert one(spark, "a<newline>b", text.script_variants) == ["a", "a<newline>b"]


@pytest.mark.parametrize(("a", "b", "expected"), [("abc", "abcd", 0.75), ("", "x", 0.0), ("x", "x", 1.0), (None, "x", 0.0), ("ab", "ba", 1.0)])
def test_lexical(a, b, expected):
    assert similarity.lexical(a, b) == expected


def test_media_only(spark):
    rows = [(["<image_1>", "<voice_2>"], True), (["<image_1>", "hi"], False), ([], False), (None, False)]
    got = spark.createDataFrame(rows, "m array<string>, e boolean").select(questions.only_media(F.col("m")).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)


def test_clean_questions(spark):
    assert one(spark, '<think>x</think>["几点开课", "几点开课", "多少钱?"]', questions.clean_questions) == ["几点开课？", "多少钱?"]
    assert one(spark, "什么时候上课\n嗯", questions.clean_questions) == ["什么时候上课？"]


def test_long_runs_of_space_are_read_once(spark):
    gap = "a" + " " * 100_000 + "b"
    assert one(spark, gap, blank.strip) == gap
    assert one(spark, gap, blank.is_blank) is False
    assert one(spark, " " * 100_000, blank.is_blank) is True
