from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import dialogue as D

H = "orphan\n[客户][2025-01-01 10:00:00]: first\nmore\n\n[销售A][2025-01-01 10:01:00]: reply\n[客户][t]: a]: b\n[客户][t]: last"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("r")).first().r


def test_parse(spark):
    got = [tuple(m) for m in one(spark, H, D.parse_history)]
    assert got[0] == (0, None, None, "orphan")
    assert got[1] == (1, "客户", "2025-01-01 10:00:00", "first more")
    assert got[-1][3] == "last"
    assert one(spark, None, D.parse_history) == []
    assert one(spark, "", D.parse_history) == []


def test_blocks(spark):
    assert one(spark, H, lambda c: D.trailing_customer_block(D.parse_history(c))) == ["a]: b", "last"]
    assert one(spark, H, D.last_customer_message) == "last"
    assert one(spark, "[销售][t]: x", D.last_customer_message) == ""
    assert one(spark, "[客户][t]: x\n[销售][t]: y", D.until_last_customer) == "[客户][t]: x"
    assert one(spark, H, D.customer_turns) == 3


def test_standard_form_and_back(spark):
    assert one(spark, "[CSM][t]: a\n[x]: b\n[y] c\n\n[客户]: d", D.standardise) == "[销售][t]: a\n[销售]: b\n[销售]: c\n[客户]: d"
    made = spark.createDataFrame([("[CSM][t]: a", " hi ", "now")], "h string, m string, t string").select(D.complete(F.col("h"), F.col("m"), F.col("t")).alias("r")).first().r
    assert made == "[销售][t]: a\n[客户][now]: hi"
    assert [m.text for m in one(spark, made, D.parse_history)] == ["a", "hi"]


def test_any_layout(spark):
    layouts = {
        '[{"role": "客户", "content": "a", "time": "t"}, {"role": "x", "content": null}, {"role": "销售", "content": "b"}]': [("客户", "t", "a"), ("销售", None, "b")],
        "[客户][t]: a\nmore\n[销售A]: b": [("客户", "t", "a\nmore"), ("销售A", None, "b")],
        "客户: a\n销售：b: c": [("客户", None, "a"), ("销售", None, "b: c")],
        " nan ": [],
        "plain": [(None, None, "plain")],
    }
    for text, expected in layouts.items():
        assert [(m.speaker, m.ts, m.text) for m in one(spark, text, D.parse_any)] == expected
    assert one(spark, None, D.parse_any) == []
    assert one(spark, "客户: a\n系统: b\n客户: c", lambda c: D.last_customer_texts(D.two_sides(D.parse_any(c)))) == ["a", "c"]
    assert one(spark, "打<tel>", lambda c: D.fill_placeholders(c, {"<tel>": "0"})) == "打0"


def test_transcripts_are_cut(spark):
    rows = [("f", i, "客户", f"t{i}", "image" if i == 3 else "text", "u") for i in range(1, 8)] + [("f", 1, "客户", "t1", "text", "u"), (None, 1, "x", "y", "text", None)]
    df = spark.createDataFrame(rows, "file_id string, msg_id long, sender_role string, processed_text string, message_type string, file_url string")
    got = {r.chunk: (r.full.count("\n") + 1, r.plain.count("\n") + 1) for r in D.transcripts(df, 5).collect()}
    assert got == {0: (5, 4), 1: (2, 2)}


def read(spark, parse, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, h string")
    got = df.select("k", parse(F.col("h")).alias("m")).orderBy("k").collect()
    return [[(m.pos, m.speaker, m.ts, m.text) for m in r.m] for r in got]


def test_a_line_with_a_colon_closes_a_message(spark):
    text = "开头\n[客户][t1]: a\nb\n系统: c\nd\n销售: e:f\ng\n[CSM][t]: x\ny\n[客户][t2]:\n 客户 : z"
    listed = '[{"role": " 客户 ", "content": " a ", "time": "t"}, {"role": "系统", "content": "b"}, {"role": "销售", "content": "c"}, {"role": "客户"}]'
    assert read(spark, D.parse_closed, text, listed, None, "", "[{broken: 客户") == [
        [(0, "客户", "t1", "a\nb"), (1, "销售", "", "e:f\ng"), (2, "客户", "", "z")], [(0, "客户", "t", "a"), (1, "销售", "", "c")], [], [], []
    ]


def test_only_the_two_sides_have_heads(spark):
    text = "orphan\n[客户][t1]: a\r\n  b \n\n[CSM][t]: c\n [销售][t]: d\n[销售][ t2 ]:\n e"
    assert read(spark, D.parse_sides, text, None, "x", "") == [[(0, "客户", "t1", "a\nb\n[CSM][t]: c\n[销售][t]: d"), (1, "销售", "t2", "e")], [], [], []]


def test_prefixes_are_enough(spark):
    assert read(spark, D.parse_prefixed, "x\n[客户][t]: a]: b\nc\n[销售]d\n [客户] e", None) == [[(0, "客户", "", "a]: b\nc"), (1, "销售", "", "d"), (2, "客户", "", "e")], []]


def test_last_customer_block(spark):
    texts = ["[客户][t]: a\n  b \n[销售][t]: c", "[销售][t]: 说 [客户] 好\nd", "[销售]: x", None, "前\n引用[客户]\n后", "[客户]: a\n[客户]: b\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, h string")
    got = [r.b for r in df.select("k", D.last_customer_block(F.col("h")).alias("b")).orderBy("k").collect()]
    assert got == ["[客户][t]: a\nb", "[销售][t]: 说 [客户] 好\nd", "", "", "引用[客户]\n后", "[客户]: b"]


def test_reply_blocks(spark):
    rows = [
        (1, 0, "销售", "t0", "S"), (1, 1, "销售", "t1", "more"), (1, 2, "客户", "t2", "a"), (1, 3, "客户", None, "b"), (1, 4, "销售", "t4", "x"),
        (2, 0, "销售", "t0", "S"), (2, 1, "系统", "t1", "-"), (2, 2, "客户", "t2", "a"), (3, 0, "销售", "t0", "S"), (4, 0, "销售", "t0", "S"), (4, 1, "客户", "t1", "c"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, pos int, speaker string, ts string, text string")
    got = {r.conv_id: (r.pos, r.block, r.last_pos, r.closed) for r in D.reply_blocks(df, F.col("text") == "S").collect()}
    assert got == {1: (0, "[客户][t2]：a\n[客户][]：b", 3, True), 4: (0, "[客户][t1]：c", 1, False)}
