"""Problems 5, 6 and 7."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.llm import lookalikes as L
from dialoom.llm import personal as P
from dialoom.llm import residue as R
from dialoom.llm.messages import history_messages

TRIE = L.Trie({"résumé": 3, "Word": 9, "word": 2, "café": 5})


@pytest.mark.parametrize(
    ("text", "form", "kinds"),
    [
        ("Ｗｏｒｄ１", "Word1", ["full_width"]),
        ("café那份", "café那份", ["combining"]),
        ("réѕumé", "résumé", ["mixed_script"]),
        ("老​师", "老师", ["invisible"]),
        ("a b", "a b", ["space"]),
        ("⽤⼀", "用一", ["radical"]),
        ("W​оrd", "Word", ["invisible", "mixed_script"]),
        ("Привет 老师，（好）！café résumé", "Привет 老师，（好）！café résumé", []),
        ("👩‍🏫❤️💪🏻 1️⃣", "👩‍🏫❤️💪🏻 1️⃣", []),
        ("好️‍的", "好的", ["invisible"]),
        ("\t\n ", "\t\n ", []),
        ("Ꮯat ցold", "Cat gold", ["mixed_script"]),
        ("ﬁne 𝐖ord Ⅻ", "fine Word XII", ["compatibility"]),
        ("Wоrdі", "Wordi", ["mixed_script"]),
        ("сор", "сор", []),
        ("", "", []),
    ],
)
def test_one_form(text, form, kinds):
    assert L.unify_text(text, TRIE) == (form, kinds)


def test_automaton_costs():
    trie = L.Trie({"word": 5, "ward": 9, "world": 1})
    assert trie.walk("wоrd") == ("word", frozenset({"mixed_script"}))
    assert trie.walk("wrd") is None
    assert trie.walk("wrd", 1)[0] == "ward"  # a letter too few; the more frequent word
    assert trie.walk("woord", 1)[0] == "word"
    assert trie.walk("wоrlds", 1) == ("world", frozenset({"mixed_script"}))
    assert trie.walk("xyz", 2) is None


def test_edits_decide_the_kinds():
    trie = L.Trie({"café": 9, "cafe": 3})
    assert trie.walk("cafe\u0301") == ("café", frozenset({"combining"}))
    assert trie.walk("café") == ("café", frozenset())
    assert L.Trie({"cafe": 3}).walk("cafe\u0301") == ("cafe", frozenset({"combining"}))


@settings(max_examples=300)
@given(st.text(alphabet="aWord éо́​ｗ中，⼀ 👩‍🏫️1", max_size=20))
def test_one_form_is_stable(text):
    once = L.unify_text(text, TRIE)[0]
    again, kinds = L.unify_text(once, TRIE)
    assert again == once
    assert set(kinds) <= {"combining", "invisible", "mixed_script"}


def test_unify_in_spark(spark):
    rows = [(1, "Ｗord"), (2, None), (3, ""), (4, "plain"), (5, "Ｗ" * 100_000), (1, "Ｗord")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("kinds_of", F.lit(1))
    out = {r.k: (r.unified, r.kinds) for r in L.unify(df, "text", L.vocabulary(df, min_count=1)).collect()}
    assert out[1] == ("Word", ["full_width"])
    assert out[2][0] is None
    assert out[3][0] == ""
    assert out[4][0] == "plain"
    assert len(out[5][0]) == 100_000
    empty = df.limit(0)
    assert L.unify(empty, "text", L.vocabulary(empty)).count() == 0


FIELDS = "k long, messages array<string>, host string, segment int"


def test_residue(spark):
    good = ["好的老师", "它提示要打开JavaScript，我不会弄", "浏览器弹了个undefined是什么意思", "模板里XX的位置我自己填就行吧", "网页显示404，刷新也没用，怎么办"]
    bad = ["您好，{{name}}的资料已发送", "404 Not Found", "请启用JavaScript后继续访问", "Lorem ipsum dolor sit amet", "您好，${link}的资料已发送", "<html><title>502 Bad Gateway</title>", "此处填写开场白"]
    rows = [(i, [good[i % 5], f"第{i}题不会"], f"h{i % 20}", 1) for i in range(200)] + [(1000 + i, [bad[i % 7]], f"h{i % 20}", 1) for i in range(70)]
    rows += [(2000, None, None, 1), (2001, [], "h1", 1), (2002, [None, "", " nan "], "h1", 1), (2003, ["好" * 50_000 + "。" + bad[0]], None, 1), (2004, ["您好，undefined的资料已发送"], "h1", 1)]
    df = spark.createDataFrame(rows, FIELDS)
    found = {r.k for r in R.found(df, ["k"], "messages", "host").collect()}
    assert found == {r[0] for r in rows if 1000 <= r[0] < 2000} | {2003, 2004}
    assert R.found(df.limit(0), ["k"], "messages", "host").count() == 0
    assert R.found(df.filter("k < 200"), ["k"], "messages", "host").count() == 0


def test_residue_without_a_listed_phrase(spark):
    talk = ["好的老师", "今天的课在几点开始呢老师", "页面请求超时了，我重新加载也没用", "这边建议您预约答疑，有问题随时找我"]
    rows = [(i, [talk[i % 4], f"第{i}题不会"], f"h{i % 20}", 1) for i in range(200)]
    rows += [(1000 + i, [f"请求超时，请检查网络后重新加载本页，错误代码：{i}"], f"h{i % 20}", 1) for i in range(60)]
    new = [(2000, ["请求超时，请检查网络后重新加载本页"], "h1", 1)]
    df = spark.createDataFrame(rows + new, FIELDS)
    found = {r.k for r in R.found(df, ["k"], "messages", "host").collect()}
    assert found == set(range(1000, 1060)) | {2000}


def test_unseen_hosts_are_judged_well(spark, data):
    from dialoom.llm.queries_residue import _fields

    pieces = _fields(spark, "/root/testdata/sf0.01").select("sales_id", F.explode(F.flatten(F.transform("messages", R.segments))).alias("segment"))
    model = R.train(pieces, "sales_id")
    assert model.unseen["recall"] >= 0.98
    assert model.unseen["precision"] >= 0.98


def test_phrases_that_no_label_knows(spark, data):
    """One phrase in five withheld from the labels: what is found, against what the whole list finds."""
    import zlib

    from dialoom.llm.queries_residue import _fields

    fields = _fields(spark, "/root/testdata/sf0.01").cache()
    pieces = fields.select("sales_id", F.explode(F.flatten(F.transform("messages", R.segments))).alias("segment"))
    ids = lambda model: {tuple(r) for r in R.found(fields, ["case_id", "field_name"], "messages", "sales_id", model).collect()}
    whole = ids(R.train(pieces, "sales_id"))
    recalls = []
    for part in (0, 2):
        got = ids(R.train(pieces, "sales_id", withheld=frozenset(p for p in R.PHRASES if zlib.crc32(p.encode()) % 5 == part)))
        recalls.append(len(got & whole) / len(whole))
        assert len(got & whole) >= 0.95 * len(got)
    assert sum(recalls) / len(recalls) >= 0.9


def test_long_slots_are_seen(spark):
    import re

    for slot in ("{{" + "x" * 200 + "}}", "${" + "x" * 200 + "}", "<<" + "x" * 200 + ">>", "【此处填写" + "课" * 200 + "】", "__" + "X" * 200 + "__"):
        assert re.search(R.SIGN, slot) and spark.range(1).select(F.lit(slot).rlike(rf"(?iU)(?:{R.SLOT})").alias("m")).first().m


def test_history_layouts(spark):
    rows = [("[客户][2026-01-01 00:00:00]: a\nb\n[CSM]: c",), ('[{"role": "客户", "content": "a"}, {"role": "x", "content": null}]',), ("客户: a",), (None,), ("[{broken",)]
    got = [r.m for r in spark.createDataFrame(rows, "h string").select(history_messages(F.col("h")).alias("m")).collect()]
    assert got == [["a", "b", "c"], ["a"], ["a"], [], ["[{broken"]]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("邮箱是A.b-1@EXAMPLE.org，发这里", ["email"]), ("reed (at) study [dot] example", ["email"]), ("x @ y.com", ["email"]),
        ("我电话161-7280-6156", ["phone"]), ("+86 16482476710", ["phone"]), ("０１６", []), ("一六八四九五八八二六四", ["phone"]), ("0572-18481813 转 806", ["phone"]), ("１６９３６１２７６１１", ["phone"]),
        ("身份证99065819900411001X", ["id_number"]), ("991250 19700108 9307", ["id_number"]), ("护照GX26446860", ["id_number"]),
        ("我家住汀州省青柳市溪松区桐砂里211号6栋985室", ["address"]), ("放松桥区 澜栖小区 22号楼1090房", ["address"]), ("33 Maple Bend Road吧", ["address"]),
        ("我叫陆鹿，想报名", ["person_name"]), ("my name is Ilsa Quillfeather, hi", ["person_name"]),
        ("学号S5914384，订单20263396627656，快递单号755395887877743，付款流水号883475000032500600，课程编号1406540901", []),
        ("沈老师之前说可以，小陆也在学，线下教室在几号楼", []), ("", []),
    ],
)
def test_types(text, kinds):
    assert P.mask(text, {})[1] == kinds


@pytest.mark.parametrize("name", ["张伟", "仝志强", "冼星海", "麦嘉琪", "阿依古丽"])
def test_names_of_any_surname_after_a_strong_pattern(name):
    assert P.mask(f"你好，我叫{name}，想报名", {})[0] == "你好，我叫<person_name>，想报名"
    patterns = {("person_name", "签的是", "P"): 0.9, ("filling", "^签的是", "P"): 0.9}
    assert P.mask(f"签的是{name}", patterns, P.known_lefts(patterns))[1] == ["person_name"]


@pytest.mark.parametrize("text", ["我叫什么", "我叫老师", "我叫你一声", "姓名：不填"])
def test_fillings_that_are_no_names(text):
    assert P.mask(text, {})[1] == []


def test_contexts_find_looser_forms_of_every_type(spark):
    texts = [f"邮箱是a{i}@x{i}.org" for i in range(20)] + [f"证件号：{110101 + i}19900101{1000 + i}" for i in range(20)]
    texts += [f"住址在柳溪路{i + 1}号" for i in range(20)] + [f"地址写桐砂里{i + 1}号" for i in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = P.induce(df)
    assert P.mask("邮箱是ab#x.org", patterns) == ("邮箱是<email>", ["email"])
    assert P.mask("证件号：110101990101123", patterns) == ("证件号：<id_number>", ["id_number"])
    assert P.mask("地址写幸福里三期西二门7层", patterns) == ("地址写<address>", ["address"])
    assert P.mask("图号ab#x.org，单号110101990101123", patterns)[1] == []


def test_odd_letters_and_accents_are_read_as_plain():
    assert P.mask("nаme is Ilsа Quillfeather", {})[0] == "nаme is <person_name>"
    assert P.mask("邮箱a\u0301b@x.org", {})[0] == "邮箱<email>"
    assert P.mask("讲义寄到桐柳路４０号吧", {})[0] == "讲义寄到<address>吧"


def test_rest_stays_to_the_character():
    assert P.mask("A，​我叫陆鹿，电话16482476710！", {})[0] == "A，​我叫<person_name>，电话<phone>！"
    assert P.mask("讲义寄到桐柳路40号吧", {})[0] == "讲义寄到<address>吧"


def test_contexts_find_names_without_seeds(spark):
    names = [a + b for a in "陆江沈秦顾" for b in ("鹿", "汀", "川", "禾", "瑾")]
    texts = [f"我叫{n}，想报名" for n in names] + [f"合同上签的是{n}" for n in names[::2]] + ["合同上签的是程瑾川", "沈老师说可以", "方便说下吗"] * 3 + [None, "", "x" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = P.induce(df)
    assert ("person_name", "上签的是", "P") in patterns
    assert P.mask("合同上签的是程瑾川", patterns) == ("合同上签的是<person_name>", ["person_name"])
    assert P.mask("沈老师说可以", patterns)[1] == []
    out = P.redact(df.withColumn("pii", F.lit(1)), "text", patterns).collect()
    assert len(out) == len(texts)
    assert P.induce(df.limit(0)) == {}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_masking_never_fails(text):
    masked, kinds = P.mask(text, {})
    assert kinds or masked == text
