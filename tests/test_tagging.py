"""Regular, strong, fallback and merged matches on hand-made trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import scripts as S
from dialoom.operators import tagging as G

# script_id, path, node_order
TREE = [(1, ["A"], 0), (2, ["A", "a"], 1), (3, ["A", "a", "x"], 2), (4, ["A", "b"], 3), (5, ["B", "二次跟进"], 4), (6, ["A", "a", "x", "y"], 5)]


def scripts(spark):
    rows = [(i, p, len(p), n, "参考话术", 0, f"s{i}") for i, p, n in TREE]
    return spark.createDataFrame(rows, "script_id long, path array<string>, depth int, node_order int, script_type string, script_pos int, script_text string")


def inputs(spark, said):
    """``said``: (conv_id, pos, {script_id: similarity})."""
    sales = spark.createDataFrame([(c, p, f"{c}-{p}") for c, p, _ in said] or [], "conv_id long, pos int, text string")
    by = {i: path for i, path, _ in TREE}
    matches = [(f"{c}-{p}", by[i], len(by[i]), s, i) for c, p, found in said for i, s in found.items()]
    by_path = spark.createDataFrame(matches, "text string, path array<string>, depth int, similarity double, script_id long")
    paths = G.path_table(scripts(spark))
    found = G.hits(sales, by_path)
    return sales, found, G.candidates(found, paths), paths


def shown(df):
    return {r.conv_id: (">".join(r.path), r.pos, [(x.level, x.pos) for x in r.links]) for r in df.collect()}


def test_regular_takes_the_newest_message_and_looks_back_only(spark):
    said = [(1, 0, {2: 0.9}), (1, 2, {3: 0.9}), (1, 4, {4: 0.7}), (2, 0, {2: 0.9}), (2, 1, {3: 0.7}), (2, 3, {1: 0.9}), (3, 0, {1: 0.9})]
    assert shown(G.regular(inputs(spark, said)[2])) == {1: ("A>b", 4, [(2, 4)]), 2: ("A>a>x", 1, [(2, 0), (3, 1)])}


def test_later_messages_take_no_part_in_a_chain(spark):
    said = [(1, 0, {3: 0.9}), (1, 1, {2: 0.99})]
    chosen = inputs(spark, said)[2]
    assert {(r.pos, ">".join(r.path)): len(r.links) for r in chosen.collect()} == {(0, "A>a>x"): 1, (1, "A>a"): 1}


def test_ties_go_to_the_later_message_and_the_first_path(spark):
    said = [(1, 0, {2: 0.9}), (1, 1, {2: 0.9}), (1, 2, {3: 0.8}), (2, 0, {2: 0.9, 4: 0.9})]
    assert shown(G.regular(inputs(spark, said)[2])) == {1: ("A>a>x", 2, [(2, 1), (3, 2)]), 2: ("A>a", 0, [(2, 0)])}


def test_strong_needs_its_second_level_and_follow_ups_go_first(spark):
    said = [(1, 0, {2: 0.96}), (1, 1, {5: 0.86}), (2, 0, {2: 0.94}), (3, 0, {2: 0.95}), (3, 1, {3: 0.5}), (4, 0, {3: 0.99})]
    assert shown(G.strong(inputs(spark, said)[2])) == {1: ("B>二次跟进", 1, [(2, 1)]), 3: ("A>a>x", 1, [(2, 0), (3, 1)])}


def test_fallback_over_all_messages_and_single_levels(spark):
    said = [(1, 0, {2: 0.9}), (1, 1, {3: 0.8}), (1, 2, {1: 0.9}), (2, 0, {1: 0.7}), (2, 1, {1: 0.9}), (2, 2, {1: 0.9})]
    _, found, chosen, paths = inputs(spark, said)
    assert shown(G.fallback(found, chosen, paths)) == {1: ("A>a>x", 1, [(2, 0), (3, 1)]), 2: ("A", 1, [(1, 1)])}
    assert {r.conv_id: r.method for r in G.base_match(found, chosen, paths).collect()} == {1: "regular", 2: "fallback"}


def link(level, pos, similarity, script=9):
    return {"level": level, "pos": pos, "similarity": similarity, "script_id": script}


def test_carrying_on():
    v, predicted = ["A", "a"], ["A", "a", "x", "y"]
    strong = [link(2, 1, 0.97)]
    run = lambda path, links, offers=(): [x if not isinstance(x, list) or not x or isinstance(x[0], str) else [(k["level"], k["pos"]) for k in x] for x in G.carry_on(path, links, v, strong, predicted, list(offers))]
    assert run(["A", "a", "x"], [link(2, 0, 0.6), link(3, 4, 0.7)]) == [["A", "a", "x"], "", [(2, 1), (3, 4)]]
    assert run(None, None) == [["A", "a"], "", [(2, 1)]]
    assert run(["A", "b", "z"], [link(2, 3, 0.7), link(3, 5, 0.7)], [link(3, 5, 0.65)]) == [["A", "a", "x"], "成功", [(2, 1), (3, 5)]]
    assert run(["A", "b", "z"], [link(2, 3, 0.7), link(3, 5, 0.7)], [link(3, 5, 0.58), link(4, 6, 0.56)]) == [["A", "a", "x", "y"], "成功", [(2, 1), (4, 6)]]
    assert run(["A", "b", "z"], [link(2, 3, 0.7), link(3, 5, 0.7)]) == [["A", "a"], "失败", [(2, 1)]]
    assert G.carry_on(["A"], [link(1, 0, 0.5)], None, None, None, None) == (["A"], "", [link(1, 0, 0.5)])


def test_merged_in_spark(spark):
    said = [(1, 0, {2: 0.97}), (1, 2, {4: 0.7}), (1, 3, {}), (2, 0, {1: 0.9}), (3, 0, {2: 0.99, 3: 0.8})]
    sales, found, chosen, paths = inputs(spark, said)
    near = spark.createDataFrame([("1-3", 3, 0.6), ("1-2", 4, 0.7), ("1-0", 2, 0.97)], "text string, script_id long, similarity double")
    out = G.merged(G.base_match(found, chosen, paths), G.strong(chosen), sales, near, scripts(spark), S.predicted_paths(scripts(spark)))
    told = {r.conv_id: (">".join(r.path), r.method, r.tail, [(x.level, x.pos) for x in r.levels]) for r in out.collect()}
    assert told == {1: ("A>a>x", "strong", "成功", [(2, 0), (3, 3)]), 2: ("A", "fallback", "", [(1, 0)]), 3: ("A>a>x", "strong", "", [(2, 0), (3, 0)])}
    missing = out.select("conv_id", S.unmatched_levels(F.col("path"), F.col("levels")).alias("m")).collect()
    assert {r.conv_id: r.m for r in missing} == {1: "", 2: "第2级未匹配", 3: ""}


def test_no_messages(spark):
    sales, found, chosen, paths = inputs(spark, [])
    assert G.base_match(found, chosen, paths).count() == G.strong(chosen).count() == 0


def test_sales_before_the_last_customer_message(spark):
    rows = spark.createDataFrame([(1, 0, "销售", "a"), (1, 1, "客户", "b"), (1, 2, "销售", "c"), (2, 0, "销售", "d")], "conv_id long, pos int, speaker string, text string")
    got = G.until_last_customer(rows, F.col("speaker") == "销售", F.col("speaker") == "客户").collect()
    assert [(r.conv_id, r.text) for r in got] == [(1, "a")]


def test_reordered_and_single_characters_are_candidates(spark):
    texts = spark.createDataFrame([("ab",), ("好",), (None,), ("zz",)], "text string")
    tree = spark.createDataFrame([(1, "ba"), (2, "好")], "script_id long, script_text string")
    assert {(r.text, r.script_id, r.similarity) for r in S.lexical_matches(texts, tree, 0.5).collect()} == {("ab", 1, 1.0), ("好", 2, 1.0)}


def sentence(conv, pos, place, path, similarity):
    return (conv, pos * G.SPOT + place, path, len(path), similarity)


def test_sentencewise_prefers_two_levels_and_carries_on(spark):
    hits = spark.createDataFrame([
        sentence(1, 0, 0, ["A", "a"], 0.9), sentence(1, 0, 1, ["A", "a", "x"], 0.8), sentence(1, 3, 0, ["A", "b"], 0.7),
        sentence(2, 0, 0, ["A", "a"], 0.9), sentence(2, 1, 0, ["A", "a", "x"], 0.8), sentence(2, 2, 1, ["A", "a", "x", "y"], 0.7),
        sentence(3, 5, 0, ["A", "a", "x"], 0.8),
        sentence(4, 1, 1, ["A", "a"], 0.9), sentence(4, 1, 0, ["A", "a", "x"], 0.95),
    ], "conv_id long, spot long, path array<string>, depth int, similarity double")
    branches = spark.createDataFrame([(p,) for _, p, _ in TREE if len(p) > 1], "path array<string>")
    chosen = G.sentencewise(hits, branches)
    got = {r.conv_id: (">".join(r.path), [x.level for x in r.links]) for r in chosen.collect()}
    assert got == {1: ("A>b", [2]), 2: ("A>a>x>y", [2, 3, 4]), 3: ("A>a>x", [3]), 4: ("A>a>x", [2, 3])}
    start = spark.createDataFrame([(2, ["A", "a"], [(2, 0, 0.9)]), (4, ["A", "a"], [(2, G.SPOT + 1, 0.9)])], "conv_id long, path array<string>, links array<struct<level:int,spot:long,similarity:double>>")
    longer = {r.conv_id: ">".join(r.path) for r in G.extend_branch(start, hits, 4).collect()}
    assert longer == {2: "A>a>x>y", 4: "A>a"}


def test_aliases_by_family(spark):
    aliases = spark.createDataFrame([("module", "资料", "资料分析"), ("module", "言语", "y"), ("province", "浙江", "浙"), ("exam", "国考", "国家")], "family string, canonical string, alias string")
    texts = spark.createDataFrame([("我考浙江的资料分析",), ("我在浙国家",), ("Y不好",), ("无",), (None,)], "text string")
    got = {r.text: r["items"] for r in S.resolve_aliases(texts, aliases, [["module", "province"], ["exam"]]).collect()}
    assert got == {"我考浙江的资料分析": ["资料"], "我在浙国家": ["国考", "浙江"], "Y不好": ["言语"]}


def test_expected_fields(spark):
    tree = {"A": {"下一步动作": "去a", "预期话术": {"客户回复资料": "p", "言语": "q"}, "a": {"关键信息": ["i"], "预期话术": ["r", "s"]}, "b": {"关键信息": "j"}, "c": {}}}
    nodes = spark.createDataFrame(G.node_table(tree, S.SCRIPT_LISTS + S.NODE_DATA), G.NODES)
    chosen = spark.createDataFrame([(1, ["A"], None, "资料"), (2, ["A"], None, "x"), (3, ["A", "a"], None, None), (4, ["Z"], None, "x")], "conv_id long, path array<string>, predicted array<string>, text string")
    items = spark.createDataFrame([("资料", ["资料"])], "text string, items array<string>")
    got = {r.conv_id: (r.next_action, r.utterances, r.notes) for r in G.expected_fields(chosen, nodes, items).collect()}
    assert got == {1: ("去a", {"客户回复资料": "p"}, {"a": ["i"], "b": ["j"]}), 2: ("去a", {"客户回复资料": "p", "言语": "q"}, {"a": ["i"], "b": ["j"]}), 3: ("", {"": "r"}, {})}
    deep = {"A": {"B": {"C": {"D": {"下一步动作": "再去F", "E": {"关键信息": "e"}, "F": {"关键信息": "f"}}}}}}
    nodes = spark.createDataFrame(G.node_table(deep, S.SCRIPT_LISTS + S.NODE_DATA), G.NODES)
    at = ["A", "B", "C", "D"]
    chosen = spark.createDataFrame([(1, at, [*at, "E"], "x"), (2, at, at, "x")], "conv_id long, path array<string>, predicted array<string>, text string")
    assert {r.conv_id: r.notes for r in G.expected_fields(chosen, nodes, items).collect()} == {1: {"E": ["e"]}, 2: {"F": ["f"]}}


def test_verify_tells_why(spark):
    conversations = spark.createDataFrame([(1, "x", "A", "a"), (2, "x", None, "a"), (3, " ", "A", "a"), (4, "x", "A", "a"), (5, "x", "Z", "z"), (6, "x", "A", " A "), (7, "x", "A", "ａ")], "conv_id long, final_context string, sop_l1 string, sop_l2 string")
    sales = spark.createDataFrame([(c, p, "t", f"{c}-{p}") for c, p in ((1, 0), (1, 2), (2, 0), (5, 0), (6, 0), (7, 0))], "conv_id long, pos int, ts string, text string")
    matches = spark.createDataFrame([("1-0", 2, 0.9), ("1-2", 4, 0.9), ("6-0", 1, 0.9), ("7-0", 3, 0.9)], "text string, script_id long, similarity double")
    got = {r.conv_id: (r.match_reason, r.match_hit, r.pos, r.turn_from_last, r.latest_sales_message) for r in G.verify(conversations, sales, matches, scripts(spark)).collect()}
    assert got == {
        1: ("", "是", 0, 2, "1-2"), 2: (G.NO_LABEL, "否", None, None, "2-0"), 3: (G.NO_HISTORY, "否", None, None, ""), 4: (G.NO_SALES, "否", None, None, ""), 5: (G.NO_SCRIPTS, "否", None, None, "5-0"),
        6: (G.NO_MATCH, "否", None, None, "6-0"), 7: ("", "是", 0, 1, "7-0"),
    }
