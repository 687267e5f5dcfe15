from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.operators import nested as N
from dialoom.operators import payload

SCHEMA = "case_id long, rag string, thought_unit string"


def found(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in N.positions(N.label_nodes(df, "case_id", kinds=N.LINEAGE, with_fields=False)).collect())


def test_layers_positions_and_lone_objects(spark):
    rag = {"data": {"recall": [{"content": "[{'a': None}, 'x', {'问卷内容': {'q': 1}}]"}, None, {"content": {"b": 1}}]}}
    unit = {"rag_fast_chat_result": json.dumps([{"question": 1}, "无"])}
    rows = [(1, json.dumps(json.dumps(rag, ensure_ascii=False)), str([unit, None, unit]))]
    assert found(spark, rows) == [
        (1, "answer", 0, 0, -1), (1, "answer", 2, 0, -1), (1, "entry", 0, 0, -1), (1, "entry", 0, 2, -1), (1, "entry", 2, 0, -1),
        (1, "question", 0, 2, 0), (1, "recall", 0, -1, -1), (1, "recall", 2, -1, -1), (1, "unit", 0, -1, -1), (1, "unit", 2, -1, -1),
    ]


def test_undecodable_blank_and_missing_payloads_hold_nothing(spark):
    texts = [None, "", "  ", "nan", "None", "[]", "{}", '{"data": {"recall": [{"db', "{'a': ", "5", '"text"', "[1, 2"]
    assert found(spark, [(i, t, t) for i, t in enumerate(texts)]) in ([], [(6, "unit", 0, -1, -1)])
    assert found(spark, []) == []


def test_recall_at_the_top_and_under_data(spark):
    assert found(spark, [(1, '{"recall": {"content": []}}', None), (2, '{"data": "{\\"recall\\": [{}]}"}', None)]) == [(1, "recall", 0, -1, -1), (2, "recall", 0, -1, -1)]


def test_null_and_large_keys_repeated_rows_and_clashing_columns(spark):
    schema = "case_id long, rag string, thought_unit string, row_no int, key int, kind int, pre int, payload_0 int"
    big = 2**53 + 1
    rows = [(None, None, '{"a": 1}', 1, 1, 1, 1, 1), (big, None, '{"a": 1}', 1, 1, 1, 1, 1), (big, None, '{"a": 1}', 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    keys = [r.key for r in N.positions(N.label_nodes(df, "case_id", kinds=N.LINEAGE)).collect()]
    assert sorted(keys, key=str) == sorted([None, big, big], key=str)


def test_very_long_payload_is_read_whole(spark):
    rag = json.dumps({"recall": [{"content": [{"n": i} for i in range(5000)]}]})
    assert sum(r[1] == "entry" for r in found(spark, [(1, rag, None)])) == 5000


def test_very_deep_payload_does_not_fail(spark):
    assert found(spark, [(1, "[" * 100_000, "{'a':" * 50_000)]) == []
    deep = json.dumps({"recall": {"x": json.loads("[" * 900 + "1" + "]" * 900)}})
    assert [n[0] for n in N.traverse(deep, "rag")] == ["rag", "recall"] and N._scalars(N.traverse(deep, "rag")[1][6])


trees = st.recursive(st.none() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["recall", "content", "问卷内容", "data", "x"]), x, max_size=3), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_intervals_nest_and_numbers_are_unique(tree):
    nodes = N.traverse(json.dumps(tree), "rag")
    first = 0 if nodes and nodes[0][0] == "rag" else 1
    assert sorted(n[1] for n in nodes) == list(range(first, len(nodes) + first))
    assert len({n[2] for n in nodes}) == len(nodes)
    for b in nodes:
        holders = [a for a in nodes if a[1] < b[1] and a[2] > b[2]]
        assert len(holders) == b[3] - first


def test_literals_and_json_agree():
    value = {"data": {"recall": [{"content": [{"a": True, "b": None, "c": "It's"}]}]}}
    strip = lambda rows: [r[:5] for r in rows]
    assert strip(N.traverse(json.dumps(value), "rag")) == strip(N.traverse(str(value), "rag")) == strip(N.traverse(json.dumps(str(value)), "rag"))


def test_fields_agree_with_the_stored_columns(spark, data):
    from dialoom.operators import payload
    from dialoom.session import table

    cases = table(spark, data, "testset")
    fields = payload.entry_fields(cases.select("case_id", "rag"), "case_id")
    stored = cases.select("case_id", cases["batch_id"].alias("stored")).filter("stored is not null")
    joined = fields.join(stored, "case_id")
    assert joined.count() > 10
    assert joined.filter("batch_id = stored").count() >= 0.9 * joined.count()  # the stored ones were made before the payloads were damaged


def test_text_layers_without_end():
    value = {"recall": [{"content": [{"问卷内容": {"q": 1}}]}]}
    for _ in range(12):
        value = json.dumps(value)
    assert [n[0] for n in N.traverse(value, "rag")] == ["rag", "recall", "entry", "question"]


def test_objects_in_any_array_are_nodes_and_plain_arrays_stay(spark):
    unit = {"k": [{"x": 1}, {"y": 2}], "tags": ["p", "q"], "o": {"z": [[{"w": 1}], {"v": None}]}, "none": None, "empty": []}
    df = spark.createDataFrame([(1, None, json.dumps(unit))], SCHEMA)
    rows = sorted(N.label_nodes(df, "case_id").collect(), key=lambda r: r.pre)
    assert [(r.kind, r.field, r.pos, json.loads(r.fields)) for r in rows] == [
        ("unit", "", 0, {"tags": ["p", "q"], "none": None, "empty": []}), ("object", "k", 0, {"x": 1}), ("object", "k", 1, {"y": 2}),
        ("object", "o", -1, {}), ("object", "z", 0, {"w": 1}), ("object", "z", 1, {"v": None}),
    ]
    assert all(a.post > b.post for a, b in ((rows[0], rows[1]), (rows[3], rows[4])))


def test_what_stands_beside_a_ruled_array_is_kept():
    rag = {"code": 0, "data": {"page": {"n": 1}, "recall": [{"a": 1}]}, "extra": [{"b": 2}]}
    assert [(n[0], n[5]) for n in N.traverse(json.dumps(rag), "rag")] == [("rag", ""), ("recall", "recall"), ("object", "extra"), ("object", "page")]


def test_fields_come_from_their_store(spark):
    user = {"db_name": "用户信息库", "content": str([{"批次ID": "", "标签": "t"}, {"批次ID": "b1", "用户昵称": "n"}])}
    survey = {"db_name": "调查问卷库", "content": [{"问卷标题": "q", "问卷内容": json.dumps([{"a": 1}, {"b": 2}]), "批次ID": "no"}]}
    sales = {"db_name": "销售信息库", "content": {"直播课时间": "20:00", "试学链接": "x"}}
    again = {"db_name": "用户信息库", "content": [{"批次ID": "b2"}]}
    rows = [(1, json.dumps({"data": {"recall": [survey, user, sales, again]}}, ensure_ascii=False), None), (2, "{'damaged': '批次ID', '批次ID': 'b9', 'x", None), (3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.case_id: r for r in payload.entry_fields(df, "case_id").collect()}
    assert set(got) == {1, 2}
    assert (got[1].batch_id, got[1].tags, got[1].nickname, got[1].live_time, got[1].trial_link) == ("b1", "t", "n", "20:00", "x")
    assert json.loads(got[1].questionnaire_content) == [{"a": 1}, {"b": 2}]
    assert got[2].batch_id == "b9"
    assert payload.entry_fields(df, "case_id", last_wins=("batch_id",)).filter("case_id = 1").first().batch_id == "b2"


def test_unit_fields(spark):
    units = [
        {"endpoint_step": "普通", "knowledge_scenario_result": True, "rag_history_chat_request_body": {"node_1st": "A", "node_2nd": ""}},
        {"endpoint_step": "强遵循", "reference_script": ["s"], "task_theme": "T", "rag_chat_result": json.dumps([{"db_name": "用户信息库", "content": [{"周期标签": {"行课期": 1}}]}], ensure_ascii=False)},
    ]
    df = spark.createDataFrame([(1, None, json.dumps(units, ensure_ascii=False)), (2, None, "{}"), (3, None, None)], SCHEMA)
    got = {r.case_id: tuple(r)[1:] for r in payload.unit_labels(df, "case_id").collect()}
    assert got[1] == ("T", None, True, False, True, "A", None, '["s"]')
    assert got[2] == (None, None, False, False, False, None, None, None) and 3 not in got
    assert [tuple(r) for r in payload.unit_cycle_label(df, "case_id").collect()] == [(1, '{"行课期": 1}')]
