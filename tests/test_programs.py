from __future__ import annotations

import json

import pytest

from dialoom.operators import scripts
from dialoom.plans import registry
from dialoom.session import table
from dialoom.sources import files


def test_unknown_things_are_errors(spark):
    with pytest.raises(KeyError):
        registry.run(spark, "nothing", {})
    with pytest.raises(ValueError, match="needs"):
        registry.run(spark, "process_reflow", {})
    with pytest.raises(ValueError, match="no parameters"):
        registry.run(spark, "merge_files", {}, {"x": 1})


def test_programs_run(spark, data, tmp_path):
    reflow, cases, talks = (table(spark, data, t) for t in ("reflow_rows", "testset", "tagging_corpus"))
    schema, tree = table(spark, data, "sop_schema"), table(spark, data, "sop_scripts")
    patterns = files.load_patterns(spark, [{"text": "打开App，点右上角", "category": "a"}, {"text": "打开App，点右上角", "category": "a", "name": "later"}, {"text": ""}])
    assert [r.name for r in patterns.collect()] == ["later"]
    jobs = {
        "process_reflow": ({"rows": reflow, "schema": schema}, {"target": "20"}),
        "run_sop_pipeline": ({"conversations": talks, "scripts": tree}, {}),
        "reference_matcher": ({"conversations": talks, "scripts": tree}, {"mode": "both"}),
        "extract_expected_utterance_parts": ({"rows": reflow}, {}),
        "preprocess_client_cases": ({"rows": reflow}, {}),
        "select_client_cases": ({"cases": cases}, {"total": 30}),
        "detect_scripted_replies": ({"replies": reflow, "patterns": patterns}, {}),
        "map_sop_ids": ({"labels": reflow.selectExpr("sop_l1 as l1", "sop_l2 as l2"), "schema": schema}, {}),
        "merge_files": ({}, {"folder": data, "pattern": "re*.parquet"}),
        "update_latest_customer_message": ({"rows": talks}, {}),
        "clean_bad_cases": ({"cases": cases}, {}),
        "cut_cases": ({"conversations": talks, "scripts": tree}, {}),
        "map_ai_turns": ({"turns": reflow.select("customer_id", "message_time"), "replies": reflow}, {}),
        "augment_questions": ({"replies": reflow.selectExpr("sent_text as reply")}, {}),
    }
    assert set(jobs) == set(registry.PROGRAMS)
    for name, (inputs, params) in jobs.items():
        for df in registry.run(spark, name, inputs, params).values():
            df.count()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "a long, b string").coalesce(1)
    files.write(df, str(tmp_path / "x.parquet"), max_rows=4)
    assert len(list((tmp_path / "x.parquet").glob("part-*"))) == 3
    assert files.read(spark, str(tmp_path / "x.parquet"), columns=["a"]).count() == 10
    files.write(df, str(tmp_path / "y.csv"))
    assert files.read(spark, str(tmp_path / "y.csv"), schema="a long, b string").count() == 10
    paths = files.write_sheets({"one": df, "two": df.limit(2)}, str(tmp_path / "book"))
    assert spark.read.parquet(paths["two"]).count() == 2
    assert files.read_folder(spark, str(tmp_path / "book")).columns[0] == "source_file"
    with pytest.raises(ValueError, match="no reader"):
        files.read(spark, "x.bin")
    assert "| t0 |" in files.markdown("r", {"t": df.select("b")})
    assert files.resolve_column(df, ["z", "b"]) == "b"
    assert files.project(df, ["b", "z"]).columns == ["b", "z"]


def test_row_order_follows_files_not_their_sizes(spark, tmp_path):
    spark.range(3).selectExpr("id", "'a' as f").coalesce(1).write.parquet(str(tmp_path / "t" / "a.parquet"))
    spark.range(200_000).selectExpr("id", "'b' as f").coalesce(1).write.parquet(str(tmp_path / "t" / "b.parquet"))
    df = files.with_row_order(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "t")))
    assert [tuple(r) for r in df.groupBy("f").agg({"row_order": "min"}).orderBy("f").collect()] == [("a", 0), ("b", 3)]
    assert df.filter("f = 'b' and row_order <> id + 3").count() == 0
    assert df.columns == ["id", "f", "row_order"]


def test_patterns_and_hits(spark):
    from dialoom.operators import compliance

    entries = [
        {"text": "今天的课程重点，请先看讲义", "category": "a", "name": "lesson"}, {"text": "打卡", "category": "class_invitation", "keywords": ["打卡", " 签到 "], "min_matches": 1, "mandatory_keywords": ["打卡"]},
        {"text": "第12节直播在20点", "category": "follow_up", "keywords": ["直播"], "min_matches": 1, "template": "第12节直播在20点", "name": "live"}, {"text": "x", "category": " "}, {"text": " ", "category": "a"},
        {"text": "省考", "category": "province_analysis", "keywords": ["省", "考"]}, {"text": "打卡", "category": "class_invitation", "keywords": ["打卡"], "name": "again"},
    ]
    patterns = files.load_patterns(spark, entries)
    assert [(r.pattern_id, r.category, r.name, r.min_matches, r.min_ratio) for r in patterns.orderBy("pattern_id").collect()] == [
        (1, "a", "lesson", 2, 0.45), (2, "class_invitation", "again", 2, 0.45), (3, "follow_up", "live", 1, 0.45), (4, "province_analysis", "pattern_6", 2, 0.5)
    ]
    replies = ["第34节直播在19点", "明天有直播", "请先看讲义吧", "打卡", "省里", None, " ", "考"]
    df = spark.createDataFrame([(t, 1) for t in replies], "reply string, n int")
    got = {r.reply: (r.is_hit, r.name, r.score) for r in compliance.annotate(df, "reply", patterns).collect()}
    assert got["第34节直播在19点"] == (True, "live", 1.0)
    assert got["打卡"] == (True, "again", 1.0)
    assert got["省里"] == (True, "pattern_6", 0.5) and got["考"][0]
    assert got["请先看讲义吧"] == (True, "lesson", 0.5)
    assert got["明天有直播"] == got[None] == got[" "] == (False, "", 0.0)
    with pytest.raises(ValueError, match="keywords"):
        compliance.hits(df.selectExpr("reply as text"), patterns.selectExpr("* except (min_matches)", "0 as min_matches"))


def test_small_helpers(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a string, b int")
    assert files.first_filled(df, ["z", "a", "b"]) == "b" and files.first_filled(df, ["a"]) is None
    assert files.renamed(df, {"a": "x", "q": "y"}).columns == ["x", "b"]
    files.write_sheets({"s/1": df}, str(tmp_path / "book"))
    assert files.read_sheets(spark, str(tmp_path / "book"), ["s/1"])["s/1"].count() == 2
    (tmp_path / "c.json").write_text('{"b": 2}')
    assert files.overlay({"a": 1, "b": 1}, str(tmp_path / "c.json")) == {"a": 1, "b": 2} == files.overlay({"a": 1, "b": 2}, str(tmp_path / "none.json"))
    with pytest.raises(ValueError, match="dicts"):
        files.write_rows(spark, [], str(tmp_path / "x"))


def test_tree(tmp_path):
    assert files.read_tree(str(tmp_path / "none.json")) == {}
    (tmp_path / "t.json").write_text(json.dumps({"A": {"B": {"参考话术": ["x", "y"], "相似话术": "z"}, "参考话术": ["w"]}}))
    rows = list(scripts.flatten_tree(files.read_tree(str(tmp_path / "t.json"))))
    assert [(r["path"], r["script_text"]) for r in rows] == [(["A"], "w"), (["A", "B"], "x"), (["A", "B"], "y"), (["A", "B"], "z")]


def test_library_needs_no_llm():
    from pathlib import Path

    root = Path(registry.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "dialoom.llm" not in p.read_text(encoding="utf-8")
