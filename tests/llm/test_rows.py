"""Problems 2 and 3."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import catalog
from dialoom.llm import conversations as C
from dialoom.llm import formatting_duplicates as D

MESSAGES = "row_id long, file_id string, msg_id long, sender_role string, processed_text string, dialogue_time timestamp_ntz, loaded_at timestamp_ntz, code int, m string, blank string"
T0 = datetime(2026, 1, 1)


def row(i, file, msg, role, text, at, loaded=0):
    return (i, file, msg, role, text, None if at is None else T0 + timedelta(seconds=at), T0 + timedelta(seconds=loaded), 7, "m", "b")


def brute(rows):
    once = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        if r[1] is not None:
            once.setdefault((r[1], r[2]), r)
    by = defaultdict(list)
    for r in once.values():
        by[r[1]].append(r)
    blank = lambda t: t is None or t.strip().lower() in ("", "nan", "none", "[]", "{}")
    out = []
    for file, rs in by.items():
        if sorted((r[2] for r in rs), key=lambda x: (x is None, x)) != list(range(1, len(rs) + 1)):
            continue
        talk = [r for r in rs if not blank(r[4])]
        if not talk or any(r[5] is None for r in talk):
            continue
        talk.sort(key=lambda r: (r[5], r[2]))
        sides = []
        for r in talk:
            x = (r[3] or "").strip().lower()
            sides.append("c" if x in ("客户", "customer") else "s" if x in ("csm", "sales") or x.startswith("销售") else "y" if x in ("系统", "system") else "x")
        if "x" in sides or "c" not in sides or "s" not in sides[sides.index("c") :]:
            continue
        out += [(file, i + 1, r[2]) for i, r in enumerate(talk)]
    return sorted(out)


def test_random_conversations_split_over_partitions(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for c in range(60):
        size = 120 if c == 0 else rng.randint(1, 7)  # one holds about a third of the rows
        for m in range(1, size + 1):
            if rng.random() < (0 if c == 0 else 0.04):
                continue
            for copy in range(1 + (rng.random() < 0.1)):
                n += 1
                role = rng.choice(["客户", " Customer ", "CSM", "销售小李", "SALES", "系统"] + (["机器人", None] if rng.random() < 0.03 and c else []))
                text = rng.choice(["hi", "好", " ", "NaN", None, "[]"]) if rng.random() < 0.3 else "x"
                rows.append(row(n, f"f{c}" if c != 9 else None, m, role, text, None if c and rng.random() < 0.01 else rng.randint(0, 50), loaded=copy * 5))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, MESSAGES)
    expected = brute(rows)
    assert sum(r[0] == "f0" for r in expected) > 50
    for parts in (1, 3, 11):
        assert sorted(tuple(r) for r in C.rebuild(df, parts).select("file_id", "seq", "msg_id").collect()) == expected


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([], 0),
        ([row(1, "f", 1, "客户", "a", 1)], 0),
        ([row(1, "f", 1, "客户", "a", 1), row(2, "f", 2, "CSM", "b", 1)], 2),
        ([row(1, "f", 2, "客户", "a", 1), row(2, "f", 1, "CSM", "b", 1)], 0),
        ([row(1, "f", 1, "客户", "a", 1), row(2, "f", 2, "CSM", " none ", 2)], 0),
        ([row(1, "f", 1, "客户", "a" * 100_000, 1), row(2, "f", 2, "sales", "b", 2)], 2),
        ([row(1, "f", None, "客户", "a", 1), row(2, "f", 1, "CSM", "b", 2)], 0),
        ([row(1, "f", 1, None, None, None), row(2, "f", 2, "客户", "a", 1), row(3, "f", 3, "CSM", "b", 2)], 2),
        ([row(1, None, 1, "客户", "a", 1), row(2, None, 2, "CSM", "b", 2)], 0),
    ],
)
def test_single_conversations(spark, rows, kept):
    assert C.rebuild(spark.createDataFrame(rows, MESSAGES)).count() == kept


@given(st.lists(st.integers(0, 3), max_size=12), st.integers(0, 12))
def test_transitions_compose(word, cut):
    def run(w):
        f = 0
        for c in w:
            f = C.STEP[f][c]
        return f

    a, b = C.FUNCTIONS[run(word[:cut])], C.FUNCTIONS[run(word[cut:])]
    assert C._compose(a, b) == C.FUNCTIONS[run(word)]


CASES = "case_id long, customer_id string, latest_message string, id int, scope int, canon int, h int"


def copies(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], CASES)
    return sorted(tuple(r) for r in D.copies(df, "case_id", "latest_message", ["customer_id"], **options).collect())


def test_what_is_equal(spark):
    rows = [
        (1, "c", "Hello, World!"), (2, "c", " hello world"), (3, "c", "ｈello world"), (4, "d", "hello world"), (5, None, "hello world"), (6, None, "HELLO WORLD。"),
        (7, "c", "状态：待业；设备：Mac"), (8, "c", '{"设备": "mac", "状态": "待业"}'), (9, "c", "设备 : mac，状态 : 待业。"), (10, "c", "状态：待业；设备：PC"),
        (11, "c", None), (12, "c", " NaN "), (13, "c", "！！"), (14, "c", "。"), (15, "c", None), (16, "c", "x" * 100_000), (17, "c", "X" * 100_000),
    ]
    assert copies(spark, rows) == [(1, 2), (5, 6), (7, 8), (7, 9), (16, 17)]


def test_empty_and_repeated_rows(spark):
    assert copies(spark, []) == []
    assert copies(spark, [(1, "c", "a"), (1, "c", "a"), (2, "c", "a")]) == [(1, 2)]


def test_any_filter_size_gives_the_same(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), "hot" if rng.random() < 0.33 else f"t{rng.randint(0, 300)}") for i in range(600)]
    first = {}
    for i, c, t in rows:
        first.setdefault((c, t), i)
    expected = sorted((first[c, t], i) for i, c, t in rows if first[c, t] != i)
    for options in ({}, {"max_filter_bytes": 64}, {"range_rows": 7}, {"range_rows": 50, "max_filter_bytes": 16}, {"hot_groups": 1}):
        assert copies(spark, rows, **options) == expected
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], CASES)
    collapsed = D.collapse(df, "case_id", "latest_message", ["customer_id"]).collect()
    assert sum(r.copies for r in collapsed) == 600
    assert len(collapsed) == len(first)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30), min_size=1, max_size=4))
def test_merged_filter_misses_no_repeat(parts):
    import numpy as np

    for ranges in (1, 3):
        partials = defaultdict(list)
        for p in parts:
            values, counts = np.unique(np.array(p, dtype=np.int64), return_counts=True)
            for place, hashes, again in D.partial(values, counts > 1, ranges):
                partials[place].append((hashes, again))
        for folds in (0, 2):
            filters = {k: D.merge(v) for k, v in partials.items()}
            for _ in range(folds):
                filters = {k: D.fold(f) for k, f in filters.items()}
            every = [x for p in parts for x in p]
            repeated = np.array([x for x in set(every) if every.count(x) > 1], dtype=np.int64)
            assert D.Repeats(filters, ranges).has(repeated).all()


@pytest.mark.parametrize("ranges", [1, 8])
def test_few_singletons_pass_at_any_size(ranges):
    import numpy as np

    rng = np.random.default_rng(1)
    single, twice = rng.integers(-(2**63), 2**63 - 1, 200_000 * ranges), rng.integers(-(2**63), 2**63 - 1, 20_000 * ranges)
    partials = defaultdict(list)
    for p in (np.concatenate([single[::2], twice]), np.concatenate([single[1::2], twice])):
        for place, hashes, again in D.partial(p, np.zeros(len(p), bool), ranges):
            partials[place].append((hashes, again))
    repeats = D.Repeats({k: D.merge(v) for k, v in partials.items()}, ranges)
    assert repeats.has(twice).all()
    assert repeats.has(single).mean() < 0.02
    assert len(repeats.bitmap) <= 4.5 * len(twice)


def test_items_of_any_length_and_runs_of_any_length(spark):
    name = "名" * 200
    assert copies(spark, [(1, "c", f"y:2, {name}:1"), (2, "c", f"{name}:1,y:2"), (3, "c", f"y：2{'。' * 300}{name}：1")]) == [(1, 2), (1, 3)]
    long = [(1, "c", "a" + " " * 100_000 + "b"), (2, "c", "a" + "。" * 100_000 + "b"), (3, "c", ", " * 50_000 + "ab")]
    assert copies(spark, long) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalog.queries()[name], catalog.oracles()[name])
