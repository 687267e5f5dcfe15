"""Problems 8, 9 and 10."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import packing as K
from dialoom.llm import quality as Q
from dialoom.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(Path(T.VOCABULARY).with_name("byte_bpe_50k.json")))
    whole.encode_special_tokens = True
    return T.Encoder(T.read_vocabulary()), whole


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="a'sstll  \n\té中文1!？，　  😀", max_size=40))
def test_ids_are_those_of_the_whole_text(both, text):
    encoder, whole = both
    assert encoder.ids(text) == whole.encode(text, add_special_tokens=False).ids


def test_ids_in_spark(spark, both):
    rows = [(1, "好的, it's <|endoftext|>"), (2, None), (3, ""), (4, "中" * 60_000), (1, "好的, it's <|endoftext|>"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as tokens")
    out = [(r.doc_id, r.ids, r.tokens) for r in T.encode(df, "text").collect()]
    assert sorted(len(i) for _, i, _ in out) == sorted(len(both[1].encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert {d: i for d, i, _ in out}[2] == [] == {d: i for d, i, _ in out}[3]
    assert all(t == 7 for *_, t in out)
    assert T.encode(df.limit(0), "text").count() == 0
    assert sorted(r.tokens for r in T.count(df, "text").collect()) == sorted(len(i) for _, i, _ in out)


def pack(spark, items, capacities, **options):
    sized = spark.createDataFrame(items, "id long, tokens long, source string, cluster long").selectExpr("*", "1 as piece", "2 as room", "3 as shard")
    caps = spark.createDataFrame(capacities, "capacity_id int, capacity_tokens int")
    return [tuple(r) for r in K.pack(sized, caps, **options).collect()]


def check(items, capacities, rows):
    for cid, room in capacities:
        mine = [r for r in rows if r[0] == cid]
        load = Counter()
        for _, box, _, _, n in mine:
            load[box] += n
        assert max(load.values(), default=0) <= room
        total = Counter()
        for _, _, i, _, n in mine:
            total[i] += n
        want = Counter()
        for i, n, *_ in items:
            want[i] += n
        assert total == want
        pieces = Counter(r[2] for r in mine)
        for i, n, *_ in items:
            if n <= room and sum(x[0] == i for x in items) == 1:
                assert pieces[i] == 1
    return rows


def test_packing_is_valid_and_tight(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([0, 1, 3, 40, 90, 200, 700]), rng.choice(["a", "b", None]), 0 if rng.random() < 0.33 else i) for i in range(800)]
    capacities = [(1, 100), (2, 512)]
    rows = check(items, capacities, pack(spark, items, capacities))
    for cid, room in capacities:
        boxes = {r[1] for r in rows if r[0] == cid}
        need = -(-sum(i[1] for i in items) // room)
        assert len(boxes) <= 1.12 * need
    check(items, capacities, pack(spark, items, capacities, shard_tokens=5000))


def test_packing_edges(spark):
    assert pack(spark, [], [(1, 10)]) == []
    items = [(None, 3, None, 1), (2, 25, "a", 2), (3, 20, "a", 3), (4, 0, "a", 4), (4, 0, "a", 4)]
    rows = check(items, [(1, 10)], pack(spark, items, [(1, 10)]))
    assert sorted(n for *_, n in rows if n == 10) == [10, 10, 10, 10]
    with pytest.raises(ValueError, match="positive"):
        pack(spark, items, [(1, 0)])


def test_repeated_and_missing_ids_never_overfill(spark):
    items = [(None, 25, "a", 1), (None, 25, "a", 1), (7, 25, "a", 2), (7, 25, None, 2), (None, 25, "b", 1)]
    for options in ({}, {"shard_tokens": 30}):
        rows = pack(spark, items, [(1, 10)], **options)
        held = Counter()
        for _, box, _, _, n in rows:
            held[box] += n
        assert max(held.values()) <= 10 and sum(held.values()) == 125


def test_conflicts_hold_through_the_operator(spark):
    items = [(i, 3, "ab"[i % 2], i) for i in range(40)]
    source = {i: s for i, _, s, _ in items}
    held = defaultdict(set)
    for r in K.pack(spark.createDataFrame(items, "id long, tokens long, source string, cluster long"), spark.createDataFrame([(1, 10)], "capacity_id int, capacity_tokens int"), frozenset({("a", "b")})).collect():
        held[r.container_id].add(source[r.id])
    assert all(len(s) == 1 for s in held.values()) and len(held) == 14


def test_shards_grow_with_the_capacity(spark):
    items = [(i, 100, "a", i) for i in range(400)]
    rows = pack(spark, items, [(1, 1000)], shard_tokens=1000)
    assert len({r[1] for r in rows}) == 40


def test_copies_and_named_sources_stay_apart():
    import pandas as pd

    items = pd.DataFrame({"size": [3] * 8 + [1] * 4, "source": list("abababab") + ["a"] * 4, "cluster": [1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]})
    bins = K.pack_shard(items, 10)
    for c in (1, 7):
        used = [b for b, x in zip(bins, items["cluster"], strict=True) if x == c]
        assert len(used) == len(set(used)) or max(Counter(used).values()) <= -(-len(used) // -(-28 // 10))
    apart = K.pack_shard(items, 10, frozenset({("a", "b")}))
    held = defaultdict(set)
    for b, s in zip(apart, items["source"], strict=True):
        held[b].add(s)
    assert all(len(s) == 1 for s in held.values())


def test_hot_copies_cost_no_container():
    import pandas as pd

    items = pd.DataFrame({"size": [1] * 300, "source": ["a"] * 300, "cluster": [1] * 200 + list(range(2, 102))})
    assert len(set(K.pack_shard(items, 100))) == 3


def test_types_agree_with_labels(spark, data):
    from dialoom.llm.queries_quality import p10_agreement

    rows = p10_agreement(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.documents for r in rows if r.label == r.kind) >= 0.95 * sum(r.documents for r in rows)


def test_types_edges(spark):
    words = spark.createDataFrame([("zh", "的"), ("en", "the")], "lang string, word string")
    rows = [(1, None, "zh"), (2, "", None), (3, " \n", "en"), (4, "a" * 100, None), (5, "今天的课讲的是考试的重点，大家的问题很多。" * 3000, "zh"), (None, "1. a\n2. b\n3. c\n4. d\n5. e", "xx"), (4, "a" * 100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as q", "2 as votes", "3 as id")
    kinds = [(r.id, r.kind) for r in Q.types(df, "doc_id", "text", "lang", words).collect()]
    assert sorted(k for k, _ in kinds if k is not None) == [4, 4, 5]
    assert dict(kinds)[4] == "junk"
    assert dict(kinds)[5] == "prose"
    assert dict(kinds)[None] == "list"
    assert Q.types(df.limit(0), "doc_id", "text", "lang", words).count() == 0
    assert Q.types(df, "doc_id", "text", "lang", words.limit(0)).count() == 4


def test_learning_prefers_agreement():
    names = [n for n, *_ in Q._functions()]
    bit = lambda *n: sum(1 << names.index(x) for x in n)
    learned = Q.learn({bit("fluent", "sentences", "long_lines", "worded"): 900, bit("rows", "cells", "delimited"): 50, bit("rows", "cells"): 20, bit("marked", "entries", "short"): 60, bit("rare"): 10, bit("symbols"): 10})
    best = {m: Q.TYPES[int(p.argmax())] for m, p in learned.items()}
    assert best[bit("rows", "cells")] == "table"
    assert best[bit("rare")] == "junk"
    assert best[bit("marked", "entries", "short")] == "list"
    assert Q.learn({}) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'’-é中々1٣. 。,、\ńjZ�é$|\U00020001", max_size=30), max_size=4))
def test_character_counts_are_those_of_the_patterns(texts):
    import regex

    han = r"\p{Script=Han}"
    patterns = {
        "chars": r"\S", "word_chars": r"[\p{L}\p{N}]", "words": rf"{han}|(?!{han})\p{{L}}(?:(?!{han})[\p{{L}}\p{{M}}'’\-])*|(?:(?!{han})\p{{N}})+", "symbols": r"[\p{S}#%&*+/<=>@\\^_|~\[\]{}§°¤$]", "han": han,
        "digits": r"\p{N}", "strung": "[、/|,，;；]", "garbled": "[\u0080-ÿ�□]", "stops": rf"[。！？!?]|\.(?=\s|\Z|{han}|[”\"])", "odd": "[jqxzJQXZ]", "basic": "[a-zA-Z]",
    }
    for text, row in zip(texts, Q.count_classes(texts), strict=True):
        assert dict(zip(Q.COUNTS, row.tolist(), strict=True)) == {k: len(regex.findall(p, text)) for k, p in patterns.items()}
