"""Problem 4."""

from __future__ import annotations

import random

from dialoom.llm import subset as S

SCHEMA = "case_id long, cycle string, message_type string, sales_id string, latest_message string, a int, b int, text int, copies int, place int"


def select(spark, rows, size, **options):
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], SCHEMA)
    return sorted(r.case_id for r in S.select(df, "case_id", ("cycle", "message_type"), "sales_id", "latest_message", size, **options).collect())


def unit_by_unit(network, size):
    """The least cost by an independent way: unit arcs, one shortest path of the residual network for each unit."""
    arcs = []
    for i in range(0, len(network.tails), 2):
        arcs += [[network.tails[i], network.heads[i], network.costs[i], False] for _ in range(network.rooms[i])]
    total, placed = 0, 0
    while placed < size:
        dist, back = {network.source: 0}, {}
        changed = True
        while changed:
            changed = False
            for n, (a, b, c, used) in enumerate(arcs):
                for x, y, w in ((b, a, -c),) if used else ((a, b, c),):
                    if x in dist and dist[x] + w < dist.get(y, 10**15):
                        dist[y], back[y], changed = dist[x] + w, (x, n), True
        if network.sink not in dist:
            break
        total, placed, v = total + dist[network.sink], placed + 1, network.sink
        while v != network.source:
            v, n = back[v]
            arcs[n][3] = not arcs[n][3]
    return placed, total


def random_network(rng):
    cells = {((a, x), b): rng.randint(0, 6) for a in "pqrstu"[: rng.randint(1, 6)] for x in "xy"[: rng.randint(1, 2)] for b in "123456"[: rng.randint(1, 6)]}
    return cells, rng.randint(1, 12), rng.random() < 0.5


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(500):
        cells, size, cover = random_network(rng)
        network, arcs = S.build(cells, size, cover=cover)
        units, placed, cost = network.solve(size)
        assert (placed, cost) == unit_by_unit(network, size)
        assert placed == min(size, sum(cells.values())) == sum(units[i] for i in arcs.values())
        assert all(0 <= units[i] <= cells[k] for k, i in arcs.items())


def test_flow_of_many_units_takes_few_rounds():
    rng = random.Random(4)
    cells = {((f"a{i % 7}", f"t{i % 3}"), f"d{i % 50}"): rng.randint(1, 40_000) for i in range(1000)}
    quotas = S.quotas(cells, 1_000_000)
    assert sum(quotas.values()) == 1_000_000
    assert all(n <= cells[k] for k, n in quotas.items())


def test_each_category_has_a_target():
    cells = {((c, t, x), d): n for c, n in (("a", 1000), ("b", 50)) for t in "tv" for x in ("single", "common9") for d in "1234"}
    units = S.quotas(cells, 160)
    for place, least in ((0, 80), (1, 80), (2, 80)):
        by = {}
        for (path, _), n in units.items():
            by[path[place]] = by.get(path[place], 0) + n
        assert min(by.values()) == least
    by = {}
    for (_, d), n in units.items():
        by[d] = by.get(d, 0) + n
    assert set(by.values()) == {40}


def test_covers_variety_and_holds_common_messages_back(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), "text" if rng.random() < 0.9 else "image", f"s{rng.randint(0, 5)}", "好的" if rng.random() < 0.4 else f"m{i}") for i in range(900)]
    rows += [(900, "rare", "text", "s1", "m900"), (901, "a", "voice", "s1", "m901")]
    chosen = select(spark, rows, 60)
    assert len(chosen) == len(set(chosen)) == 60
    by = {r[0]: r for r in rows}
    assert {900, 901} <= set(chosen)
    assert sum(by[i][4] == "好的" for i in chosen) <= 6
    assert chosen == select(spark, rows[::-1], 60)


def test_edges(spark):
    assert select(spark, [], 5) == []
    rows = [(1, None, None, None, None), (2, None, None, None, None), (3, "a", "t", "s", "x" * 50_000), (3, "a", "t", "s", "x" * 50_000)]
    assert select(spark, rows, 0) == []
    assert select(spark, rows, 10) == [1, 2, 3, 3]
    assert len(select(spark, rows, 2)) == 2


def test_copies_are_exact(spark):
    rows = [(i, i % 3) for i in range(5)] + [(10 + i, 7) for i in range(40)]
    slim = spark.createDataFrame(rows, "id long, text long")
    for hot_texts in (1, 4, 2000):
        assert {(r.text, r.copies) for r in S.with_copies(slim, hot_texts).collect()} == {(0, 2), (1, 2), (2, 1), (7, 40)}
        assert S.with_copies(slim, hot_texts).count() == 45


def test_every_rare_value_is_covered(spark):
    # 20 desks with half of the rows, 200 with one to three: 300 picks can hold them all.
    rows = [(i, "a" if i % 3 else "b", "text", f"s{i % 20}", f"m{i}") for i in range(400)]
    rows += [(1000 + i, "a", "text", f"rare{i % 200}", "好的" if i % 200 < 40 else f"r{i}") for i in range(400)]
    chosen = set(select(spark, rows, 300))
    assert len(chosen) == 300
    assert len({r[3] for r in rows if r[0] in chosen}) == 220


def test_groups_go_round_their_values(spark):
    rows = [(i, "a", "t", f"s{i % 30}" if i < 60 else "s0", f"m{i}") for i in range(600)]
    chosen = set(select(spark, rows, 60, max_values=1, max_combinations=2))
    assert len({r[3] for r in rows if r[0] in chosen}) == 30


def test_too_many_combinations_use_fewer_nodes(spark):
    rows = [(i, "a", "t", f"s{i}", f"m{i}") for i in range(200)]
    assert len(select(spark, rows, 50, max_combinations=120)) == 50
