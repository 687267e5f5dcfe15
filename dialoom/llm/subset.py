"""Choosing a varied subset of a given size (problem 4).

Method: minimum-cost flow quotas. Records are counted by category combination. Every unit flows from the source
through a node of its first category, one of its first two, one of these and its text's class, over an arc that stands
for the combination, and through a node of its third category (the desk) to the sink. So each of the four categories
has nodes with a balanced target: equal shares of the node before it, as far as its holdings allow. A unit above a
target costs more the more the node is already over it (convex), and so do repeated units of one combination; a desk
that has no unit yet comes before any second unit of another. ``flow.Flow`` finds the exact minimum; its flow is each
combination's quota, filled by a deterministic rank: the first copies of each text before any second one, texts of few
copies first, then by hash and id.

Every value has a node of its own as long as at most ``max_combinations`` combinations occur. Beyond that the most
frequent ``max_values`` values of a category (four times the size asked for, unless given) keep theirs and the others
are shared out to as many hashed groups, within which a combination's quota goes round the real values; with more
nodes than units no value needs a second unit. ``max_values`` is halved until the combinations fit, down to
``LEAST_VALUES``; what still exceeds them then is an error. Texts enter as classes of their exact number of copies
(by powers of two), so the few very common messages form classes of their own.

Behaviour at the edges
----------------------
* null categories are a value of their own; a null or blank text is a text like any other (one group of copies);
* fewer records than asked for: all of them; an empty table or a size of 0: no rows;
* repeated ids count as separate records; ties are broken by hash, then id; texts of any length are compared whole;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.llm.flow import Flow, pieces
from dialoom.session import ensure_checkpoint_dir

SALTS = 64
LEAST_VALUES = 24
#: Cost of a unit above a node's target, of a second unit of a combination, and of a second unit of a desk while
#: another has none (above the cost of any overuse that matters).
OVER, AGAIN, COVER = 16, 1, 10**6
#: Between the parts of a combination's key.
PART = "\1"


def balanced(held: dict, size: int) -> dict:
    """As equal shares of ``size`` as the nodes' holdings allow (water level); what is left over goes to the largest."""
    out, left, names = {}, size, sorted(held, key=lambda k: (held[k], k))
    for i, k in enumerate(names):
        out[k] = min(int(held[k] + 1e-6), left // (len(names) - i))
        left -= out[k]
    return out


def quotas(
    combinations: dict[tuple[tuple[str, ...], str], int], size: int, variety: dict[tuple[tuple[str, ...], str], float] | None = None, cover: bool = True
) -> dict[tuple[tuple[str, ...], str], int]:
    """Units of each combination ((first, second, ...), other) at the least cost, ``size`` in all if there are as many.

    ``combinations``: records of each; ``variety``: different texts of each, where targets count these instead.
    """
    network, arcs = build(combinations, size, variety, cover)
    units, _, _ = network.solve(size)
    return {k: units[i] for k, i in arcs.items() if units[i]}


def build(combinations: dict, size: int, variety: dict | None = None, cover: bool = True) -> tuple[Flow, dict]:
    """The network of ``quotas`` and the number of each combination's arc."""
    combinations = {k: n for k, n in sorted(combinations.items()) if n > 0}
    variety = variety or combinations
    rooms: dict[tuple, int] = {}
    held: dict[tuple, float] = {}
    for (path, other), n in combinations.items():
        for node in [("in", *path[:i]) for i in range(1, len(path) + 1)] + [("out", other)]:
            rooms[node] = rooms.get(node, 0) + n
            held[node] = held.get(node, 0.0) + variety[path, other]
    classes = {("in", *path) for path, _ in combinations}
    children: dict[tuple, dict[tuple, float]] = {}
    for node, h in held.items():
        # A value that occurs may have a unit, however small the variety that it shares with others; a class of texts
        # may not: what it holds of a common text is that text's share.
        children.setdefault(node[:-1], {})[node] = h if node in classes else max(1.0, h)
    targets: dict[tuple, int] = {}
    for parent in sorted(children, key=len):
        targets |= balanced(children[parent], targets.get(parent, size))
    number = {node: i + 2 for i, node in enumerate(sorted(held, key=str))}
    network = Flow(len(number) + 2, 0, 1)
    for node, i in number.items():
        if node[0] == "in":
            network.add(number.get(node[:-1], 0), i, pieces(targets[node], min(rooms[node], size), OVER))
        else:
            network.add(i, 1, pieces(targets[node], min(rooms[node], size), OVER, COVER if cover else 0))
    return network, {(p, o): network.add(number["in", *p], number["out", o], pieces(1, min(n, size), AGAIN)) for (p, o), n in combinations.items()}


def bounded(df: DataFrame, col: str, max_values: int) -> tuple[Column, bool]:
    """The column, and whether it had more values than ``max_values``: then all but the most frequent ones are in hashed groups."""
    text = F.col(col)
    top = [r.v for r in df.groupBy(text.alias("v")).count().orderBy(F.desc("count"), "v").limit(max_values + 1).collect()]
    if len(top) <= max_values:
        return text, False
    return F.when(text.isin(top[:max_values]), text).otherwise(F.concat(F.lit("\0group"), F.pmod(F.xxhash64(text), F.lit(max_values)).cast("string"))), True


def with_copies(slim: DataFrame, hot_texts: int = 2000) -> DataFrame:
    """Add ``copies``, the number of rows with the same ``text``. Texts with more than a 1 / hot_texts share of the rows
    (so fewer than ``hot_texts``) are joined by broadcast, all others by shuffle: the counts are exact either way."""
    counts = slim.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    limit = slim.count() // hot_texts
    hot = F.broadcast(counts.filter(F.col("copies") > limit).select("text", F.col("copies").alias("hot")))
    marked = slim.join(hot, "text", "left")
    rest = marked.filter("hot is null").drop("hot").join(counts.filter(F.col("copies") <= limit), "text")
    return marked.filter("hot is not null").withColumnRenamed("hot", "copies").unionByName(rest)


def select(
    df: DataFrame, id_col: str, first: tuple[str, str], other: str, text_col: str, size: int, max_values: int | None = None, max_combinations: int = 400_000
) -> DataFrame:
    """The ids of a subset of ``size`` rows: ``first`` are two categories, ``other`` and the text's class the next two."""
    ensure_checkpoint_dir(df.sparkSession)
    max_values = max(LEAST_VALUES, 4 * size) if max_values is None else max_values
    slim = df.select(
        F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"c{i}") for i, c in enumerate((*first, other))],
        F.xxhash64(F.trim(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("text"),
    ).checkpoint()
    classed = with_copies(slim).withColumn("c3", F.when(F.col("copies") == 1, "single").otherwise(F.concat(F.lit("common"), F.ceil(F.log2("copies")).cast("string")))).checkpoint()

    def count(keys: tuple[Column, ...]) -> tuple[DataFrame, list]:
        value = F.xxhash64("c0", "c1", "c2")
        marked = classed.select("id", "text", "copies", F.concat_ws(PART, keys[0], keys[1], F.col("c3")).alias("a"), keys[2].alias("b"), value.alias("value"))
        counted = marked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"), F.sum(1 / F.col("copies")).alias("variety"))
        return marked, counted.limit(max_combinations + 1).collect()

    grouped = [False]
    marked, rows = count((F.col("c0"), F.col("c1"), F.col("c2")))
    while len(rows) > max_combinations:
        keys, grouped = zip(*[bounded(slim, f"c{i}", max_values) for i in range(3)], strict=True)
        marked, rows = count(keys)
        if len(rows) > max_combinations and max_values <= LEAST_VALUES:
            raise ValueError("more combinations than max_combinations")
        max_values = max(LEAST_VALUES, max_values // 2)
    key = lambda r: (tuple(r.a.split(PART)), r.b)
    solved = quotas({key(r): r["count"] for r in rows}, size, {key(r): r.variety for r in rows})
    plan = df.sparkSession.createDataFrame([(PART.join(a), b, n) for (a, b), n in sorted(solved.items())], "a string, b string, quota int")
    # A first cut per salted share of a combination keeps any combination, however large, out of one task.
    candidates = marked.join(F.broadcast(plan), ["a", "b"]).withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)))
    turn = Window.partitionBy("a", "b", "salt", "text").orderBy(F.xxhash64("id"), "id")
    order = [F.col("turn"), F.col("copies"), F.xxhash64("text"), F.xxhash64("id"), F.col("id")]

    def cut(rows: DataFrame, *keys: str) -> DataFrame:
        if any(grouped):  # the real values of a hashed group take turns
            rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(*keys, "value").orderBy(*order)))
        first = [F.col("round")] if any(grouped) else []
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*first, *order))).filter("place <= quota")

    # Equal texts stay together so that their copies can be numbered; a common text is dealt over the salts.
    salted = candidates.withColumn("salt", F.when(F.col("copies") > 1, F.col("salt")).otherwise(F.pmod(F.xxhash64("text"), F.lit(SALTS))))
    first_cut = cut(salted.withColumn("turn", F.row_number().over(turn)), "a", "b", "salt")
    again = first_cut.withColumn("turn", F.row_number().over(Window.partitionBy("a", "b", "text").orderBy("turn", F.xxhash64("id"), "id")))
    return cut(again, "a", "b").select(F.col("id").alias(id_col))
