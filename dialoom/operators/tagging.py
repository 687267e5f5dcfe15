"""Tagging conversations with a path of the script tree: regular, strongly validated, fallback and merged matches.

All of them choose among the same candidates: every sales message with a hit on a path of two levels or more, and for
each level of that path the best message up to it (its chain). Chains come from running maxima over the hits of one
conversation and one path, so no message is compared with another. ``messages``: conv_id, pos, text of sales messages;
``by_path``: text, path, depth, similarity, script_id (``scripts.best_per_path``); ``scripts``: the small script table.

Null texts match nothing; repeated messages are told apart by their position; ties go to the first path of the tree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.functions import text as T
from dialoom.operators.scripts import monotone_chain, small

# Thresholds of the strong validation, and of second follow-ups, which go first; their mark.
STRONG, STRONG_FOLLOW_UP = 0.95, 0.85
FOLLOW_UP = "二次跟进"
# Least similarity for a message that moves to a predicted level, and for one that fills a gap.
MOVED, FILLED = 0.6, 0.55


def until_last_customer(messages: DataFrame, is_sales: Column, is_customer: Column) -> DataFrame:
    """(conv_id, pos, text) of the sales messages before the last customer message; conversations without one drop out."""
    last = messages.filter(is_customer).groupBy("conv_id").agg(F.max("pos").alias("last"))
    return messages.filter(is_sales).join(last, "conv_id").filter("pos <= last").select("conv_id", "pos", "text")


def path_table(scripts: DataFrame) -> DataFrame:
    """(path_id, path, depth, node_order) of the paths that hold scripts; small."""
    order = scripts.groupBy("path").agg(F.min("node_order").alias("node_order"))
    return order.select(F.xxhash64(F.array_join("path", "\1")).alias("path_id"), "path", F.size("path").alias("depth"), "node_order")


def hits(messages: DataFrame, by_path: DataFrame) -> DataFrame:
    """(conv_id, pos, path_id, depth, similarity, script_id) of every message."""
    found = by_path.select("text", F.xxhash64(F.array_join("path", "\1")).alias("path_id"), F.size("path").alias("depth"), "similarity", "script_id")
    return messages.join(found, "text").select("conv_id", "pos", "path_id", "depth", "similarity", "script_id")


def candidates(found: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per message and path of two levels or more that it hits: the chain up to that message, with its scores.

    (conv_id, pos, path_id, covered, share, weakest, strongest, total, last_pos, second_pos, second_similarity, links).
    """
    prefix = F.explode(F.transform(F.sequence(F.lit(2), F.col("depth")), lambda n: F.struct(n.alias("level"), F.xxhash64(F.array_join(F.slice("path", F.lit(1), n), "\1")).alias("prefix_id"))))
    levels = paths.filter("depth >= 2").select("path_id", prefix.alias("l")).select("path_id", "l.level", "l.prefix_id")
    levels = levels.join(small(paths.select(F.col("path_id").alias("prefix_id"))), "prefix_id")
    nothing = F.lit(None)
    told = found.select("conv_id", F.col("path_id").alias("prefix_id"), "pos", F.lit(0).alias("asks"), F.struct("similarity", "pos", "script_id").alias("hit"), nothing.cast("bigint").alias("path_id"), nothing.cast("int").alias("level"))
    asked = found.filter("depth >= 2").join(small(levels), "path_id").select("conv_id", "prefix_id", "pos", F.lit(1).alias("asks"), F.lit(None).cast(told.schema["hit"].dataType).alias("hit"), "path_id", "level")
    upto = Window.partitionBy("conv_id", "prefix_id").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = told.unionByName(asked).withColumn("best", F.max("hit").over(upto)).filter("asks = 1 and best is not null")
    link = F.struct("level", F.col("best.pos").alias("pos"), F.col("best.similarity").alias("similarity"), F.col("best.script_id").alias("script_id"))
    second = lambda c: F.max(F.when(F.col("level") == 2, F.col(f"best.{c}")))
    scored = best.groupBy("conv_id", "pos", "path_id").agg(
        F.count(F.lit(1)).cast("int").alias("covered"), F.min("best.similarity").alias("weakest"), F.max("best.similarity").alias("strongest"), F.round(F.sum("best.similarity"), 6).alias("total"),
        F.max("best.pos").alias("last_pos"), second("pos").alias("second_pos"), second("similarity").alias("second_similarity"), F.sort_array(F.collect_list(link)).alias("links"),
    )
    joined = scored.join(small(paths), "path_id")
    return joined.withColumn("share", F.col("covered") / (F.col("depth") - 1))


CHOSEN = ("path", "covered", "weakest", "strongest", "pos", "second_pos", "second_similarity", "links")


def _best(rows: DataFrame, *rank: Column) -> DataFrame:
    parts = [c.alias(f"r{i}") for i, c in enumerate((*rank, -F.col("node_order")))]
    return rows.groupBy("conv_id").agg(F.max_by(F.struct(*CHOSEN), F.struct(*parts)).alias("m")).select("conv_id", "m.*")


def regular(chosen: DataFrame) -> DataFrame:
    """The path of the newest message that has one: widest coverage, then weakest and strongest link, then the shorter."""
    c = F.col
    return _best(chosen, c("pos"), c("share"), c("covered"), c("weakest"), c("strongest"), -c("depth"))


def strong(chosen: DataFrame, threshold: float = STRONG, follow_up_threshold: float = STRONG_FOLLOW_UP) -> DataFrame:
    """The best path whose second level is matched strongly enough; second follow-ups that are go before all others."""
    c = F.col
    follow_up = c("path")[1].contains(FOLLOW_UP)
    enough = c("second_similarity") >= F.when(follow_up, follow_up_threshold).otherwise(threshold)
    return _best(chosen.filter(enough), follow_up, c("share"), c("covered"), c("second_pos"), c("weakest"), c("second_similarity"), c("strongest"), -c("depth"), c("pos"))


def fallback(found: DataFrame, chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """The best path over all messages: chains with the last matched message first, then coverage, weakest link, latest
    link, the shorter path, and the sum of similarities. Where only single levels are hit, the best of them."""
    c = F.col
    last = found.groupBy("conv_id").agg(F.max("pos").alias("last_hit"))
    deep = chosen.join(last, "conv_id")
    with_last = F.exists("links", lambda x: x["pos"] == F.col("last_hit"))
    best = _best(deep, with_last, c("covered"), c("weakest"), c("last_pos"), -c("depth"), c("total"), -c("pos"))
    lone = found.join(best.select("conv_id"), "conv_id", "left_anti").join(small(paths), ["path_id", "depth"])
    link = F.struct(c("depth").alias("level"), "pos", "similarity", "script_id")
    shown = lone.select("conv_id", "node_order", "similarity", "path", F.lit(1).alias("covered"), c("similarity").alias("weakest"), c("similarity").alias("strongest"), "pos",
                        F.lit(None).cast("int").alias("second_pos"), F.lit(None).cast("double").alias("second_similarity"), F.array(link).alias("links"))
    return best.unionByName(_best(shown, c("similarity"), -c("pos")).select(*best.columns))


def base_match(found: DataFrame, chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """The regular match, or the fallback where there is none; ``method`` says which."""
    first = regular(chosen).withColumn("method", F.lit("regular"))
    rest = fallback(found, chosen, paths).join(first.select("conv_id"), "conv_id", "left_anti").withColumn("method", F.lit("fallback"))
    return first.unionByName(rest)


def all_level_best(matches: DataFrame, scripts: DataFrame, threshold: float) -> DataFrame:
    """For each text its best script (similarity, then depth, then reference before similar scripts) and, for each level
    of that script's path, the best script there: (text, path, level, script_id, similarity). ``matches`` reach any score."""
    info = scripts.select("script_id", "path", F.size("path").alias("depth"), "node_order", "script_type", "script_pos")
    joined = matches.filter(F.col("similarity") >= threshold).join(small(info), "script_id")
    order = F.struct(-F.col("similarity"), -F.col("depth"), F.when(F.col("script_type") == "参考话术", 0).otherwise(1), "node_order", "script_pos", "script_id")
    top = joined.groupBy("text").agg(F.min_by("path", order).alias("best"))
    levels = joined.join(top, "text").filter(F.slice("best", F.lit(1), F.col("depth")) == F.col("path"))
    at = levels.groupBy("text", "best", "depth").agg(F.min_by(F.struct("script_id", "similarity"), order).alias("m"))
    return at.select("text", F.col("best").alias("path"), F.col("depth").alias("level"), "m.script_id", "m.similarity")


def best_candidate(matches: DataFrame) -> DataFrame:
    """The script nearest to each text whatever its score: (text, script_id, similarity)."""
    return matches.groupBy("text").agg(F.max_by(F.struct("script_id", "similarity"), F.struct("similarity", -F.col("script_id"))).alias("m")).select("text", "m.*")


def targeted_then_nearest(messages: DataFrame, matches: DataFrame, scripts: DataFrame, labels: DataFrame) -> DataFrame:
    """The latest message that matches a script of the conversation's own node, else of any node.

    ``labels``: conv_id, sop_l1, sop_l2. (conv_id, pos, script_id, similarity, targeted).
    """
    info = scripts.select("script_id", F.col("path")[0].alias("n1"), F.col("path")[1].alias("n2"))
    rows = messages.join(matches, "text").join(small(info), "script_id").join(labels.select("conv_id", "sop_l1", "sop_l2"), "conv_id", "left")
    own = F.coalesce((F.col("n1") == F.col("sop_l1")) & (F.col("n2") == F.col("sop_l2")), F.lit(False))
    rank = F.struct(own.alias("own"), "pos", "similarity", (-F.col("script_id")).alias("s"))
    return rows.groupBy("conv_id").agg(F.max_by(F.struct("pos", "script_id", "similarity", own.alias("targeted")), rank).alias("m")).select("conv_id", "m.*")


LINK = "struct<level:int,pos:int,similarity:double,script_id:bigint>"


def carry_on(path: list | None, links: list | None, v_path: list | None, v_links: list | None, predicted: list | None, offers: list | None) -> tuple[list, str, list]:
    """(path, tail, levels) of one conversation: see ``merged``. Links and offers are rows of level, pos, similarity, script_id."""
    if v_path is None:
        return path, "", links
    depth, path, links = len(v_path), list(path or []), list(links or [])
    levels = {x["level"]: x for x in v_links}
    tail_at = max(x["pos"] for x in v_links)
    last = max((x["level"] for x in links), default=None)
    if last is None or (last >= depth and path[:depth] == list(v_path)):
        levels |= {x["level"]: x for x in links if x["level"] > depth}
        return path[: max(levels)] if max(levels) > depth else list(v_path), "", [levels[k] for k in sorted(levels)]
    open_levels = set(range(depth + 1, len(predicted or []) + 1))
    at: dict[tuple[int, int], object] = {(x["pos"], x["level"]): x for x in offers or [] if x["level"] in open_levels}
    used, found = {x["pos"] for x in [*links, *v_links]}, False
    for x in sorted(links, key=lambda x: x["level"]):
        own = [at[x["pos"], k] for k in sorted(open_levels) if (x["pos"], k) in at] if x["level"] > depth and x["pos"] > tail_at else []
        best = max(own, key=lambda o: o["similarity"], default=None)
        if best is not None and best["similarity"] >= MOVED:
            levels[best["level"]], found = best, True
            open_levels.discard(best["level"])
    for k in sorted(open_levels):
        rest = [o for (pos, level), o in sorted(at.items()) if level == k and pos not in used]
        best = max(rest, key=lambda o: o["similarity"], default=None)
        if best is not None and best["similarity"] >= FILLED:
            levels[k], found = best, True
            used.add(best["pos"])
    return list(predicted[: max(levels)]) if max(levels) > depth else list(v_path), "成功" if found else "失败", [levels[k] for k in sorted(levels)]


# Why a stored node is not confirmed.
NO_LABEL, NO_HISTORY, NO_SALES, NO_SCRIPTS, NO_MATCH = "缺少SOP节点标签", "缺少历史对话", "历史对话中没有销售侧消息", "SOP节点未找到参考话术", "未找到满足阈值的匹配"


def verify(conversations: DataFrame, sales: DataFrame, matches: DataFrame, scripts: DataFrame) -> DataFrame:
    """Whether a reply of each conversation matches a script of its stored node, the latest such reply, or why not.

    ``conversations``: conv_id, final_context, sop_l1, sop_l2; ``sales``: conv_id, pos, ts, text. Labels are looked up as
    they stand, else by their match keys. (conv_id, match_status, match_hit, match_reason, latest_sales_message,
    latest_sales_time, pos, script_id, similarity, turn_from_last).
    """
    nodes = scripts.filter(F.size("path") > 1).select("script_id", F.col("path")[0].alias("n1"), F.col("path")[1].alias("n2"))
    keyed = nodes.select("*", T.match_key(F.col("n1")).alias("k1"), T.match_key(F.col("n2")).alias("k2"))
    stored = conversations.select("conv_id", "final_context", "sop_l1", "sop_l2")
    labels = stored.select("sop_l1", "sop_l2").distinct().select("*", T.match_key(F.col("sop_l1")).alias("k1"), T.match_key(F.col("sop_l2")).alias("k2"))
    refs = labels.join(small(keyed), ["k1", "k2"]).withColumn("exact", (F.col("n1") == F.col("sop_l1")) & (F.col("n2") == F.col("sop_l2")))
    own = refs.groupBy("sop_l1", "sop_l2").agg(F.collect_set(F.struct("exact", "script_id")).alias("refs"))  # a node's scripts
    own = own.select("sop_l1", "sop_l2", F.when(F.exists("refs", lambda r: r["exact"]), F.filter("refs", lambda r: r["exact"])).otherwise(F.col("refs")).alias("refs"))
    known = stored.join(own, ["sop_l1", "sop_l2"], "left")
    hit = sales.join(matches, "text").join(known.select("conv_id", F.explode("refs.script_id").alias("script_id")), ["conv_id", "script_id"])
    found = hit.groupBy("conv_id").agg(F.max_by(F.struct("pos", "script_id", "similarity"), F.struct("pos", "similarity", -F.col("script_id"))).alias("m"))
    said = sales.groupBy("conv_id").agg(F.max_by(F.struct("text", "ts"), "pos").alias("last"), F.sort_array(F.collect_list("pos")).alias("places"))
    rows = known.join(said, "conv_id", "left").join(found, "conv_id", "left")
    reason = (
        F.when(F.col("sop_l1").isNull() | F.col("sop_l2").isNull(), NO_LABEL).when(F.trim(F.coalesce("final_context", F.lit(""))) == "", NO_HISTORY).when(F.col("last").isNull(), NO_SALES)
        .when(F.col("refs").isNull(), NO_SCRIPTS).when(F.col("m").isNull(), NO_MATCH).otherwise("")
    )
    status = reason == ""
    turn = F.when(status, F.size(F.filter("places", lambda x: x >= F.col("m.pos"))))
    return rows.select(
        "conv_id", status.alias("match_status"), F.when(status, "是").otherwise("否").alias("match_hit"), reason.alias("match_reason"), F.coalesce("last.text", F.lit("")).alias("latest_sales_message"),
        F.coalesce("last.ts", F.lit("")).alias("latest_sales_time"), "m.pos", "m.script_id", "m.similarity", turn.alias("turn_from_last"),
    )


def merged(base: DataFrame, validated: DataFrame, messages: DataFrame, matches: DataFrame, scripts: DataFrame, predicted: DataFrame) -> DataFrame:
    """The strongly validated path, carried on: (conv_id, path, method, tail, levels).

    Without a validated path the base stands. With one, its levels replace the base's; deeper levels of the base stay
    where they lie on the validated path. If the base ends in another branch, later messages are looked for on the
    path that the tree predicts (``predicted``: path, predicted): first those of the base's own deeper levels, each for
    the predicted level it is nearest to (at least ``MOVED``), then any other message for the levels left (``FILLED``),
    each message once. ``tail`` tells whether that found any. ``matches`` reach down to ``FILLED``. One conversation has
    a handful of levels, so the choice runs over arrays of one row.
    """
    spots = scripts.select("script_id", F.col("path"))
    extend = validated.select("conv_id", F.col("path").alias("v_path"), F.col("links").alias("v_links")).join(small(predicted.select(F.col("path").alias("v_path"), "predicted")), "v_path", "left")
    tail_at = F.array_max(F.transform("v_links", lambda x: x["pos"]))
    ahead = extend.filter(F.size("predicted") > F.size("v_path")).select("conv_id", "v_path", "predicted", tail_at.alias("tail_at"))
    near = messages.join(matches, "text").join(small(spots), "script_id").join(ahead, "conv_id").filter("pos > tail_at")
    near = near.filter((F.size("path") > F.size("v_path")) & (F.slice("predicted", F.lit(1), F.size("path")) == F.col("path")))
    per = near.groupBy("conv_id", "pos", F.size("path").alias("level")).agg(F.max_by(F.struct("similarity", "script_id"), F.struct("similarity", -F.col("script_id"))).alias("b"))
    offers = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "b.similarity", "b.script_id"))).alias("offers"))
    rows = base.select("conv_id", "path", "links", "method").join(extend, "conv_id", "full").join(offers, "conv_id", "left")
    plan = F.udf(carry_on, f"struct<path:array<string>,tail:string,levels:array<{LINK}>>", useArrow=True)
    method = F.when(F.col("v_path").isNull(), F.col("method")).otherwise("strong")
    return rows.select("conv_id", method.alias("method"), plan("path", "links", "v_path", "v_links", "predicted", "offers").alias("m")).select("conv_id", "m.path", "method", "m.tail", "m.levels")


#: Sentences of a message that a spot has room for.
SPOT = 1 << 20


def sentence_hits(sentences: DataFrame, by_path: DataFrame) -> DataFrame:
    """(conv_id, spot, path, depth, similarity) of the sentences (conv_id, pos, place, text); a spot orders sentences."""
    spot = (F.col("pos").cast("long") * SPOT + F.col("place")).alias("spot")
    return sentences.join(by_path, "text").filter("depth >= 2").select("conv_id", spot, "path", "depth", "similarity")


def sentencewise(found: DataFrame, branches: DataFrame) -> DataFrame:
    """One path for each conversation by its sentences' chains, whose levels occur in order: (conv_id, path, links).

    Paths of two levels come first: the one whose deepest message is the latest, then by coverage, its share, weakest
    and average link, length, and the later first message. It is carried on to a longer path that is hit at every level,
    chosen by the same rank. Where no path of two levels is hit, the longer ones compete. ``branches``: path.
    """
    levels = branches.select("path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("level")).withColumn("prefix", F.expr("slice(path, 1, level)"))
    rows = found.select("conv_id", F.col("path").alias("prefix"), F.col("spot").alias("pos"), "similarity").join(small(levels), "prefix").drop("prefix")
    chains = monotone_chain(rows).groupBy("conv_id", "path").agg(F.sort_array(F.collect_list(F.struct("level", F.col("pos").alias("spot"), "similarity"))).alias("links"))
    message = lambda x: F.floor(x["spot"] / SPOT)
    scores = F.transform("links", lambda x: x["similarity"])
    covered, depth = F.size("links"), F.size("path")
    average = F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / covered, 6)
    rank = [
        F.array_max(F.transform("links", message)), covered, covered / (depth - 1), F.array_min(scores), average, depth, -F.array_min(F.transform("links", message)), F.array_join("path", "\1"),
    ]
    ranked = chains.withColumn("rank", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])).withColumn("whole", F.struct("path", "links"))
    best = lambda rows: rows.groupBy("conv_id").agg(F.max_by("whole", "rank").alias("m"))
    second = best(ranked.filter(depth == 2))
    other = best(ranked.filter(depth > 2).join(second.select("conv_id"), "conv_id", "left_anti"))
    longer = ranked.filter((depth > 2) & (covered == depth - 1)).join(second.select("conv_id", F.col("m.path").alias("head")), "conv_id").filter(F.slice("path", 1, 2) == F.col("head"))
    carried = best(longer).withColumnRenamed("m", "further")
    first = second.join(carried, "conv_id", "left").select("conv_id", F.coalesce("further", "m").alias("m"))
    return first.unionByName(other).select("conv_id", "m.path", "m.links")


def extend_branch(chosen: DataFrame, found: DataFrame, most_levels: int) -> DataFrame:
    """``sentencewise`` paths carried on, child by child, by sentences strictly after the last link: of the children hit
    there the best sentence counts, then the earliest, then the last name. At most ``most_levels`` levels are there."""
    hits = found.select("conv_id", F.col("spot").alias("at"), F.col("path").alias("to"), "depth", F.col("similarity").alias("score"))
    for _ in range(most_levels - 2):
        step = chosen.withColumn("last", F.element_at("links", -1)["spot"]).join(hits, "conv_id")
        step = step.filter((F.col("at") > F.col("last")) & (F.col("depth") == F.size("path") + 1) & (F.slice("to", F.lit(1), F.size("path")) == F.col("path")))
        rank = F.struct("score", -F.col("at"), F.element_at("to", -1))
        link = F.struct(F.col("depth").alias("level"), F.col("at").alias("spot"), F.col("score").alias("similarity"))
        best = step.groupBy("conv_id").agg(F.max_by(F.struct("to", link.alias("link")), rank).alias("n"))
        chosen = chosen.join(best, "conv_id", "left").select(
            "conv_id", F.coalesce("n.to", "path").alias("path"), F.when(F.col("n").isNotNull(), F.concat("links", F.array("n.link"))).otherwise(F.col("links")).alias("links")
        )
    return chosen


def node_table(tree: dict, meta: tuple[str, ...], children_of: str = "children") -> list[dict]:
    """Rows (path, next_action, expected, info, children) of a nested tree: what each node tells to do, to say (label to
    text; plain texts under the empty label, of a list the first) and to find out, and its children in order."""
    out, stack = [], [((k,), v) for k, v in reversed(list(tree.items())) if k not in meta and isinstance(v, dict)]
    action, said, info = "下一步动作", "预期话术", "关键信息"
    while stack:
        path, node = stack.pop()
        below = [(k, v) for k, v in node.items() if isinstance(v, dict) and k not in meta]
        words = node.get(said)
        expected = {str(k): v for k, v in words.items() if isinstance(v, str)} if isinstance(words, dict) else {"": x for x in (words[:1] if isinstance(words, list) else [words]) if isinstance(x, str)}
        value = node.get(info)
        notes = [str(x) for x in value if x not in (None, "")] if isinstance(value, list) else [json.dumps(value, ensure_ascii=False)] if isinstance(value, dict) and value else [str(value)] if value not in (None, "", {}) else []
        out.append({"path": list(path), "next_action": str(node.get(action) or ""), "expected": expected, "info": notes, children_of: [k for k, _ in below]})
        stack += [((*path, k), v) for k, v in reversed(below)]
    return out


NODES = "path array<string>, next_action string, expected map<string,string>, info array<string>, children array<string>"
#: Nodes of so many levels or fewer list all children's notes; deeper ones only the next node's.
LISTED_LEVELS = 3
ANSWER = "客户回复"


def expected_fields(chosen: DataFrame, nodes: DataFrame, items: DataFrame) -> DataFrame:
    """What to say, do and find out at each conversation's node: (conv_id, next_action, utterances, notes).

    ``chosen``: conv_id, path, predicted (may be null), text (the last customer message); ``nodes``: NODES, small;
    ``items``: text, items (``scripts.resolve_aliases``). ``utterances`` are those under the items' labels, with or
    without the mark of an answer before them; all of the node's where none fits. ``notes`` (child to notes) are of all
    children, or, below LISTED_LEVELS, of the next node: the predicted one, the one that the next action names, or the
    only one.
    """
    here = small(nodes)
    notes = small(nodes.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("child"), "info").filter("size(path) > 0 and size(info) > 0")
                  .groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("child", "info")))).alias("all_notes")))
    rows = chosen.join(here, "path").join(notes, "path", "left").join(items.withColumnRenamed("items", "__items"), "text", "left")
    depth = F.size("path")
    ahead = F.when(F.size("predicted") > depth, F.try_element_at("predicted", depth + 1))
    named = F.try_element_at(F.filter("children", lambda c: F.col("next_action") == c), F.lit(1))
    within = F.try_element_at(F.filter("children", lambda c: F.col("next_action").contains(c)), F.lit(1))
    lone = F.when(F.size("children") == 1, F.col("children")[0])
    following = F.coalesce(F.when(F.array_contains("children", ahead), ahead), named, within, lone)
    none = F.create_map().cast("map<string,array<string>>")
    told = F.coalesce("all_notes", none)
    told = F.when(depth <= LISTED_LEVELS, told).otherwise(F.map_filter(told, lambda k, _: F.coalesce(k == following, F.lit(False))))
    fits = F.map_filter("expected", lambda k, _: F.arrays_overlap(F.coalesce("__items", F.array().cast("array<string>")), F.array(k, F.regexp_replace(k, f"^{ANSWER}", ""))))
    return rows.select("conv_id", "next_action", F.when(F.size(fits) > 0, fits).otherwise(F.col("expected")).alias("utterances"), told.alias("notes"))
