"""Matching messages against a tree of scripts.

Distinct message texts are scored once. Candidates come from an equi-join on character bigrams, never from a cross
product; the script side is a small fixed table (its size is checked before it is broadcast), the message side of
any size. Bigram counts are the token vectors, so the cosine is a join and a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions.similarity import lexical_similarity, sequence_ratio, template_similarity

MAX_SCRIPTS = 20_000
# The lists of a tree node that hold scripts, and the names of its other data.
SCRIPT_LISTS = ("参考话术", "相似话术")
EXPECTED = "预期话术"
NODE_DATA = ("下一步动作", EXPECTED, "关键信息")
#: Labels whose utterance is an action as a whole.
ACTION_LABELS = ("提醒上课",)


def flatten_tree(tree: dict) -> Iterator[dict]:
    """Rows (path, depth, node_order, script_type, script_pos, script_text) of a nested tree, in document order."""
    order = 0
    stack = [((k,), v) for k, v in reversed(list(tree.items())) if k not in SCRIPT_LISTS + NODE_DATA]
    while stack:
        path, node = stack.pop()
        if not isinstance(node, dict):
            continue
        for kind in SCRIPT_LISTS:
            scripts = node.get(kind) or []
            for pos, script in enumerate([scripts] if isinstance(scripts, str) else scripts):
                if isinstance(script, str) and script.strip():
                    yield {"path": list(path), "depth": len(path), "node_order": order, "script_type": kind, "script_pos": pos, "script_text": script.strip()}
        order += 1
        stack += [((*path, k), v) for k, v in reversed(list(node.items())) if k not in SCRIPT_LISTS + NODE_DATA]


def expected_utterances(tree: object) -> Iterator[str]:
    """Every text below an ``EXPECTED`` list of a nested tree, in document order, repeats included."""
    stack = [(tree, False)]
    while stack:
        node, expected = stack.pop()
        if expected:
            values = [node] if isinstance(node, str) else node.values() if isinstance(node, dict) else node if isinstance(node, list) else []
            yield from (x for x in values if isinstance(x, str))
        elif isinstance(node, dict):
            stack += [(v, k == EXPECTED) for k, v in reversed(list(node.items()))]
        elif isinstance(node, list):
            stack += [(v, False) for v in reversed(node)]


def expected_parts(df: DataFrame, cell_col: str, lookup: DataFrame, action_labels: tuple[str, ...] = ACTION_LABELS) -> DataFrame:
    """Add ``statement`` and ``question`` of the expected utterance in a cell.

    ``lookup`` (utterance, statement, question) is a small table of utterances whose parts are settled: the tree's own
    ones, manual splits, utterances that are actions as a whole; for an utterance given twice the smallest parts
    count. A label of ``action_labels`` makes the whole text the action; any other utterance is split by rule. Other
    columns pass through, but for two of the names added.
    """
    known = lookup.groupBy("utterance").agg(F.min(F.struct("statement", "question")).alias("__known"))
    parsed = df.withColumn("__cell", T.expected_utterance(F.col(cell_col))).withColumn("utterance__", F.col("__cell.utterance"))
    joined = parsed.join(small(known.withColumnRenamed("utterance", "utterance__")), "utterance__", "left")
    whole = F.struct(F.lit("").alias("statement"), F.col("utterance__").alias("question"))
    parts = F.when(F.col("__cell.label").isin(*action_labels), whole).otherwise(F.coalesce("__known", T.split_utterance(F.col("utterance__"))))
    return joined.withColumn("__parts", parts).withColumns({"statement": F.col("__parts.statement"), "question": F.col("__parts.question")}).drop("__cell", "__known", "__parts", "utterance__")


def branch_paths(scripts: DataFrame) -> DataFrame:
    """Every path prefix of at least two levels, deepest first."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(2), F.size("path")), lambda n: F.slice("path", F.lit(1), n)))
    return scripts.filter(F.size("path") >= 2).select(prefixes.alias("path")).distinct().withColumn("depth", F.size("path")).orderBy(F.desc("depth"), F.array_join("path", ">"))


def small(df: DataFrame, limit: int = MAX_SCRIPTS) -> DataFrame:
    """The table marked for broadcast, if it has at most ``limit`` rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _distinct(messages: DataFrame) -> DataFrame:
    """(id, text) of the distinct texts; the id, a digest, stands for the text in every row that is shuffled."""
    return messages.select("text").distinct().select(F.unhex(F.md5("text")).alias("id"), "text")


def bigrams(c: Column) -> Column:
    """The default tokens: the character bigrams of a text's match key."""
    return T.char_ngrams(T.match_key(c), (2,))


def cosine_matches(messages: DataFrame, scripts: DataFrame, threshold: float, tokens: Callable[[Column], Column] = bigrams) -> DataFrame:
    """(text, script_id, similarity) of distinct texts and scripts whose token-count cosine reaches the threshold.

    ``tokens`` gives the array of a text's tokens: bigrams, ``text.words``, or any tokeniser in a UDF.
    """
    texts = _distinct(messages)
    count = lambda df, key, c: df.select(key, F.explode(tokens(c)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    length = lambda counted, key, out: counted.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(out))
    left, right = count(texts, "id", F.col("text")), count(scripts, "script_id", F.col("script_text"))
    right = right.join(small(length(right, "script_id", "s_norm")), "script_id").withColumnRenamed("tf", "s_tf")
    dots = left.join(small(right, 40 * MAX_SCRIPTS), "gram").groupBy("id", "script_id").agg(F.sum(F.col("tf") * F.col("s_tf")).alias("dot"), F.first("s_norm").alias("s_norm"))
    scored = dots.join(length(left, "id", "norm"), "id")
    found = scored.select("id", "script_id", F.round(F.col("dot") / (F.col("norm") * F.col("s_norm")), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    return found.join(texts, "id").select("text", "script_id", "similarity")


def tfidf_matches(messages: DataFrame, scripts: DataFrame, threshold: float) -> DataFrame:
    """Cosine of TF-IDF vectors of character 2- to 4-grams: idf = ln((1 + n) / (1 + df)) + 1 over the scripts, L2 norms.

    Grams that no script has don't count.
    """
    total = scripts.count()
    grams = scripts.select("script_id", F.explode(T.char_ngrams(F.lower("script_text"))).alias("gram")).groupBy("script_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    idf = grams.groupBy("gram").agg((F.log((1 + total) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weights = grams.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    weights = weights.join(weights.groupBy("script_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")), "script_id").select("script_id", "gram", (F.col("w") / F.col("n")).alias("sw"))
    texts = _distinct(messages)
    own = texts.select("id", F.explode(T.char_ngrams(F.lower("text"))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf")).join(small(idf, 200 * MAX_SCRIPTS), "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = own.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    dots = own.join(small(weights, 200 * MAX_SCRIPTS), "gram").groupBy("id", "script_id").agg(F.sum(F.col("w") * F.col("sw")).alias("dot"))
    found = dots.join(norms, "id").select("id", "script_id", F.round(F.col("dot") / F.col("n"), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    return found.join(texts, "id").select("text", "script_id", "similarity")


def lexical_matches(messages: DataFrame, scripts: DataFrame, threshold: float) -> DataFrame:
    """The composite lexical similarity of every text with the scripts that share a bigram with it."""
    pairs = _candidates(messages, scripts)
    return pairs.withColumn("similarity", F.round(lexical_similarity(T.match_key(F.col("text")), T.match_key(F.col("script_text"))), 6)).filter(F.col("similarity") >= threshold).select("text", "script_id", "similarity")


def composite_matches(messages: DataFrame, scripts: DataFrame, threshold: float) -> DataFrame:
    """The better of the lexical similarity and the TF-IDF cosine, where it reaches the threshold."""
    both = lexical_matches(messages, scripts, threshold).unionByName(tfidf_matches(messages, scripts, threshold))
    return both.groupBy("text", "script_id").agg(F.max("similarity").alias("similarity"))


def sequence_or_cosine(messages: DataFrame, scripts: DataFrame, threshold: float, sequence_threshold: float = 0.4) -> DataFrame:
    """The cosine where it reaches the threshold, else the sequence ratio where that reaches its own: the cheap
    measure first, the alignment only for what it leaves."""
    high = cosine_matches(messages, scripts, threshold)
    rest = _candidates(messages, scripts).join(high.select("text", "script_id"), ["text", "script_id"], "left_anti")
    scored = rest.withColumn("similarity", F.round(sequence_ratio(T.collapse(F.col("text")), T.collapse(F.col("script_text"))), 6))
    return high.unionByName(scored.filter(F.col("similarity") >= sequence_threshold).select("text", "script_id", "similarity"))


def _candidates(messages: DataFrame, scripts: DataFrame) -> DataFrame:
    """Pairs of distinct texts and scripts that share a character of their match keys: no measure here gives a pair
    without one anything but zero. Each script is found through its characters, so a text meets it at most once."""
    texts = _distinct(messages)
    chars = lambda c: F.explode(F.array_distinct(F.filter(F.split(T.match_key(c), ""), lambda x: x != "")))
    right = scripts.select("script_id", chars(F.col("script_text")).alias("char"))
    pairs = texts.select("id", chars(F.col("text")).alias("char")).join(small(right, 40 * MAX_SCRIPTS), "char").select("id", "script_id").distinct()
    return pairs.join(texts, "id").join(small(scripts.select("script_id", "script_text")), "script_id").select("text", "script_id", "script_text")


def best_per_path(matches: DataFrame, scripts: DataFrame) -> DataFrame:
    """The best script of each path for each text: highest similarity, then the first script."""
    info = scripts.select("script_id", "path", "depth", "node_order", "script_type", "script_pos", "script_text")
    joined = matches.join(small(info), "script_id")
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("node_order"), F.col("script_type"), F.col("script_pos"), F.col("script_id"))
    return joined.groupBy("text", "path", "depth").agg(F.min_by(F.struct("similarity", "script_id", "script_text"), rank).alias("b")).select("text", "path", "depth", "b.similarity", "b.script_id", "b.script_text")


def latest_match(messages: DataFrame, matches: DataFrame) -> DataFrame:
    """Per conversation the latest message that any script matches, with its best script. ``messages``: conv_id, pos, text."""
    best = matches.groupBy("text").agg(F.min_by(F.struct("script_id", "similarity"), F.struct((-F.col("similarity")).alias("s"), F.col("script_id"))).alias("b"))
    return messages.join(best, "text").groupBy("conv_id").agg(F.max_by(F.struct("pos", "text", "b"), "pos").alias("m")).select("conv_id", "m.pos", "m.text", "m.b.script_id", "m.b.similarity")


def chains(messages: DataFrame, by_path: DataFrame) -> DataFrame:
    """Per conversation and path: for each prefix of two levels or more its best message, ties to the later one.

    (conv_id, path, level, pos, similarity). Only paths that some message of the conversation matches are built.
    """
    hits = messages.join(by_path.filter("depth >= 2"), "text").select("conv_id", "pos", "path", "depth", "similarity")
    paths = hits.select("conv_id", "path").distinct()
    levels = paths.select("conv_id", "path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("level")).withColumn("prefix", F.expr("slice(path, 1, level)"))
    best = hits.groupBy("conv_id", F.col("path").alias("prefix")).agg(F.max_by(F.struct("pos", "similarity"), F.struct("similarity", "pos")).alias("b"))
    return levels.join(best, ["conv_id", "prefix"]).select("conv_id", "path", "level", "b.pos", "b.similarity")


def monotone_chain(hits: DataFrame) -> DataFrame:
    """Per conversation and path the chain whose levels occur in order: each level's best message at or after the one
    before; where there is none, its best message anywhere. ``hits``: conv_id, path, level, pos, similarity.

    A path has at most a handful of levels, so the fold runs over one small array per (conversation, path).
    """
    by_level = hits.groupBy("conv_id", "path", "level").agg(F.collect_list(F.struct(F.col("similarity").cast("double").alias("similarity"), F.col("pos").cast("long").alias("pos"))).alias("found"))
    whole = by_level.groupBy("conv_id", "path").agg(F.sort_array(F.collect_list(F.struct("level", "found"))).alias("levels"))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<struct<level:int,pos:bigint,similarity:double>>").alias("chain"))

    def step(state: Column, level: Column) -> Column:
        later = F.array_max(F.filter(level["found"], lambda f: f["pos"] >= state["at"]))
        pick = F.coalesce(later, F.array_max(level["found"]))
        link = F.struct(level["level"].cast("int").alias("level"), pick["pos"].alias("pos"), pick["similarity"].alias("similarity"))
        return F.struct(F.greatest(state["at"], pick["pos"]).alias("at"), F.concat(state["chain"], F.array(link)).alias("chain"))

    return whole.select("conv_id", "path", F.inline(F.aggregate("levels", start, step, lambda s: s["chain"])))


def keyword_hits(replies: DataFrame, patterns: DataFrame) -> DataFrame:
    """The best pattern of each reply text: at least ``min_matches`` keywords or ``min_ratio`` of them.

    ``patterns``: pattern_id, keywords, min_matches, min_ratio. Candidates share a keyword, found through its first
    bigram. Ranked by ratio, number of keywords, pattern id.
    """
    texts = replies.select("text").distinct().withColumn("clean", T.without_attachments(F.col("text")))
    firsts = small(patterns.select("pattern_id", "keywords", "min_matches", "min_ratio", F.explode(F.array_distinct(F.transform("keywords", lambda k: F.substring(k, 1, 2)))).alias("gram")), 40 * MAX_SCRIPTS)
    pairs = texts.select("text", "clean", F.explode(F.array_distinct(T.char_ngrams(F.col("clean"), (2,)))).alias("gram")).join(firsts, "gram").select("text", "clean", "pattern_id", "keywords", "min_matches", "min_ratio").distinct()
    matched = F.filter("keywords", lambda k: F.col("clean").contains(k))
    scored = pairs.withColumns({"matched": F.size(matched), "ratio": F.round(F.size(matched) / F.size("keywords"), 6)}).filter((F.col("matched") >= F.col("min_matches")) | (F.col("ratio") >= F.col("min_ratio")))
    rank = F.struct((-F.col("ratio")).alias("r"), (-F.col("matched")).alias("m"), F.col("pattern_id"))
    return scored.groupBy("text").agg(F.min_by(F.struct("pattern_id", "matched", "ratio"), rank).alias("b")).select("text", "b.*")


def alias_hits(texts: DataFrame, aliases: DataFrame, limit: int = MAX_SCRIPTS) -> DataFrame:
    """(text, canonical) of the aliases that a text holds, found through an alias's first two characters, or its only one.

    ``aliases``: canonical, alias. Other columns of it are given, too.
    """
    known = aliases.filter("alias <> ''").withColumn("__gram", F.substring("alias", 1, 2))
    grams = _distinct(texts).select("id", F.explode(F.array_distinct(T.char_ngrams(F.col("text"), (1, 2)))).alias("__gram"))
    pairs = grams.join(small(known, limit), "__gram").drop("__gram").join(_distinct(texts), "id")
    return pairs.filter(F.col("text").contains(F.col("alias"))).drop("id", "alias").distinct()


def resolve_aliases(texts: DataFrame, aliases: DataFrame, families: list[list[str]]) -> DataFrame:
    """(text, items): the canonical names that a text's aliases stand for, in any letter case, sorted.

    ``aliases``: family, canonical, alias; a canonical name stands for itself. ``families`` are tried in turn: a group of
    families counts only where no group before it in the same list was hit, e.g. ``[["module", "province"], ["exam"]]``.
    """
    both = aliases.select("family", "canonical", F.lower("alias").alias("alias")).unionByName(aliases.select("family", "canonical", F.lower("canonical").alias("alias"))).distinct()
    named = texts.select(F.col("text").alias("__text"), F.lower("text").alias("text")).distinct()
    found = named.join(alias_hits(named.select("text"), both), "text").groupBy("__text").agg(F.collect_set(F.struct("family", "canonical")).alias("hits"))
    of = lambda family: F.transform(F.filter("hits", lambda h: h["family"] == family), lambda h: h["canonical"])
    chosen = []
    for chain in families:
        value = of(chain[-1])
        for family in reversed(chain[:-1]):
            value = F.when(F.size(of(family)) > 0, of(family)).otherwise(value)
        chosen.append(value)
    return found.select(F.col("__text").alias("text"), F.array_sort(F.array_distinct(F.concat(*chosen))).alias("items"))


def best_script_verdict(node: Column, predicted: Column) -> Column:
    """Whether a conversation's stored node and the predicted one agree."""
    return F.when(predicted.isNull(), "未定位").when(F.coalesce(F.trim(node), F.lit("")) == "", "无原SOP标签").when(node == predicted, "一致").otherwise("不一致")




def template_hits(replies: DataFrame, scripts: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(text, script_id, similarity) of replies that follow a script's template, digits left open."""
    pairs = _candidates(replies, scripts)
    scored = pairs.withColumn("similarity", F.round(template_similarity(T.template_form(F.col("text")), T.template_form(F.col("script_text"))), 6))
    return scored.filter(F.col("similarity") >= threshold).select("text", "script_id", "similarity")


def exact_matches(messages: DataFrame, scripts: DataFrame) -> DataFrame:
    """(text, script_id, similarity 1) of texts that are a script, to the character."""
    same = small(scripts.select("script_id", F.trim("script_text").alias("text")))
    return _distinct(messages).select("text", F.trim("text").alias("__t")).join(same.withColumnRenamed("text", "__t"), "__t").select("text", "script_id", F.lit(1.0).alias("similarity"))


def first_hit(messages: DataFrame, matches: DataFrame, scripts: DataFrame) -> DataFrame:
    """One node for each message: the deepest level first, then the tree's order, with the node's first script as the
    replacement. ``messages``: conv_id, pos, text; ``matches`` by membership (``exact_matches``) or by similarity."""
    order = F.struct("script_type", "script_pos", "script_id")
    heads = scripts.groupBy("path").agg(F.min_by("script_text", order).alias("replacement"))
    nodes = scripts.select("script_id", "depth", "node_order", "script_pos", "path").join(small(heads), "path")
    hits = messages.join(matches, "text").join(small(nodes), "script_id")
    rank = F.struct((-F.col("depth")).alias("d"), F.col("node_order"), F.col("script_pos"), F.col("script_id"))
    return hits.groupBy("conv_id", "pos").agg(F.min_by(F.struct("script_id", "depth", "path", "replacement"), rank).alias("b")).select("conv_id", "pos", "b.*")


def predicted_paths(scripts: DataFrame, levels: int = 9) -> DataFrame:
    """From each node the path that follows the alphabetically first child: (path, predicted). A small table, on the driver."""
    rows = scripts.select("path").distinct().limit(MAX_SCRIPTS + 1).collect()
    if len(rows) > MAX_SCRIPTS:
        raise ValueError(f"more than {MAX_SCRIPTS} nodes")
    paths = {tuple(r.path[:n]) for r in rows for n in range(1, len(r.path) + 1)}
    children: dict[tuple, list[str]] = {}
    for p in paths:
        children.setdefault(p[:-1], []).append(p[-1])
    out = []
    for p in sorted(paths):
        end = p
        while len(end) < levels and end in children:
            end = (*end, min(children[end]))
        out.append((list(p), list(end)))
    return scripts.sparkSession.createDataFrame(out, "path array<string>, predicted array<string>")


def unmatched_levels(path: Column, links: Column) -> Column:
    """The levels of a path that no message matched, as text. ``links``: array of structs with a level."""
    missing = F.filter(F.sequence(F.lit(2), F.greatest(F.size(path), F.lit(2))), lambda n: ~F.exists(links, lambda x: x["level"] == n))
    return F.array_join(F.transform(missing, lambda n: F.concat(F.lit("第"), n.cast("string"), F.lit("级未匹配"))), "；")
