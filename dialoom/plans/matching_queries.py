"""Queries that match messages against the script tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import compliance
from dialoom.operators import dialogue as D
from dialoom.operators import scripts as S
from dialoom.operators import tagging as G
from dialoom.plans.dialogue_queries import MESSAGES, SALES, match_key_sql
from dialoom.session import ensure_checkpoint_dir, table

COSINE, TFIDF, LEXICAL = 0.6, 0.5, 0.6


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sop_scripts")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.messages(table(spark, sf_dir, "tagging_corpus").select("conv_id", "final_context"), "conv_id", "final_context")
    return rows.filter(D.is_sales(F.col("speaker"))).select("conv_id", "pos", "text")


def cosine_match(spark, sf_dir):
    return S.cosine_matches(_sales(spark, sf_dir), _scripts(spark, sf_dir), COSINE)


def tfidf_match(spark, sf_dir):
    return S.tfidf_matches(_sales(spark, sf_dir), _scripts(spark, sf_dir), TFIDF)


def lexical_match(spark, sf_dir):
    return S.lexical_matches(_sales(spark, sf_dir), _scripts(spark, sf_dir), LEXICAL)


def sequence_match(spark, sf_dir):
    return S.sequence_or_cosine(_sales(spark, sf_dir), _scripts(spark, sf_dir), COSINE)


def latest_match_top1(spark, sf_dir):
    return S.latest_match(_sales(spark, sf_dir), cosine_match(spark, sf_dir))


def node_verdict(spark, sf_dir):
    """The node of the latest matched message against the stored one."""
    found = latest_match_top1(spark, sf_dir).join(S.small(_scripts(spark, sf_dir).select("script_id", F.col("path")[0].alias("node"))), "script_id")
    rows = table(spark, sf_dir, "tagging_corpus").select("conv_id", "sop_l1").join(found.select("conv_id", "node"), "conv_id", "left")
    return rows.select("conv_id", S.best_script_verdict(F.col("sop_l1"), F.col("node")).alias("verdict"))


def own_node_match(spark, sf_dir):
    """The latest message that matches a script of the conversation's own node."""
    own = table(spark, sf_dir, "tagging_corpus").select("conv_id", "sop_l1", "sop_l2").filter("sop_l1 is not null and sop_l2 is not null")
    scripts = _scripts(spark, sf_dir).select("script_id", F.col("path")[0].alias("sop_l1"), F.col("path")[1].alias("sop_l2"))
    hits = _sales(spark, sf_dir).join(cosine_match(spark, sf_dir), "text").join(own, "conv_id").join(S.small(scripts), ["script_id", "sop_l1", "sop_l2"])
    rank = F.struct("pos", "similarity", (-F.col("script_id")).alias("s"))
    return hits.groupBy("conv_id").agg(F.max_by(F.struct("pos", "script_id", "similarity"), rank).alias("m")).select("conv_id", "m.*")


def verify_matches(spark, sf_dir):
    """Stored nodes confirmed by a reply, or why not."""
    rows = D.messages(table(spark, sf_dir, "tagging_corpus").select("conv_id", "final_context"), "conv_id", "final_context")
    sales = rows.filter(D.is_sales(F.col("speaker"))).select("conv_id", "pos", "ts", "text")
    return G.verify(table(spark, sf_dir, "tagging_corpus"), sales, S.cosine_matches(sales, _scripts(spark, sf_dir), COSINE), _scripts(spark, sf_dir))


def composite_match(spark, sf_dir):
    return S.composite_matches(_sales(spark, sf_dir), _scripts(spark, sf_dir), LEXICAL)


def best_per_path(spark, sf_dir):
    """The best script of each path for every distinct sales message."""
    return S.best_per_path(cosine_match(spark, sf_dir), _scripts(spark, sf_dir)).select("text", F.array_join("path", ">").alias("path"), "similarity", "script_id")


def script_chains(spark, sf_dir):
    by_path = S.best_per_path(cosine_match(spark, sf_dir), _scripts(spark, sf_dir))
    return S.chains(_sales(spark, sf_dir), by_path).select("conv_id", F.array_join("path", ">").alias("path"), "level", "pos", "similarity")


def _tagging(spark, sf_dir):
    """(sales messages, all their hits, candidate chains, paths) of the corpus; hits are found once."""
    ensure_checkpoint_dir(spark)
    rows = D.messages(table(spark, sf_dir, "tagging_corpus").select("conv_id", "final_context"), "conv_id", "final_context")
    sales = G.until_last_customer(rows, D.is_sales(F.col("speaker")), F.col("speaker") == "客户")
    scripts = _scripts(spark, sf_dir)
    paths = G.path_table(scripts)
    found = G.hits(sales, S.best_per_path(S.cosine_matches(sales, scripts, COSINE), scripts)).checkpoint()
    return sales, found, G.candidates(found, paths).checkpoint(), paths


def _shown(matched):
    return matched.select("conv_id", F.array_join("path", ">").alias("path"), "covered", "weakest", "strongest", "pos", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["level"], x["pos"])), " ").alias("links"))


def regular_match(spark, sf_dir):
    """The path of the newest message with one."""
    return _shown(G.regular(_tagging(spark, sf_dir)[2]))


def strong_match(spark, sf_dir):
    """The best path whose second level is matched almost to the letter."""
    return _shown(G.strong(_tagging(spark, sf_dir)[2]))


def fallback_match(spark, sf_dir):
    """The best path over all messages, for every conversation with a hit."""
    _, found, chosen, paths = _tagging(spark, sf_dir)
    return _shown(G.fallback(found, chosen, paths))


def merged_match(spark, sf_dir):
    """Validated, regular and fallback match put together."""
    sales, found, chosen, paths = _tagging(spark, sf_dir)
    scripts = _scripts(spark, sf_dir)
    matches = S.cosine_matches(sales, scripts, G.FILLED)
    whole = G.merged(G.base_match(found, chosen, paths), G.strong(chosen), sales, matches, scripts, S.predicted_paths(scripts))
    return whole.select("conv_id", F.array_join("path", ">").alias("path"), "method", "tail", F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["level"], x["pos"])), " ").alias("levels"))


def all_level_match(spark, sf_dir):
    """The best script of every level of each sales message's best path."""
    return G.all_level_best(cosine_match(spark, sf_dir), _scripts(spark, sf_dir), 0.7).select("text", F.array_join("path", ">").alias("path"), "level", "script_id", "similarity")


def best_candidate(spark, sf_dir):
    """The nearest script of every sales message that shares a bigram with one, whatever the score."""
    return G.best_candidate(S.cosine_matches(_sales(spark, sf_dir), _scripts(spark, sf_dir), 0.0))


def targeted_match(spark, sf_dir):
    """The latest match of the own node, else of any."""
    labels = table(spark, sf_dir, "tagging_corpus").select("conv_id", "sop_l1", "sop_l2")
    return G.targeted_then_nearest(_sales(spark, sf_dir), cosine_match(spark, sf_dir), _scripts(spark, sf_dir), labels)


def _sentence_hits(spark, sf_dir):
    parts = _sales(spark, sf_dir).select("conv_id", "pos", F.posexplode(T.sentences(F.col("text"))).alias("place", "text"))
    return G.sentence_hits(parts, S.best_per_path(S.cosine_matches(parts, _scripts(spark, sf_dir), COSINE), _scripts(spark, sf_dir)))


def _sentencewise(spark, sf_dir, extended):
    ensure_checkpoint_dir(spark)
    found = _sentence_hits(spark, sf_dir).checkpoint()
    chosen = G.sentencewise(found, S.branch_paths(_scripts(spark, sf_dir)).select("path"))
    chosen = G.extend_branch(chosen, found, 4) if extended else chosen
    spots = F.transform("links", lambda x: F.concat_ws(":", x["level"], F.floor(x["spot"] / G.SPOT), x["spot"] % G.SPOT))
    return chosen.select("conv_id", F.array_join("path", ">").alias("path"), F.array_join(spots, " ").alias("links"))


def sentencewise_match(spark, sf_dir):
    """The path of each conversation by single sentences whose levels occur in order."""
    return _sentencewise(spark, sf_dir, False)


def sentencewise_extended(spark, sf_dir):
    """That path carried on by later sentences."""
    return _sentencewise(spark, sf_dir, True)


def exact_hit(spark, sf_dir):
    """The node of every message that is one of its scripts, and the node's first script."""
    sales = _sales(spark, sf_dir)
    return S.first_hit(sales, S.exact_matches(sales, _scripts(spark, sf_dir)), _scripts(spark, sf_dir)).select("conv_id", "pos", "script_id", "replacement")


def keyword_patterns(spark, sf_dir):
    """The best keyword pattern, made of a script's own pieces, of every sent text."""
    words = T.keywords(F.col("script_text"))
    patterns = _scripts(spark, sf_dir).select(F.col("script_id").alias("pattern_id"), words.alias("keywords")).filter(F.size("keywords") > 0)
    patterns = patterns.withColumns({"min_matches": F.greatest(F.lit(2), F.ceil(0.35 * F.size("keywords"))), "min_ratio": F.lit(0.45)})
    return S.keyword_hits(table(spark, sf_dir, "reflow_rows").select(F.col("sent_text").alias("text")).filter("text is not null"), patterns)


def compliance_hits(spark, sf_dir):
    """The best pattern of each sent text: the scripts' pieces, of every other script the first one mandatory."""
    words = T.keywords(F.col("script_text"))
    patterns = _scripts(spark, sf_dir).withColumn("keywords", words).filter(F.size("keywords") > 0).select(
        F.col("script_id").alias("pattern_id"), F.col("path")[0].alias("category"), F.concat(F.lit("p"), "script_id").alias("name"), "keywords",
        F.when(F.col("script_id") % 2 == 1, F.slice("keywords", 1, 1)).otherwise(F.array().cast("array<string>")).alias("mandatory"),
        F.lit(2).alias("min_matches"), F.lit(0.45).alias("min_ratio"), F.lit("").alias("template"), F.lit(0.88).alias("fuzzy_threshold"),
    )
    return compliance.hits(table(spark, sf_dir, "reflow_rows").select(F.col("sent_text").alias("text")).filter("text is not null"), patterns, ("需求了解", "开场与破冰"))


def compliance_totals(spark, sf_dir):
    """How many replies hit a pattern, of all."""
    found = compliance_hits(spark, sf_dir).select(F.col("text").alias("sent_text"), F.lit(True).alias("hit"))
    return table(spark, sf_dir, "reflow_rows").select("sent_text").join(found, "sent_text", "left").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("hits"))


def alias_lookup(spark, sf_dir):
    """Sub-themes whose topic a sent text names."""
    topic = F.regexp_replace("sub_theme_alt", "^(?:提醒|发送|预约|了解|确认)|说明$", "")
    aliases = table(spark, sf_dir, "sop_schema").filter("sub_theme_alt is not null").select(F.col("sub_id").alias("canonical"), topic.alias("alias"))
    return S.alias_hits(table(spark, sf_dir, "reflow_rows").select(F.col("sent_text").alias("text")).filter("text is not null").distinct(), aliases)


def branch_paths(spark, sf_dir):
    return S.branch_paths(_scripts(spark, sf_dir)).select(F.array_join("path", ">").alias("path"), "depth")


def template_hits(spark, sf_dir):
    return S.template_hits(_sales(spark, sf_dir), _scripts(spark, sf_dir))


def first_hit(spark, sf_dir):
    """The deepest, then first node of every matched message."""
    hits = S.first_hit(_sales(spark, sf_dir), cosine_match(spark, sf_dir), _scripts(spark, sf_dir))
    return hits.select("conv_id", "pos", "script_id", "depth")


def predicted_paths(spark, sf_dir):
    return S.predicted_paths(_scripts(spark, sf_dir)).select(F.array_join("path", ">").alias("path"), F.array_join("predicted", ">").alias("predicted"))


def unmatched_levels(spark, sf_dir):
    best = G.regular(_tagging(spark, sf_dir)[2])
    return best.select("conv_id", S.unmatched_levels(F.col("path"), F.col("links")).alias("missing"))


QUERIES = {f.__name__: f for f in (cosine_match, tfidf_match, lexical_match, sequence_match, latest_match_top1, node_verdict, own_node_match, verify_matches, composite_match, best_per_path, script_chains, regular_match, strong_match, fallback_match, merged_match, all_level_match, best_candidate, targeted_match, sentencewise_match, sentencewise_extended, exact_hit, keyword_patterns, compliance_hits, compliance_totals, alias_lookup, branch_paths, template_hits, first_hit, predicted_paths, unmatched_levels)}


def _grams(key: str, sizes: tuple[int, ...]) -> str:
    return "list_concat(" + ", ".join(f"list_transform(range(1, length({key}) - {n - 2}), lambda i: substring({key}, i, {n}))" for n in sizes) + ")" if len(sizes) > 1 else f"list_transform(range(1, length({key})), lambda i: substring({key}, i, 2))"


_COSINE = f"""
{MESSAGES.strip()},
sales AS (SELECT conv_id, pos, text FROM msgs WHERE {SALES}),
tg AS (SELECT text, g, count(*) AS tf FROM (SELECT text, unnest({_grams('k', (2,))}) AS g FROM (SELECT text, {match_key_sql('text')} AS k FROM (SELECT DISTINCT text FROM sales))) GROUP BY 1, 2),
sg AS (SELECT script_id, g, count(*) AS tf FROM (SELECT script_id, unnest({_grams('k', (2,))}) AS g FROM (SELECT script_id, {match_key_sql('script_text')} AS k FROM sop_scripts)) GROUP BY 1, 2),
tn AS (SELECT text, sqrt(sum(tf * tf)) AS n FROM tg GROUP BY 1), sn AS (SELECT script_id, sqrt(sum(tf * tf)) AS n FROM sg GROUP BY 1),
cosm AS (SELECT text, script_id, similarity FROM (SELECT text, script_id, round(sum(tg.tf * sg.tf) / (any_value(tn.n) * any_value(sn.n)), 6) AS similarity FROM tg JOIN sg USING (g) JOIN tn USING (text) JOIN sn USING (script_id) GROUP BY 1, 2) WHERE similarity >= {COSINE}),
late AS (SELECT conv_id, arg_max(struct_pack(pos := pos, text := text, script_id := script_id, similarity := similarity), pos) AS m FROM (
  SELECT s.conv_id, s.pos, s.text, b.script_id, b.similarity FROM sales s JOIN (SELECT text, script_id, similarity FROM cosm QUALIFY row_number() OVER (PARTITION BY text ORDER BY similarity DESC, script_id) = 1) b USING (text)) GROUP BY conv_id),
bpp AS (SELECT text, path, depth, similarity, script_id FROM cosm JOIN sop_scripts USING (script_id) QUALIFY row_number() OVER (PARTITION BY text, path ORDER BY similarity DESC, node_order, script_type, script_pos, script_id) = 1),
hits AS (SELECT conv_id, pos, path, similarity FROM sales JOIN bpp USING (text) WHERE depth >= 2),
lev AS (SELECT DISTINCT conv_id, path, unnest(range(2, len(path) + 1)) AS level FROM hits),
pre AS (SELECT conv_id, path AS prefix, arg_max(struct_pack(pos := pos, similarity := similarity), struct_pack(s := similarity, p := pos)) AS b FROM hits GROUP BY 1, 2),
chn AS (SELECT l.conv_id, l.path, l.level, p.b.pos AS pos, p.b.similarity AS similarity FROM lev l JOIN pre p ON p.conv_id = l.conv_id AND p.prefix = l.path[1:l.level])"""
_CAND = f"""{_COSINE},
lastc AS (SELECT conv_id, max(pos) AS lc FROM msgs WHERE speaker = '客户' GROUP BY 1),
ht AS (SELECT s.conv_id, s.pos, b.path, b.similarity, b.script_id FROM sales s JOIN lastc USING (conv_id) JOIN bpp b USING (text) WHERE s.pos <= lc),
ord AS (SELECT path, min(node_order) AS node_order FROM sop_scripts GROUP BY 1),
lvl AS (SELECT conv_id, pos, path, unnest(range(2, len(path) + 1)) AS level FROM ht WHERE len(path) >= 2),
lnk AS (SELECT l.conv_id, l.pos, l.path, l.level, arg_max(struct_pack(pos := h.pos, s := h.similarity), struct_pack(s := h.similarity, p := h.pos)) AS b FROM lvl l JOIN ht h ON h.conv_id = l.conv_id AND h.path = l.path[1:l.level] AND h.pos <= l.pos GROUP BY 1, 2, 3, 4),
cand AS (SELECT conv_id, pos, path, CAST(count(*) AS INT) AS covered, min(b.s) AS weakest, max(b.s) AS strongest, round(sum(b.s), 6) AS total, max(b.pos) AS last_pos, max(b.pos) FILTER (WHERE level = 2) AS second_pos, max(b.s) FILTER (WHERE level = 2) AS second_similarity,
  list(b.pos) AS spots, list(level) AS lv, string_agg(level || ':' || b.pos, ' ' ORDER BY level) AS links, any_value(node_order) AS node_order FROM lnk JOIN ord USING (path) GROUP BY 1, 2, 3)"""
_SHOWN = "conv_id, array_to_string(path, '>') AS path, covered, weakest, strongest, pos, links"
_TFIDF = f"""
{MESSAGES.strip()},
tx AS (SELECT DISTINCT text FROM msgs WHERE {SALES}),
sg AS (SELECT script_id, g, count(*) AS tf FROM (SELECT script_id, unnest({_grams('k', (2, 3, 4))}) AS g FROM (SELECT script_id, lower(script_text) AS k FROM sop_scripts)) GROUP BY 1, 2),
idf AS (SELECT g, ln((1 + (SELECT count(*) FROM sop_scripts)) / (1 + count(*))) + 1 AS idf FROM sg GROUP BY 1),
sw AS (SELECT script_id, g, tf * idf AS w FROM sg JOIN idf USING (g)), sn AS (SELECT script_id, sqrt(sum(w * w)) AS n FROM sw GROUP BY 1),
tw AS (SELECT text, g, count(*) * any_value(idf) AS w FROM (SELECT text, unnest({_grams('k', (2, 3, 4))}) AS g FROM (SELECT text, lower(text) AS k FROM tx)) JOIN idf USING (g) GROUP BY 1, 2),
tn AS (SELECT text, sqrt(sum(w * w)) AS n FROM tw GROUP BY 1)
SELECT text, script_id, similarity FROM (SELECT text, script_id, round(sum(tw.w * sw.w / sn.n) / any_value(tn.n), 6) AS similarity FROM tw JOIN sw USING (g) JOIN sn USING (script_id) JOIN tn USING (text) GROUP BY 1, 2) WHERE similarity >= {TFIDF}"""
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace({0}, '<newline>', ' '), '\[[^\]]+\]\([^)]+\)|\[[^\]]+\.(png|jpg|jpeg|gif|pdf|docx?)\]', ' ', 'g'), '(?i)\{{ *"bucketName"[^{{}}]*\}}|\b\d{{1,3}};rgb:[0-9a-fA-F/]+\b', ' ', 'g'), '[\s\p{{Z}}\x{{85}}\x0b]+', ' ', 'g'))"""
_NOISE = r"""regexp_replace(regexp_replace(replace(script_text, '<newline>', ' '), '\[[^\]]+\]\([^)]+\)|\[[^\]]+\.(png|jpg|jpeg|gif|pdf|docx?)\]', ' ', 'g'), '(?i)\{ *"bucketName"[^{}]*\}|\b\d{1,3};rgb:[0-9a-fA-F/]+\b', ' ', 'g')"""
_HITS = rf"""WITH p AS (SELECT script_id AS pattern_id, path[1] AS category, list_filter(string_split_regex({_NOISE}, '[\s\p{{Z}}，,。！？!?；;：:、()（）\[\]{{}}<>《》“”"''·…~～❤-]+'), lambda x: length(x) >= 2) AS kw FROM sop_scripts),
r AS (SELECT DISTINCT sent_text AS text FROM reflow_rows WHERE sent_text IS NOT NULL), c AS (SELECT text, {_CLEAN.format('text')} AS clean FROM r),
m AS (SELECT text, pattern_id, category, kw, list_filter(kw, lambda k: contains(clean, k)) AS f FROM c, p WHERE len(kw) > 0),
hits AS (SELECT text, pattern_id, category, 'p' || pattern_id AS name, CAST(len(f) AS INT) AS matched, round(len(f) / len(kw), 4) AS score FROM m
  WHERE len(f) > 0 AND (len(f) >= 2 OR len(f) / len(kw) >= 0.45) AND (pattern_id % 2 = 0 OR list_contains(f, kw[1]))
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(len(f) / len(kw), 9) DESC, len(f) DESC, CASE category WHEN '需求了解' THEN 1 WHEN '开场与破冰' THEN 2 ELSE 99 END, pattern_id) = 1)"""
ORACLES = {
    "compliance_hits": f"{_HITS} SELECT * FROM hits",
    "compliance_totals": f"{_HITS} SELECT count(*) AS rows, count(h.text) AS hits FROM reflow_rows r LEFT JOIN hits h ON h.text = r.sent_text",
    "cosine_match": f"WITH {_COSINE} SELECT * FROM cosm",
    "tfidf_match": f"WITH {_TFIDF}",
    "latest_match_top1": f"WITH {_COSINE} SELECT conv_id, m.pos AS pos, m.text AS text, m.script_id AS script_id, m.similarity AS similarity FROM late",
    "node_verdict": f"WITH {_COSINE} SELECT t.conv_id, CASE WHEN s.path IS NULL THEN '未定位' WHEN coalesce(trim(t.sop_l1), '') = '' THEN '无原SOP标签' WHEN t.sop_l1 = s.path[1] THEN '一致' ELSE '不一致' END AS verdict FROM tagging_corpus t LEFT JOIN late ON late.conv_id = t.conv_id LEFT JOIN sop_scripts s ON s.script_id = late.m.script_id",
    "own_node_match": f"WITH {_COSINE} SELECT s.conv_id, s.pos, c.script_id, c.similarity FROM sales s JOIN cosm c USING (text) JOIN tagging_corpus t ON t.conv_id = s.conv_id JOIN sop_scripts q ON q.script_id = c.script_id AND q.path[1] = t.sop_l1 AND q.path[2] = t.sop_l2 QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.pos DESC, c.similarity DESC, c.script_id) = 1",
    "verify_matches": f"""WITH {_COSINE}, st AS (SELECT conv_id, arg_max(struct_pack(t := text, ts := coalesce(ts, '')), pos) AS last, list(pos) AS places FROM msgs WHERE {SALES} GROUP BY 1),
nd AS (SELECT script_id, path[1] AS n1, path[2] AS n2 FROM sop_scripts WHERE len(path) > 1), ex AS (SELECT DISTINCT n1, n2, TRUE AS e FROM nd),
ref AS (SELECT t.conv_id, nd.script_id FROM tagging_corpus t LEFT JOIN ex ON ex.n1 = t.sop_l1 AND ex.n2 = t.sop_l2 JOIN nd ON CASE WHEN e THEN nd.n1 = t.sop_l1 AND nd.n2 = t.sop_l2 ELSE {match_key_sql('nd.n1')} = {match_key_sql('t.sop_l1')} AND {match_key_sql('nd.n2')} = {match_key_sql('t.sop_l2')} END),
ht AS (SELECT s.conv_id, s.pos, c.script_id, c.similarity FROM sales s JOIN cosm c USING (text) JOIN ref r ON r.conv_id = s.conv_id AND r.script_id = c.script_id QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.pos DESC, c.similarity DESC, c.script_id) = 1),
w AS (SELECT t.conv_id, CASE WHEN t.sop_l1 IS NULL OR t.sop_l2 IS NULL THEN '缺少SOP节点标签' WHEN trim(coalesce(t.final_context, ''), ' ') = '' THEN '缺少历史对话' WHEN st.last IS NULL THEN '历史对话中没有销售侧消息'
  WHEN t.conv_id NOT IN (SELECT conv_id FROM ref) THEN 'SOP节点未找到参考话术' WHEN ht.pos IS NULL THEN '未找到满足阈值的匹配' ELSE '' END AS match_reason, coalesce(st.last.t, '') AS latest_sales_message, coalesce(st.last.ts, '') AS latest_sales_time, ht.pos, ht.script_id, ht.similarity, places
  FROM tagging_corpus t LEFT JOIN st USING (conv_id) LEFT JOIN ht USING (conv_id))
SELECT conv_id, match_reason = '' AS match_status, CASE WHEN match_reason = '' THEN '是' ELSE '否' END AS match_hit, match_reason, latest_sales_message, latest_sales_time, pos, script_id, similarity,
  CASE WHEN match_reason = '' THEN CAST(len(list_filter(places, lambda x: x >= pos)) AS INT) END AS turn_from_last FROM w""",
    "best_per_path": f"WITH {_COSINE} SELECT text, array_to_string(path, '>') AS path, similarity, script_id FROM bpp",
    "script_chains": f"WITH {_COSINE} SELECT conv_id, array_to_string(path, '>') AS path, CAST(level AS INT) AS level, pos, similarity FROM chn",
    "regular_match": f"WITH {_CAND} SELECT {_SHOWN} FROM cand QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC, covered / (len(path) - 1) DESC, covered DESC, weakest DESC, strongest DESC, len(path), node_order) = 1",
    "strong_match": f"WITH {_CAND} SELECT {_SHOWN} FROM cand WHERE second_similarity >= CASE WHEN contains(path[2], '二次跟进') THEN 0.85 ELSE 0.95 END QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY contains(path[2], '二次跟进') DESC, covered / (len(path) - 1) DESC, covered DESC, second_pos DESC, weakest DESC, second_similarity DESC, strongest DESC, len(path), pos DESC, node_order) = 1",
    "fallback_match": f"""WITH {_CAND}, deep AS (SELECT {_SHOWN} FROM cand JOIN (SELECT conv_id, max(pos) AS last_hit FROM ht GROUP BY 1) USING (conv_id)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY list_contains(spots, last_hit) DESC, covered DESC, weakest DESC, last_pos DESC, len(path), total DESC, pos, node_order) = 1),
lone AS (SELECT conv_id, array_to_string(h.path, '>') AS path, CAST(1 AS INT) AS covered, similarity AS weakest, similarity AS strongest, pos, len(h.path) || ':' || pos AS links FROM ht h JOIN ord USING (path) WHERE conv_id NOT IN (SELECT conv_id FROM deep)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY similarity DESC, pos, node_order) = 1)
SELECT * FROM deep UNION ALL SELECT * FROM lone""",
    "unmatched_levels": f"""WITH {_CAND}, best AS (SELECT conv_id, path, lv FROM cand QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC, covered / (len(path) - 1) DESC, covered DESC, weakest DESC, strongest DESC, len(path), node_order) = 1)
SELECT conv_id, array_to_string(list_transform(list_filter(range(2, greatest(len(path), 2) + 1), lambda n: NOT list_contains(lv, n)), lambda n: '第' || n || '级未匹配'), '；') AS missing FROM best""",
    "all_level_match": f"""WITH {_COSINE}, j AS (SELECT *, CASE WHEN script_type = '参考话术' THEN 0 ELSE 1 END AS kind FROM cosm JOIN sop_scripts USING (script_id) WHERE similarity >= 0.7),
b AS (SELECT text, path AS best FROM j QUALIFY row_number() OVER (PARTITION BY text ORDER BY similarity DESC, len(path) DESC, kind, node_order, script_pos, script_id) = 1)
SELECT text, array_to_string(best, '>') AS path, CAST(len(path) AS INT) AS level, script_id, similarity FROM j JOIN b USING (text) WHERE best[1:len(path)] = path
  QUALIFY row_number() OVER (PARTITION BY text, len(path) ORDER BY similarity DESC, kind, node_order, script_pos, script_id) = 1""",
    "best_candidate": f"WITH {_COSINE} SELECT text, script_id, similarity FROM (SELECT text, script_id, round(sum(tg.tf * sg.tf) / (any_value(tn.n) * any_value(sn.n)), 6) AS similarity FROM tg JOIN sg USING (g) JOIN tn USING (text) JOIN sn USING (script_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY text ORDER BY similarity DESC, script_id) = 1",
    "targeted_match": f"""WITH {_COSINE}, r AS (SELECT s.conv_id, s.pos, c.script_id, c.similarity, coalesce(q.path[1] = t.sop_l1 AND q.path[2] = t.sop_l2, FALSE) AS targeted FROM sales s JOIN cosm c USING (text) JOIN sop_scripts q USING (script_id) JOIN tagging_corpus t ON t.conv_id = s.conv_id)
SELECT conv_id, pos, script_id, similarity, targeted FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY targeted DESC, pos DESC, similarity DESC, script_id) = 1""",
    "predicted_paths": """WITH RECURSIVE n AS (SELECT DISTINCT path[1:i] AS p FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM sop_scripts)),
w AS (SELECT p AS path, p AS spot FROM n UNION ALL SELECT w.path, c.spot FROM w JOIN (SELECT p[1:len(p) - 1] AS up, arg_min(p, p[-1]) AS spot FROM n WHERE len(p) > 1 GROUP BY 1) c ON c.up = w.spot WHERE len(w.spot) < 9)
SELECT array_to_string(path, '>') AS path, array_to_string(arg_max(spot, len(spot)), '>') AS predicted FROM w GROUP BY path""",
    "keyword_patterns": rf"""WITH p AS (SELECT script_id AS pattern_id, list_filter(string_split_regex({_NOISE}, '[\s\p{{Z}}，,。！？!?；;：:、()（）\[\]{{}}<>《》“”"''·…~～❤-]+'), lambda x: length(x) >= 2) AS kw FROM sop_scripts),
r AS (SELECT DISTINCT sent_text AS text FROM reflow_rows WHERE sent_text IS NOT NULL), c AS (SELECT text, {_CLEAN.format('text')} AS clean FROM r),
m AS (SELECT text, pattern_id, len(list_filter(kw, lambda k: contains(clean, k))) AS matched, round(len(list_filter(kw, lambda k: contains(clean, k))) / len(kw), 6) AS ratio, greatest(2, ceil(0.35 * len(kw))) AS mm FROM c, p WHERE len(kw) > 0)
SELECT text, pattern_id, CAST(matched AS INT) AS matched, ratio FROM m WHERE matched > 0 AND (matched >= mm OR ratio >= 0.45) QUALIFY row_number() OVER (PARTITION BY text ORDER BY ratio DESC, matched DESC, pattern_id) = 1""",
    "alias_lookup": "SELECT DISTINCT r.sent_text AS text, s.sub_id AS canonical FROM (SELECT DISTINCT sent_text FROM reflow_rows WHERE sent_text IS NOT NULL) r, (SELECT sub_id, regexp_replace(sub_theme_alt, '^(提醒|发送|预约|了解|确认)|说明$', '', 'g') AS alias FROM sop_schema) s WHERE alias <> '' AND contains(r.sent_text, alias)",
    "exact_hit": f"""WITH {MESSAGES.strip()}, sales AS (SELECT conv_id, pos, text FROM msgs WHERE {SALES}),
first AS (SELECT path, arg_min(script_text, struct_pack(a := script_type, b := script_pos, c := script_id)) AS replacement FROM sop_scripts GROUP BY path)
SELECT s.conv_id, s.pos, q.script_id, f.replacement FROM sales s JOIN sop_scripts q ON trim(s.text, ' ') = trim(q.script_text, ' ') JOIN first f ON f.path = q.path
  QUALIFY row_number() OVER (PARTITION BY s.conv_id, s.pos ORDER BY q.depth DESC, q.node_order, q.script_pos, q.script_id) = 1""",
    "branch_paths": "SELECT DISTINCT array_to_string(path[1:n], '>') AS path, CAST(n AS INT) AS depth FROM (SELECT path, unnest(range(2, len(path) + 1)) AS n FROM sop_scripts)",
    "first_hit": f"WITH {_COSINE} SELECT s.conv_id, s.pos, c.script_id, q.depth FROM sales s JOIN cosm c USING (text) JOIN sop_scripts q ON q.script_id = c.script_id QUALIFY row_number() OVER (PARTITION BY s.conv_id, s.pos ORDER BY q.depth DESC, q.node_order, q.script_pos, q.script_id) = 1",
}
