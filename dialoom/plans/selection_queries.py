"""Queries of selection, sampling, de-duplication, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.operators import ordered
from dialoom.operators import reports as R
from dialoom.operators import sampling as S
from dialoom.plans.propagation_queries import blank as sql_blank
from dialoom.session import table

TOTAL = 400


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "testset").withColumn("cycle", S.cycle_description(F.col("cycle_label")))


def _node_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "reflow_rows").filter("sop_l1 is not null and trim(sop_l1) <> ''")
    return rows.groupBy(F.col("sop_l1").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))


def largest_remainder(spark, sf_dir):
    return S.largest_remainder(_node_sizes(spark, sf_dir), TOTAL)


def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "reflow_rows").select("row_order", "sop_l1")
    return S.draw(rows, "sop_l1", S.largest_remainder(_node_sizes(spark, sf_dir), TOTAL), "row_order").select("row_order", "sop_l1")


def two_phase_quota(spark, sf_dir):
    sizes = _cases(spark, sf_dir).groupBy(F.col("cycle").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return S.two_phase(sizes)


def two_phase_sample(spark, sf_dir):
    cases = _cases(spark, sf_dir).select("case_id", "cycle")
    return S.draw(cases, "cycle", two_phase_quota(spark, sf_dir), "case_id").select("case_id", "cycle")


def diverse_sample(spark, sf_dir):
    """Up to three cases of each type and desk, in hash order: a two-level stratified sample."""
    cases = table(spark, sf_dir, "testset").select("case_id", "message_type", "sales_id")
    return S.ranked(cases, ["message_type", "sales_id"], [S.hash_order(F.col("case_id")), F.col("case_id")], 3).select("case_id", F.col("place").cast("int").alias("place"))


def quality_sample(spark, sf_dir):
    """Per cycle ten cases: at most three questions, then others."""
    cases = _cases(spark, sf_dir).select("case_id", "cycle", F.coalesce("is_question", F.lit(False)).alias("question"))
    order = [S.hash_order(F.col("case_id")), F.col("case_id")]
    picked = S.ranked(cases, ["cycle", "question"], order, F.when(F.col("question"), 3).otherwise(10))
    total = picked.withColumn("pick", F.row_number().over(Window.partitionBy("cycle").orderBy(F.desc("question"), *order)))
    return total.filter("pick <= 10").select("case_id", "cycle", "question")


def anti_used(spark, sf_dir):
    """Cases that the diverse sample has not used."""
    used = diverse_sample(spark, sf_dir).select("case_id")
    return table(spark, sf_dir, "testset").select("case_id", "sales_id").join(used, "case_id", "left_anti")


def keyword_filter_readmit(spark, sf_dir):
    text = F.lower(F.coalesce("latest_message", F.lit("")))
    rules = [(text.rlike("手机|平板|电脑|ipad|pc|设备|怎么上课|在哪上课|如何上课"), 10), (text.rlike("<image|图片|截图"), 5), (F.trim("latest_message") == "我已经添加了你，现在我们可以开始聊天了。", 0)]
    return S.readmit(table(spark, sf_dir, "testset").select("case_id", "latest_message"), rules, "case_id").select("case_id")


def time_of_day_filter(spark, sf_dir):
    """Without the cases of only the first course day that were sent after 17:20, and those of the second."""
    m = F.col("cycle_label")
    late = (F.size(m) == 1) & (m["行课期"] == 1) & (F.hour("send_time") * 60 + F.minute("send_time") > 1040)
    return table(spark, sf_dir, "testset").filter(~F.coalesce(late, F.lit(False)) & ~F.coalesce(m["行课期"] == 2, F.lit(False))).select("case_id")


def cycle_description(spark, sf_dir):
    return R.shares(_cases(spark, sf_dir), F.col("cycle"))


def dedup_variants(spark, sf_dir):
    """The first case of each message; on a composite key; by preference for questions."""
    cases = table(spark, sf_dir, "testset").select("case_id", "sales_id", "customer_id", "latest_message", "history", "is_question").filter("latest_message is not null")
    message = F.trim("latest_message")
    by = {
        "message": S.keep_first(cases, [message], [F.col("case_id")]),
        "composite": S.keep_first(cases, [F.concat_ws("|", message, F.substring(F.coalesce("history", F.lit("")), 1, 100), "sales_id", "customer_id")], [F.col("case_id")]),
        "preferred": S.keep_first(cases, [message], [(~F.coalesce("is_question", F.lit(False))), F.col("case_id")]),
    }
    out = None
    for name, rows in by.items():
        part = rows.select(F.lit(name).alias("rule"), "case_id")
        out = part if out is None else out.unionByName(part)
    return out


def delivered_again(spark, sf_dir):
    """Log rows that were delivered before: same content under an earlier row number."""
    rows = table(spark, sf_dir, "reflow_rows")
    content = F.xxhash64(*[F.col(c) for c in rows.columns if c not in ("row_order", "source_file")])
    first = rows.select("row_order", content.alias("h"), F.struct(*[c for c in rows.columns if c not in ("row_order", "source_file")]).alias("c"))
    kept = first.groupBy("h", "c").agg(F.min("row_order").alias("row_order"))
    return first.select("row_order").join(kept.select("row_order"), "row_order", "left_anti")


def multi_key_sort_topk(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_shipdate")
    return items.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


def union_with_lineage(spark, sf_dir):
    """Two tables aligned by column name, missing ones null, with their source."""
    a = table(spark, sf_dir, "testset").select(F.lit("testset").alias("source_file"), "sales_id", "customer_id", "latest_message", "message_type")
    b = table(spark, sf_dir, "tagging_corpus").select(F.lit("tagging_corpus").alias("source_file"), "sales_id", "customer_id", "latest_message", "sop_l1")
    return a.unionByName(b, allowMissingColumns=True)


def union_distinct(spark, sf_dir):
    pairs = lambda t: table(spark, sf_dir, t).select("sales_id", "customer_id")
    return pairs("testset").union(pairs("tagging_corpus")).distinct()


def set_operations(spark, sf_dir):
    """Customers of both tables, and those of the test set only."""
    a, b = (table(spark, sf_dir, t).select("customer_id") for t in ("testset", "tagging_corpus"))
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).distinct().join(b, "customer_id", "left_anti").withColumn("part", F.lit("testset only")))


def histogram_share(spark, sf_dir):
    return R.shares(table(spark, sf_dir, "reflow_rows"), F.col("sop_l1"), ["sender"])


def distributions(spark, sf_dir):
    return R.distributions(_cases(spark, sf_dir), {"cycle": F.col("cycle"), "type": F.col("message_type"), "question": F.col("is_question"), "sales": F.col("sales_id")})


def sales_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "reflow_rows")
    return rows.groupBy("sales_id").agg(
        F.min_by("sales_name", F.when(F.col("sales_name").isNotNull(), F.col("row_order"))).alias("sales_name"), F.count(F.lit(1)).alias("all_rows"), F.countDistinct("customer_id").alias("customers"),
        F.count_if(F.col("sender") == "客户").alias("customer_rows"), F.round(F.count_if(F.col("sender") == "客户") / F.countDistinct("customer_id"), 6).alias("rows_per_customer"),
    )


def quality_metrics(spark, sf_dir):
    """Totals, non-blank values, sources, list lengths and flags of the test set."""
    return R.quality_metrics(
        table(spark, sf_dir, "testset"), ["history", "latest_message", "rag", "thought_unit", "node_1", "node_2", "reference_script", "expected_reply", "tags", "nickname", "batch_id", "questionnaire_title", "questionnaire_id", "rag_source"],
        ["sales_id", "customer_id"], ["rag_source", "thought_unit_source"], ["last_sales_messages", "alternative_replies"], ["is_question"],
    )


def coverage_report(spark, sf_dir):
    """Planned and actual cases of each cycle."""
    return R.selection_plan(two_phase_quota(spark, sf_dir), two_phase_sample(spark, sf_dir), "cycle")


def coverage_dimensions(spark, sf_dir):
    """Cases chosen of those available, by cycle, desk and type."""
    cases = _cases(spark, sf_dir)
    chosen = cases.join(two_phase_sample(spark, sf_dir).select("case_id"), "case_id", "left_semi")
    return R.coverage_of(cases, chosen, ["cycle", "sales_id", "message_type"])


def question_rates(spark, sf_dir):
    """Questions of each desk, and their rate."""
    return R.rates(table(spark, sf_dir, "testset"), ["sales_id"], F.col("is_question"))


def top_distributions(spark, sf_dir):
    """Histograms of cycle, type and question; of desks the ten with most cases (a top-k report)."""
    return R.top_values(distributions(spark, sf_dir), {"sales": 10})


def scenario_statistics(spark, sf_dir):
    return R.scenario_statistics(distributions(spark, sf_dir), {"cycle": "周期-", "type": "类型-", "question": "疑问-"})


def customers_per_desk(spark, sf_dir):
    """Customers of each desk and name, the largest first."""
    rows = table(spark, sf_dir, "reflow_rows").groupBy("sales_id", "sales_name").agg(F.countDistinct("customer_id").alias("customers"))
    return rows.orderBy(F.desc("customers"), "sales_id", "sales_name")


def target_nodes(spark, sf_dir):
    """Rows of the wanted first-level nodes."""
    wanted = [r.task_theme for r in table(spark, sf_dir, "sop_schema").filter("task_pos < 2").select("task_theme").distinct().collect()]  # a fixed table
    return table(spark, sf_dir, "reflow_rows").filter(F.col("sop_l1").isin(wanted)).select("row_order", "sop_l1")


def id_range(spark, sf_dir):
    """The messages 10 to 20 of every conversation, in order."""
    return table(spark, sf_dir, "chat_messages").filter("file_id is not null").filter(F.col("msg_id").between(10, 20)).select("row_id", "file_id", "msg_id").orderBy("file_id", "msg_id", "row_id")


def lead_expected_reply(spark, sf_dir):
    """The next case's sales messages of the same customer as expected and alternative replies."""
    blank = F.coalesce(F.trim("latest_message"), F.lit("")) == ""
    follow = F.lead("last_sales_messages").over(Window.partitionBy("customer_id").orderBy("message_time", "case_id"))
    cases = table(spark, sf_dir, "testset").withColumn("next", F.when(~blank & (F.size(follow) > 0), follow))
    return cases.select("case_id", F.coalesce(F.try_element_at("next", F.lit(1)), F.lit("")).alias("expected"), F.when(F.size("next") > 1, F.array_join(F.expr("slice(next, 2, size(next))"), "|")).otherwise("").alias("alternatives"))


def customer_ordinal(spark, sf_dir):
    """Each customer's number within the desk, by first appearance."""
    first = table(spark, sf_dir, "reflow_rows").filter("sender = '客户'").groupBy("sales_id", "customer_id").agg(F.min("row_order").alias("first_row"))
    # A running count in buckets: a desk with a third of all customers isn't one window.
    return ordered.running_sum(first, ["sales_id"], "first_row", F.lit(1), "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))


def hierarchical_fill(spark, sf_dir):
    """Merged cells of a master sheet filled downwards: themes stand only in the first row of each task."""
    sheet = table(spark, sf_dir, "sop_schema").withColumn("theme", F.when(F.col("sub_pos") == 0, F.col("task_theme")))
    down = Window.orderBy("task_pos", "sub_pos").rowsBetween(Window.unboundedPreceding, 0)
    return sheet.select("sub_id", F.last("theme", ignorenulls=True).over(down).alias("theme"))


def round_robin(spark, sf_dir):
    """Cases dealt in turn to seven groups."""
    return table(spark, sf_dir, "testset").select("case_id", (F.col("case_id") % 7).cast("int").alias("turn"))


def cycle_membership(spark, sf_dir):
    return R.key_membership(table(spark, sf_dir, "testset"), "cycle_label", ["行课期", "服务期", "未知"])


QUERIES = {
    f.__name__: f
    for f in (largest_remainder, stratified_sample, two_phase_quota, two_phase_sample, diverse_sample, quality_sample, anti_used, keyword_filter_readmit, time_of_day_filter, cycle_description, dedup_variants, delivered_again, multi_key_sort_topk, union_with_lineage, union_distinct, set_operations, histogram_share, distributions, sales_summary, quality_metrics, coverage_report, coverage_dimensions, question_rates, top_distributions, scenario_statistics, customers_per_desk, target_nodes, id_range, lead_expected_reply, customer_ordinal, hierarchical_fill, round_robin, cycle_membership)
}

_CYCLE = """cyc AS (SELECT *, CASE WHEN coalesce(cardinality(cycle_label), 0) > 0 THEN array_to_string(list_transform(list_sort(list_transform(map_entries(cycle_label), lambda e: struct_pack(r := CASE e.key WHEN '行课期' THEN 0 WHEN '服务期' THEN 1 ELSE 2 END, k := e.key, v := e.value))), lambda e: e.k || '第' || e.v || '天'), ' + ') ELSE '未知周期' END AS cycle FROM testset)"""
_REMAINDER = f"""
sizes AS (SELECT sop_l1 AS stratum, count(*) AS size FROM reflow_rows WHERE trim(sop_l1) <> '' GROUP BY 1),
share AS (SELECT *, {TOTAL} * (size / sum(size) OVER ()) AS ideal FROM sizes),
base AS (SELECT *, least(CAST(floor(ideal) AS BIGINT), size) AS base FROM share),
rem AS (SELECT *, CASE WHEN size > base THEN ideal - base ELSE -1 END AS remainder, {TOTAL} - sum(base) OVER () AS spare FROM base),
quo AS (SELECT stratum, size, CAST(base + CASE WHEN remainder > 0 THEN greatest(0, least(size - base, spare - coalesce(sum(CASE WHEN remainder > 0 THEN size - base ELSE 0 END) OVER (ORDER BY remainder DESC, stratum DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS BIGINT) AS quota FROM rem)"""
_PHASES = f"""{_CYCLE},
sizes AS (SELECT cycle AS stratum, count(*) AS size FROM cyc GROUP BY 1),
sure AS (SELECT *, least(5, size) AS sure FROM sizes),
lft AS (SELECT *, 300 - sum(sure) OVER () AS lft, sum(CASE WHEN size > sure THEN size ELSE 0 END) OVER () AS eligible FROM sure),
quo AS (SELECT stratum, size, CAST(least(size, greatest(0, sure + CASE WHEN size > sure THEN CAST(trunc(lft * (size / eligible)) AS BIGINT) ELSE 0 END)) AS BIGINT) AS quota FROM lft)"""
_DIVERSE = "div AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY message_type, sales_id ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS INT) AS place FROM testset QUALIFY place <= 3)"
_TWO = "two AS (SELECT case_id, cycle FROM cyc JOIN quo ON stratum = cycle QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) <= any_value(quota) OVER (PARTITION BY cycle))"
ORACLES = {
    "largest_remainder": f"WITH {_REMAINDER} SELECT * FROM quo",
    "stratified_sample": f"WITH {_REMAINDER} SELECT row_order, sop_l1 FROM (SELECT row_order, sop_l1, quota, row_number() OVER (PARTITION BY sop_l1 ORDER BY md5(CAST(row_order AS VARCHAR)), row_order) AS n FROM reflow_rows JOIN quo ON stratum = sop_l1) WHERE n <= quota",
    "two_phase_quota": f"WITH {_PHASES} SELECT * FROM quo",
    "two_phase_sample": f"WITH {_PHASES} SELECT case_id, cycle FROM (SELECT case_id, cycle, quota, row_number() OVER (PARTITION BY cycle ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS n FROM cyc JOIN quo ON stratum = cycle) WHERE n <= quota",
    "diverse_sample": f"WITH {_DIVERSE} SELECT * FROM div",
    "quality_sample": f"""WITH {_CYCLE}, q AS (SELECT case_id, cycle, coalesce(is_question, FALSE) AS question FROM cyc),
r AS (SELECT *, row_number() OVER (PARTITION BY cycle, question ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS n FROM q),
p AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY question DESC, md5(CAST(case_id AS VARCHAR)), case_id) AS pick FROM r WHERE n <= CASE WHEN question THEN 3 ELSE 10 END)
SELECT case_id, cycle, question FROM p WHERE pick <= 10""",
    "anti_used": f"WITH {_DIVERSE} SELECT case_id, sales_id FROM testset WHERE case_id NOT IN (SELECT case_id FROM div)",
    "keyword_filter_readmit": """WITH m AS (SELECT case_id, regexp_matches(lower(coalesce(latest_message, '')), '手机|平板|电脑|ipad|pc|设备|怎么上课|在哪上课|如何上课') AS d, regexp_matches(lower(coalesce(latest_message, '')), '<image|图片|截图') AS i, coalesce(trim(latest_message) = '我已经添加了你，现在我们可以开始聊天了。', FALSE) AS s FROM testset)
SELECT case_id FROM m WHERE NOT d AND NOT i AND NOT s UNION SELECT case_id FROM (SELECT case_id FROM m WHERE d ORDER BY md5(CAST(case_id AS VARCHAR)), case_id LIMIT 10) UNION SELECT case_id FROM (SELECT case_id FROM m WHERE i ORDER BY md5(CAST(case_id AS VARCHAR)), case_id LIMIT 5)""",
    "time_of_day_filter": "SELECT case_id FROM testset WHERE NOT coalesce(cardinality(cycle_label) = 1 AND cycle_label['行课期'] = 1 AND hour(send_time) * 60 + minute(send_time) > 1040, FALSE) AND NOT coalesce(cycle_label['行课期'] = 2, FALSE)",
    "cycle_description": f"WITH {_CYCLE} SELECT cycle AS value, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cyc GROUP BY cycle",
    "dedup_variants": """WITH c AS (SELECT *, trim(latest_message) AS m FROM testset WHERE latest_message IS NOT NULL)
SELECT 'message' AS rule, min(case_id) AS case_id FROM c GROUP BY m UNION ALL
SELECT 'composite', min(case_id) FROM c GROUP BY concat_ws('|', m, substring(coalesce(history, ''), 1, 100), sales_id, customer_id) UNION ALL
SELECT 'preferred', arg_min(case_id, struct_pack(a := NOT coalesce(is_question, FALSE), b := case_id)) FROM c GROUP BY m""",
    "delivered_again": "SELECT row_order FROM (SELECT row_order, min(row_order) OVER (PARTITION BY sales_id, sales_name, customer_id, customer_name, external_id, sender, producer, message, history, message_time, send_time, rag, thought_unit, sop_l1, sop_l2, sop_display, sop_l2_id, ai_text, sent_text, audit_match) AS first FROM reflow_rows) WHERE row_order <> first",
    "multi_key_sort_topk": "SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_shipdate FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "union_with_lineage": "SELECT 'testset' AS source_file, sales_id, customer_id, latest_message, message_type, NULL::VARCHAR AS sop_l1 FROM testset UNION ALL SELECT 'tagging_corpus', sales_id, customer_id, latest_message, NULL, sop_l1 FROM tagging_corpus",
    "union_distinct": "SELECT sales_id, customer_id FROM testset UNION SELECT sales_id, customer_id FROM tagging_corpus",
    "set_operations": "SELECT customer_id, 'both' AS part FROM (SELECT customer_id FROM testset INTERSECT SELECT customer_id FROM tagging_corpus) UNION ALL SELECT customer_id, 'testset only' FROM (SELECT customer_id FROM testset EXCEPT SELECT customer_id FROM tagging_corpus)",
    "histogram_share": "SELECT sender, value, rows, round(rows / sum(rows) OVER (PARTITION BY sender), 6) AS share FROM (SELECT sender, sop_l1 AS value, count(*) AS rows FROM reflow_rows GROUP BY 1, 2)",
    "distributions": f"""WITH {_CYCLE} SELECT 'cycle' AS dimension, cycle AS value, count(*) AS rows FROM cyc GROUP BY ALL UNION ALL SELECT 'type', message_type, count(*) FROM cyc GROUP BY ALL
UNION ALL SELECT 'question', CAST(is_question AS VARCHAR), count(*) FROM cyc GROUP BY ALL UNION ALL SELECT 'sales', sales_id, count(*) FROM cyc GROUP BY ALL""",
    "sales_summary": "SELECT sales_id, arg_min(sales_name, row_order) AS sales_name, count(*) AS all_rows, count(DISTINCT customer_id) AS customers, count(*) FILTER (WHERE sender = '客户') AS customer_rows, round(count(*) FILTER (WHERE sender = '客户') / count(DISTINCT customer_id), 6) AS rows_per_customer FROM reflow_rows GROUP BY sales_id",
    "quality_metrics": " UNION ALL ".join([
        "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM testset",
        *[f"SELECT 'present_{c}', count(*) FILTER (WHERE NOT {sql_blank(c)}) FROM testset" for c in ("history", "latest_message", "rag", "thought_unit", "node_1", "node_2", "reference_script", "expected_reply", "tags", "nickname", "batch_id", "questionnaire_title", "questionnaire_id", "rag_source")],
        *[f"SELECT 'distinct_{c}', count(DISTINCT {c}) FROM testset" for c in ("sales_id", "customer_id")], "SELECT 'true_is_question', count(*) FILTER (WHERE is_question) FROM testset",
        *[f"SELECT 'average_{c}', round(avg(len({c})) FILTER (WHERE len({c}) > 0), 4) FROM testset" for c in ("last_sales_messages", "alternative_replies")],
        *[f"SELECT 'source_{c}_' || coalesce({c}, 'none'), count(*) FROM testset GROUP BY {c}" for c in ("rag_source", "thought_unit_source")],
    ]),
    "coverage_report": f"""WITH {_PHASES},
two AS (SELECT case_id, cycle FROM (SELECT case_id, cycle, quota, row_number() OVER (PARTITION BY cycle ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS n FROM cyc JOIN quo ON stratum = cycle) WHERE n <= quota),
c AS (SELECT stratum, size, quota, (SELECT count(*) FROM two WHERE cycle = stratum) AS actual FROM quo), d AS (SELECT *, CASE WHEN quota > 0 THEN abs(actual - quota) / quota ELSE 1 END AS d FROM c)
SELECT stratum, size, quota, actual, CASE WHEN d <= 0.1 THEN 'within 10 %' WHEN d <= 0.2 THEN 'within 20 %' WHEN d <= 0.3 THEN 'within 30 %' ELSE 'over 30 %' END AS effect FROM d""",
    "coverage_dimensions": f"""WITH {_PHASES},
two AS (SELECT case_id FROM (SELECT case_id, quota, row_number() OVER (PARTITION BY cycle ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS n FROM cyc JOIN quo ON stratum = cycle) WHERE n <= quota),
l AS (SELECT case_id, unnest([struct_pack(d := 'cycle', v := cycle), struct_pack(d := 'sales_id', v := sales_id), struct_pack(d := 'message_type', v := message_type)]) AS x FROM cyc)
SELECT x.d AS dimension, x.v AS value, count(*) AS available, count(*) FILTER (WHERE case_id IN (SELECT case_id FROM two)) AS chosen, round(count(*) FILTER (WHERE case_id IN (SELECT case_id FROM two)) / count(*), 6) AS rate FROM l GROUP BY 1, 2""",
    "question_rates": "SELECT sales_id, count(*) AS rows, count(*) FILTER (WHERE is_question) AS flagged, round(count(*) FILTER (WHERE is_question) / count(*), 6) AS rate FROM testset GROUP BY sales_id",
    "top_distributions": f"""WITH {_CYCLE}, d AS (SELECT 'cycle' AS dimension, cycle AS value, count(*) AS rows FROM cyc GROUP BY ALL UNION ALL SELECT 'type', message_type, count(*) FROM cyc GROUP BY ALL
UNION ALL SELECT 'question', CAST(is_question AS VARCHAR), count(*) FROM cyc GROUP BY ALL UNION ALL SELECT 'sales', sales_id, count(*) FROM cyc GROUP BY ALL)
SELECT * FROM d QUALIFY dimension <> 'sales' OR row_number() OVER (PARTITION BY dimension ORDER BY rows DESC, value NULLS FIRST) <= 10""",
    "scenario_statistics": f"""WITH {_CYCLE} SELECT '周期-' || coalesce(cycle, '') AS scenario, count(*) AS rows FROM cyc GROUP BY cycle UNION ALL SELECT '类型-' || coalesce(message_type, ''), count(*) FROM cyc GROUP BY message_type
UNION ALL SELECT '疑问-' || coalesce(CAST(is_question AS VARCHAR), ''), count(*) FROM cyc GROUP BY is_question""",
    "customers_per_desk": "SELECT sales_id, sales_name, count(DISTINCT customer_id) AS customers FROM reflow_rows GROUP BY 1, 2",
    "target_nodes": "SELECT row_order, sop_l1 FROM reflow_rows WHERE sop_l1 IN (SELECT task_theme FROM sop_schema WHERE task_pos < 2)",
    "id_range": "SELECT row_id, file_id, msg_id FROM chat_messages WHERE file_id IS NOT NULL AND msg_id BETWEEN 10 AND 20",
    "lead_expected_reply": """WITH n AS (SELECT case_id, latest_message, lead(last_sales_messages) OVER (PARTITION BY customer_id ORDER BY message_time NULLS FIRST, case_id) AS nx FROM testset),
u AS (SELECT case_id, CASE WHEN coalesce(trim(latest_message), '') <> '' AND len(nx) > 0 THEN nx END AS nx FROM n)
SELECT case_id, coalesce(nx[1], '') AS expected, CASE WHEN len(nx) > 1 THEN array_to_string(nx[2:], '|') ELSE '' END AS alternatives FROM u""",
    "customer_ordinal": "SELECT sales_id, customer_id, min(row_order) AS first_row, CAST(row_number() OVER (PARTITION BY sales_id ORDER BY min(row_order)) AS INT) AS ordinal FROM reflow_rows WHERE sender = '客户' GROUP BY sales_id, customer_id",
    "hierarchical_fill": "SELECT sub_id, last_value(CASE WHEN sub_pos = 0 THEN task_theme END IGNORE NULLS) OVER (ORDER BY task_pos, sub_pos) AS theme FROM sop_schema",
    "round_robin": "SELECT case_id, CAST(case_id % 7 AS INT) AS turn FROM testset",
    "cycle_membership": " UNION ALL ".join(f"SELECT '{k}' AS key, greatest(count(*) FILTER (WHERE list_contains(map_keys(cycle_label), '{k}')), 1) AS rows FROM testset" for k in ("行课期", "服务期", "未知")),
}
