"""Queries on raw reflow rows: trimming, filling and joining within a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import propagation as P
from dialoom.operators.ordered import running_sum
from dialoom.session import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reflow_rows")


def terminal_anchor_trim(spark, sf_dir):
    return P.trim_to_last_reply(_rows(spark, sf_dir).select("row_order", "sales_id", "customer_id", "external_id", "sender")).select("row_order")


_LABELS = ("row_order", "sales_id", "customer_id", "sender", "sop_l1", "sop_l2", "sop_display")


def anchor_fill_forward(spark, sf_dir):
    return P.fill_forward(_rows(spark, sf_dir).select(*_LABELS)).select("row_order", "sop_l1", "sop_l2", "sop_display", "filled")


def anchor_back_fill(spark, sf_dir):
    out = P.fill_back(_rows(spark, sf_dir).select(*_LABELS), table(spark, sf_dir, "sop_schema"))
    return out.select("row_order", "sop_l1", "sop_l2", "sop_display", "backfilled")


def propagation_totals(spark, sf_dir):
    filled = P.fill_forward(_rows(spark, sf_dir).select(*_LABELS))
    return filled.groupBy("sender").agg(F.count_if("filled").alias("filled_rows"), F.count(F.lit(1)).alias("all_rows"))


def schema_enrich(spark, sf_dir):
    out = P.enrich(_rows(spark, sf_dir).select("row_order", "sop_l1", "sop_l2", "sop_l2_id"), table(spark, sf_dir, "sop_schema"))
    return out.select("row_order", "l1", "l2", "task_id", P.trim_follow_up_id(F.col("l2"), F.col("sub_id")).alias("sub_id"))


def anchor_priority_join(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("row_order", "sales_id", "customer_id", "sender", "producer", "message_time", "rag", "thought_unit")
    return P.payloads_by_time(rows).select("row_order", "rag", "thought_unit", "rag_source", "thought_unit_source")


def same_day_join(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("row_order", "sales_id", "customer_id", "sender", "message_time", "send_time", "rag")
    return P.same_day_payload(rows).select("row_order", "day", "rag_source", "day_rag")


def first_match_join(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("row_order", "customer_id", "sender", "message_time", "ai_text", "sent_text", "audit_match")
    return P.first_reply(rows).select("row_order", "reply_ai", "reply_sent", "reply_audit")


def all_match_concat_join(spark, sf_dir):
    return P.all_replies(_rows(spark, sf_dir).select("row_order", "sales_id", "customer_id", "sender", "message_time", "sent_text")).select("row_order", "replies")


def greedy_nearest_join(spark, sf_dir):
    return P.nearest_unused(_rows(spark, sf_dir).select("row_order", "customer_id", "sender", "message", "thought_unit"))


def prefix_fallback_join(spark, sf_dir):
    """Ids of every row's label: as it stands, of every third row shortened, of every third row with an addition."""
    turn = F.col("row_order") % 3
    label = F.when(turn == 0, F.col("sop_l2")).when(turn == 1, F.substring("sop_l2", 1, 5)).otherwise(F.concat("sop_l2", F.lit("（补）")))
    labels = _rows(spark, sf_dir).select("row_order", F.col("sop_l1").alias("l1"), label.alias("l2")).filter("l1 is not null and l2 is not null")
    return P.map_ids(labels, table(spark, sf_dir, "sop_schema")).select("row_order", "l2", "sub_id")


def row_positions(spark, sf_dir):
    """Each row's ordinal within its customer, computed bucket by bucket."""
    return running_sum(_rows(spark, sf_dir).select("row_order", "customer_id"), ["customer_id"], "row_order", F.lit(1), "position").select("row_order", "position")


def time_texts(spark, sf_dir):
    """Message times in one notation."""
    return table(spark, sf_dir, "reflow_rows").select("row_order", P.time_text(F.col("message_time")).alias("at"))


def label_cascade(spark, sf_dir):
    """Labels of agents' rows blanked and filled again from the original and display columns."""
    rows = table(spark, sf_dir, "reflow_rows").select("row_order", "sop_l1", "sop_l2", "sop_display", F.lit("").alias("l1"), F.when(F.col("row_order") % 3 == 0, F.col("sop_l2")).alias("l2"))
    return P.coalesce_labels(rows, ("l1", "l2"), ("sop_l1", "sop_l2"), "sop_display").select("row_order", "l1", "l2")


QUERIES = {
    f.__name__: f
    for f in (terminal_anchor_trim, anchor_fill_forward, anchor_back_fill, propagation_totals, schema_enrich, anchor_priority_join, same_day_join, first_match_join, all_match_concat_join, greedy_nearest_join, prefix_fallback_join, row_positions, time_texts, label_cascade)
}

_BLANK = r"(coalesce(regexp_matches({0}, '^[\s\p{{Z}}]*((?i:nan|none)|\[\]|\{{\}})?[\s\p{{Z}}]*$'), TRUE))"


def blank(c: str) -> str:
    return _BLANK.format(c)


_TIME = "date_trunc('second', coalesce(try_strptime({0}, ['%Y-%m-%d %H:%M:%S.%g', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M', '%Y/%m/%d %H:%M:%S']), NULL))"
_HAS = f"(NOT {blank('sop_l1')} OR NOT {blank('sop_l2')} OR NOT {blank('sop_display')})"
_STRUCT = f"(NOT {blank('sop_l1')} OR NOT {blank('sop_l2')})"
_FORWARD = f"""
WITH marked AS (
  SELECT row_order, sales_id, customer_id, sender, sop_l1, sop_l2, sop_display, {_HAS} AS has,
    CASE WHEN sender IN ('CSM', '未发送') AND {_HAS} THEN struct_pack(
      l1 := CASE WHEN {_STRUCT} THEN sop_l1 END, l2 := CASE WHEN {_STRUCT} THEN sop_l2 END,
      d := CASE WHEN NOT {blank('sop_display')} THEN sop_display WHEN {_STRUCT} THEN sop_l2 END) END AS anchor
  FROM reflow_rows),
carried AS (
  SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY sales_id, customer_id ORDER BY row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM marked),
decided AS (SELECT *, coalesce(sender IN ('客户', 'CSM', '未发送') AND NOT has AND prev IS NOT NULL, FALSE) AS f FROM carried)
"""
_PLAIN = "replace(replace(trim({0}), ' ', ''), '．', '.')"
_KEYS = f"""
keys AS (SELECT DISTINCT k, task_pos * 1000 + sub_pos AS place, * EXCLUDE (k) FROM (
  SELECT *, unnest([{_PLAIN.format('sub_theme')}, {_PLAIN.format('sub_theme_alt')}]) AS k FROM sop_schema) WHERE k IS NOT NULL)"""
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"
ORACLES = {
    "time_texts": f"SELECT row_order, coalesce(strftime({_TIME.format(_TRIM.format('message_time'))}, '%Y-%m-%d %H:%M:%S'), nullif({_TRIM.format('message_time')}, '')) AS at FROM reflow_rows",
    "label_cascade": f"""WITH r AS (SELECT row_order, sop_l1, sop_l2, sop_display, CASE WHEN row_order % 3 = 0 THEN sop_l2 END AS b FROM reflow_rows)
SELECT row_order, CASE WHEN NOT {blank('sop_l1')} THEN {_TRIM.format('sop_l1')} ELSE '' END AS l1,
  CASE WHEN NOT {blank('b')} THEN b WHEN NOT {blank('sop_l2')} THEN {_TRIM.format('sop_l2')} WHEN NOT {blank('sop_display')} THEN {_TRIM.format('sop_display')} ELSE b END AS l2 FROM r""",
    "terminal_anchor_trim": """
WITH ends AS (SELECT sales_id, customer_id, external_id, max(row_order) FILTER (WHERE sender IN ('CSM', '未发送')) AS last FROM reflow_rows GROUP BY ALL HAVING count(*) FILTER (WHERE sender = 'CSM') > 0)
SELECT r.row_order FROM reflow_rows r JOIN ends e ON r.sales_id IS NOT DISTINCT FROM e.sales_id AND r.customer_id IS NOT DISTINCT FROM e.customer_id AND r.external_id IS NOT DISTINCT FROM e.external_id AND r.row_order <= e.last""",
    "anchor_fill_forward": _FORWARD + f"""
SELECT row_order, CASE WHEN f AND NOT {blank('prev.l1')} THEN prev.l1 ELSE sop_l1 END AS sop_l1, CASE WHEN f AND NOT {blank('prev.l2')} THEN prev.l2 ELSE sop_l2 END AS sop_l2,
  CASE WHEN f AND NOT {blank('prev.d')} THEN prev.d ELSE sop_display END AS sop_display, f AS filled FROM decided""",
    "propagation_totals": _FORWARD + "SELECT sender, count(*) FILTER (WHERE f) AS filled_rows, count(*) AS all_rows FROM decided GROUP BY sender",
    "anchor_back_fill": f"""
WITH {_KEYS.strip()},
prevs AS (SELECT *, last_value(CASE WHEN sub_theme NOT LIKE '%二次跟进%' THEN struct_pack(l1 := task_theme, l2 := sub_theme) END IGNORE NULLS) OVER (PARTITION BY task_pos ORDER BY sub_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM sop_schema),
marked AS (SELECT row_order, sales_id, customer_id, sender, sop_l1, sop_l2, sop_display, {_HAS} AS has FROM reflow_rows),
seen AS (SELECT *,
  max(CASE WHEN sender IN ('CSM', '未发送') AND has THEN 1 END) OVER (PARTITION BY sales_id, customer_id ORDER BY row_order) AS before,
  first_value(CASE WHEN sender IN ('客户', 'CSM', '未发送') AND has THEN struct_pack(a := sender <> '客户', l1 := sop_l1, l2 := sop_l2, d := sop_display) END IGNORE NULLS)
    OVER (PARTITION BY sales_id, customer_id ORDER BY row_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM marked),
named AS (SELECT *, CASE WHEN NOT {blank('nxt.l2')} THEN nxt.l2 WHEN NOT {blank('nxt.d')} THEN nxt.d ELSE nxt.l1 END AS name FROM seen),
hits AS (
  SELECT n.row_order, arg_min(p.previous, CASE WHEN k.task_theme = trim(n.nxt.l1) THEN 0 ELSE 100000 END + k.place) AS previous
  FROM named n JOIN keys k ON k.k = {_PLAIN.format('n.name')} JOIN (SELECT sub_id AS i, coalesce(previous, struct_pack(l1 := NULL::VARCHAR, l2 := NULL::VARCHAR)) AS previous FROM prevs) p ON p.i = k.sub_id GROUP BY 1),
decided AS (SELECT n.*, h.previous, coalesce(n.sender IN ('客户', 'CSM', '未发送') AND NOT n.has AND n.before IS NULL AND n.nxt.a AND h.previous.l2 IS NOT NULL, FALSE) AS f FROM named n LEFT JOIN hits h USING (row_order))
SELECT row_order, CASE WHEN f THEN previous.l1 ELSE sop_l1 END AS sop_l1, CASE WHEN f THEN previous.l2 ELSE sop_l2 END AS sop_l2, CASE WHEN f THEN previous.l2 ELSE sop_display END AS sop_display, f AS backfilled FROM decided""",
    "schema_enrich": f"""
WITH {_KEYS.strip()},
hits AS (SELECT r.row_order, arg_min(struct_pack(t := k.task_theme, ti := k.task_id, s := k.sub_theme, si := k.sub_id), CASE WHEN k.task_theme = trim(r.sop_l1) THEN 0 ELSE 100000 END + k.place) AS h
  FROM reflow_rows r JOIN keys k ON k.k = {_PLAIN.format('r.sop_l2')} WHERE NOT {blank('r.sop_l2')} GROUP BY 1),
out AS (SELECT r.row_order, CASE WHEN h IS NOT NULL AND {blank('sop_l1')} THEN h.t ELSE sop_l1 END AS l1, CASE WHEN h IS NOT NULL THEN h.s ELSE sop_l2 END AS l2, h.ti AS task_id, h.si AS si FROM reflow_rows r LEFT JOIN hits USING (row_order))
SELECT row_order, l1, l2, task_id, CASE WHEN l2 LIKE '%二次跟进%' THEN split_part(si, '-', 1) ELSE si END AS sub_id FROM out""",
    "anchor_priority_join": f"""
WITH timed AS (SELECT *, {_TIME.format('message_time')} AS ts FROM reflow_rows),
best AS (SELECT sales_id, customer_id, ts, arg_min(struct_pack(s := sender, r := rag, u := thought_unit), struct_pack(p := CASE WHEN sender = 'CSM' THEN 0 ELSE 1 END, o := row_order)) AS b
  FROM timed WHERE sender IN ('CSM', '未发送') AND upper(trim(producer)) = 'SA' AND ts IS NOT NULL GROUP BY ALL),
j AS (SELECT t.*, CASE WHEN t.sender = '客户' THEN b END AS b FROM timed t LEFT JOIN best USING (sales_id, customer_id, ts)),
d AS (SELECT *, {blank('rag')} AND b IS NOT NULL AND NOT {blank('b.r')} AS tr, b IS NOT NULL AND NOT {blank('b.u')} AS tu FROM j)
SELECT row_order, CASE WHEN tr THEN b.r ELSE rag END AS rag, CASE WHEN tu THEN b.u ELSE thought_unit END AS thought_unit,
  CASE WHEN tr THEN b.s WHEN NOT {blank('rag')} THEN '原始' ELSE '' END AS rag_source, CASE WHEN tu THEN b.s WHEN NOT {blank('thought_unit')} THEN '原始' ELSE '' END AS thought_unit_source FROM d""",
    "same_day_join": rf"""
WITH timed AS (SELECT *, CAST({_TIME.format('send_time')} AS DATE) AS sd, CAST({_TIME.format('message_time')} AS DATE) AS md, regexp_extract(replace(rag, '\"', '"'), '[''"]周期标签[''"]\s*:\s*(\{{[^{{}}]*\}})', 1) AS cyc FROM reflow_rows),
usable AS (SELECT sales_id, customer_id, CASE WHEN sender = 'CSM' THEN sd ELSE coalesce(sd, md) END AS day, sender, rag, cyc, row_order FROM timed
  WHERE sender IN ('CSM', '未发送') AND lower(trim(coalesce(rag, ''))) NOT IN ('', 'nan', '[]') AND (sender = 'CSM' OR cyc <> '')),
best AS (SELECT sales_id, customer_id, day, arg_min(struct_pack(s := sender, r := rag, c := cyc), struct_pack(p := CASE WHEN sender = 'CSM' THEN 0 ELSE 1 END, o := row_order)) AS b FROM usable WHERE day IS NOT NULL GROUP BY ALL)
SELECT t.row_order, t.md AS day, b.s AS rag_source, b.r AS day_rag FROM timed t JOIN best ON t.sales_id = best.sales_id AND t.customer_id = best.customer_id AND t.md = best.day
WHERE t.sender = '客户' AND NOT regexp_matches(b.c, '行课期[''"]\s*:\s*2\s*[,}}]')""",
    "first_match_join": """
WITH f AS (SELECT customer_id, message_time, arg_min(struct_pack(a := ai_text, s := sent_text, m := audit_match), row_order) AS b FROM reflow_rows WHERE sender = 'CSM' AND message_time <> '' GROUP BY ALL)
SELECT r.row_order, b.a AS reply_ai, b.s AS reply_sent, b.m AS reply_audit FROM reflow_rows r LEFT JOIN f USING (customer_id, message_time) WHERE r.sender = '客户'""",
    "all_match_concat_join": f"""
WITH timed AS (SELECT *, {_TIME.format('message_time')} AS ts FROM reflow_rows),
g AS (SELECT sales_id, customer_id, ts, string_agg(sent_text, '；' ORDER BY row_order) AS replies FROM timed WHERE sender = 'CSM' AND NOT {blank('sent_text')} GROUP BY ALL)
SELECT t.row_order, g.replies FROM timed t LEFT JOIN g USING (sales_id, customer_id, ts) WHERE t.sender = '客户'""",
    "prefix_fallback_join": """
WITH l AS (SELECT row_order, sop_l1 AS l1, CASE row_order % 3 WHEN 0 THEN sop_l2 WHEN 1 THEN substring(sop_l2, 1, 5) ELSE sop_l2 || '（补）' END AS l2 FROM reflow_rows WHERE sop_l1 IS NOT NULL AND sop_l2 IS NOT NULL),
c AS (SELECT row_order, l2, max(sub_id) FILTER (WHERE sub_theme = l2) AS same, count(*) FILTER (WHERE starts_with(sub_theme, l2)) AS nl, max(sub_id) FILTER (WHERE starts_with(sub_theme, l2)) AS lo,
  count(*) FILTER (WHERE starts_with(l2, sub_theme)) AS ns, max(sub_id) FILTER (WHERE starts_with(l2, sub_theme)) AS sh FROM l LEFT JOIN sop_schema ON task_theme = l1 GROUP BY ALL)
SELECT row_order, l2, coalesce(same, CASE WHEN nl = 1 THEN lo END, CASE WHEN nl = 0 AND ns = 1 THEN sh END) AS sub_id FROM c""",
    "row_positions": "SELECT row_order, row_number() OVER (PARTITION BY customer_id ORDER BY row_order) AS position FROM reflow_rows",
}
