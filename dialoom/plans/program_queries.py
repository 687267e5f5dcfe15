"""Whole programs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.plans import registry
from dialoom.plans.propagation_queries import _TIME
from dialoom.plans.propagation_queries import blank as sql_blank
from dialoom.session import table


def reflow_customers(spark, sf_dir):
    tables = {"rows": table(spark, sf_dir, "reflow_rows"), "schema": table(spark, sf_dir, "sop_schema")}
    return registry.run(spark, "process_reflow", tables)["customers"].select("row_order", "sop_l1", "sop_l2", "sub_id", "rag_source", "thought_unit_source", "is_question")


def standard_cases(spark, sf_dir):
    out = registry.run(spark, "preprocess_client_cases", {"rows": table(spark, sf_dir, "reflow_rows")})
    return out["cases"].select("row_order", "day", "rag_source", "given_by", "reply_sent")


def ai_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "reflow_rows")
    turns = rows.filter("sender = '客户'").select("row_order", "customer_id", "message_time")
    return registry.run(spark, "map_ai_turns", {"turns": turns, "replies": rows.select("row_order", "customer_id", "message_time", "producer", "ai_text")})["turns"].select("row_order", "ai_texts")


QUERIES = {f.__name__: f for f in (reflow_customers, standard_cases, ai_turns)}
ORACLES = {
    "ai_turns": f"""WITH t AS (SELECT *, {_TIME.format('message_time')} AS ts FROM reflow_rows),
f AS (SELECT customer_id, ts, trim(ai_text) AS a, min(row_order) AS n FROM t WHERE upper(trim(producer)) = 'SA' AND NOT {sql_blank('ai_text')} AND ts IS NOT NULL GROUP BY ALL),
g AS (SELECT customer_id, ts, string_agg(a, ' || ' ORDER BY n) AS ai_texts FROM f GROUP BY ALL)
SELECT t.row_order, g.ai_texts FROM t LEFT JOIN g USING (customer_id, ts) WHERE sender = '客户'""",
}
