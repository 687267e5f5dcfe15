"""Attributes carried between the senders of one conversation: along the rows, and by equal times.

Rows need sales_id, customer_id, row_order (unique), sender and the attributes named. Nothing here gathers a
conversation into one task: see ``operators.ordered``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank, is_valid_payload, normalise_value, strip
from dialoom.operators.ordered import carry, first_per_key, running_sum
from dialoom.operators.scripts import small

CUSTOMER, AGENT, UNSENT = "客户", "CSM", "未发送"
PARTIES = (CUSTOMER, AGENT, UNSENT)
ANCHORS = (AGENT, UNSENT)
PRODUCER = "SA"
KEYS = ["sales_id", "customer_id"]
# Fixed value: script nodes of this name are passed over when a predecessor is looked for.
FOLLOW_UP = "二次跟进"


def event_time(c: Column) -> Column:
    """Times in any of the notations of the logs, to the second; null where there is none."""
    t = strip(c)
    return F.date_trunc("second", F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(t, F.lit("yyyy/MM/dd HH:mm:ss"))))


def time_text(c: Column) -> Column:
    """A time in one notation, to the second; what can't be read stays as its stripped text, nothing stays null."""
    return F.coalesce(F.date_format(event_time(c), "yyyy-MM-dd HH:mm:ss"), F.nullif(strip(c), F.lit("")))


def coalesce_labels(df: DataFrame, extracted: tuple[str, str], original: tuple[str, str], display: str) -> DataFrame:
    """The extracted labels, filled where blank: the first from its original, the second from its original, else from
    the display column."""
    filled = lambda c, *others: F.coalesce(*[F.when(~is_blank(F.col(x)), normalise_value(F.col(x)) if x != c else F.col(x)) for x in (c, *others)], F.col(c))
    return df.withColumns({extracted[0]: filled(extracted[0], original[0]), extracted[1]: filled(extracted[1], original[1], display)})


def _present(*cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | ~is_blank(F.col(c))
    return out


def trim_to_last_reply(df: DataFrame, keys: tuple[str, ...] = ("sales_id", "customer_id", "external_id")) -> DataFrame:
    """Drop conversations without an agent's row, and the rows after the last agent's or unsent one."""
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    ends = df.select(*safe, "sender", "row_order").groupBy(*names).agg(
        F.max(F.when(F.col("sender").isin(*ANCHORS), F.col("row_order"))).alias("__last"), F.count_if(F.col("sender") == AGENT).alias("__agents")
    ).filter("__agents > 0")
    keyed = df.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for n, k in zip(names, keys, strict=True)})
    return keyed.join(ends, names).filter(F.col("row_order") <= F.col("__last")).select(*df.columns)


def fill_forward(df: DataFrame) -> DataFrame:
    """Script nodes of the last agent's or unsent row on later rows that have none: the three labels as one.

    A customer row that has labels keeps them, but passes none on.
    """
    has = _present("sop_l1", "sop_l2", "sop_display")
    structured = _present("sop_l1", "sop_l2")
    label = F.struct(
        F.when(structured, F.col("sop_l1")).alias("l1"), F.when(structured, F.col("sop_l2")).alias("l2"),
        F.when(_present("sop_display"), F.col("sop_display")).otherwise(F.when(structured, F.col("sop_l2"))).alias("display"),
    )
    carried = carry(df, KEYS, "row_order", {"__from": F.when(F.col("sender").isin(*ANCHORS) & has, label)})
    fill = F.coalesce(F.col("sender").isin(*PARTIES), F.lit(False)) & ~has & F.col("__from").isNotNull()
    new = {
        c: F.when(fill & ~is_blank(F.col(f"__from.{k}")), F.col(f"__from.{k}")).otherwise(F.col(c))
        for c, k in (("sop_l1", "l1"), ("sop_l2", "l2"), ("sop_display", "display"))
    }
    return carried.withColumns(new | {"filled": fill}).drop("__from")


def plain_key(c: Column) -> Column:
    """The form in which two labels are the same: stripped, without spaces, full stops made plain."""
    return F.replace(F.replace(strip(c), F.lit(" "), F.lit("")), F.lit("．"), F.lit("."))


def predecessors(schema: DataFrame) -> DataFrame:
    """Each sub-theme with the nearest one before it in its task that is no follow-up."""
    own = F.struct(F.col("task_theme").alias("l1"), F.col("sub_theme").alias("l2"))
    before = Window.partitionBy("task_pos").orderBy("sub_pos").rowsBetween(Window.unboundedPreceding, -1)
    return schema.withColumn("previous", F.last(F.when(~F.col("sub_theme").contains(FOLLOW_UP), own), ignorenulls=True).over(before))


def _schema_keys(schema: DataFrame) -> DataFrame:
    """(key, place, the schema row): every written form of a sub-theme. The schema is a small fixed table."""
    forms = F.explode(F.array_distinct(F.filter(F.array(plain_key("sub_theme"), plain_key("sub_theme_alt")), lambda x: x.isNotNull())))
    return schema.select("*", forms.alias("key"), (F.col("task_pos") * 1000 + F.col("sub_pos")).alias("place"))


def look_up_schema(df: DataFrame, schema: DataFrame, label: Column, task: Column, fields: list[str]) -> DataFrame:
    """Add ``hit``: the schema's fields for a label, of the same task if there is one, else the first."""
    keyed = _schema_keys(schema)
    by_key = keyed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "task_theme", *[f for f in fields if f != "task_theme"]))).alias("__all"))
    joined = df.withColumn("__key", plain_key(label)).withColumn("__task", normalise_value(task)).join(small(by_key), F.col("__key") == by_key["key"], "left").drop("key")
    same = F.filter("__all", lambda e: e["task_theme"] == F.col("__task"))
    hit = F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at("__all", F.lit(1)))
    return joined.withColumn("hit", hit).drop("__all", "__key", "__task")


def fill_back(df: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows before a conversation's first anchor get the predecessor of that anchor's node.

    Looking ahead, a row of a party that already has labels stops the filling; other senders don't.
    """
    has = _present("sop_l1", "sop_l2", "sop_display")
    anchor = F.col("sender").isin(*ANCHORS) & has
    label = F.struct(anchor.alias("anchor"), F.col("sop_l1").alias("l1"), F.col("sop_l2").alias("l2"), F.col("sop_display").alias("display"))
    seen = carry(df, KEYS, "row_order", {"__before": F.when(anchor, F.lit(1))}, inclusive=True)
    ahead = carry(seen, KEYS, "row_order", {"__next": F.when(F.col("sender").isin(*PARTIES) & has, label)}, ahead=True)
    name = F.when(~is_blank(F.col("__next.l2")), F.col("__next.l2")).when(~is_blank(F.col("__next.display")), F.col("__next.display")).otherwise(F.col("__next.l1"))
    found = look_up_schema(ahead, predecessors(schema), name, F.col("__next.l1"), ["task_theme", "sub_theme", "previous"])
    fill = F.coalesce(F.col("sender").isin(*PARTIES), F.lit(False)) & ~has & F.col("__before").isNull() & F.coalesce(F.col("__next.anchor"), F.lit(False)) & F.col("hit.previous").isNotNull()
    new = {c: F.when(fill, F.col(f"hit.previous.{k}")).otherwise(F.col(c)) for c, k in (("sop_l1", "l1"), ("sop_l2", "l2"), ("sop_display", "l2"))}
    return found.withColumns(new | {"backfilled": fill}).drop("__before", "__next", "hit")


def enrich(df: DataFrame, schema: DataFrame) -> DataFrame:
    """Ids and the official wording of a row's node; the task's name where it has none."""
    found = look_up_schema(df, schema, F.col("sop_l2"), F.col("sop_l1"), ["task_theme", "task_id", "sub_theme", "sub_id"])
    hit = F.col("hit").isNotNull() & ~is_blank(F.col("sop_l2"))
    return found.withColumns({
        "task_id": F.when(hit, F.col("hit.task_id")), "sub_id": F.when(hit, F.col("hit.sub_id")),
        "l1": F.when(hit & is_blank(F.col("sop_l1")), F.col("hit.task_theme")).otherwise(F.col("sop_l1")),
        "l2": F.when(hit, F.col("hit.sub_theme")).otherwise(F.col("sop_l2")),
    }).drop("hit")


def trim_follow_up_id(node: Column, node_id: Column) -> Column:
    """Of a follow-up node's id only what stands before the first hyphen."""
    return F.when(F.coalesce(node.contains(FOLLOW_UP), F.lit(False)), strip(F.substring_index(node_id, "-", 1))).otherwise(node_id)


def payloads_by_time(df: DataFrame) -> DataFrame:
    """Customer rows take the payloads of the agent's row of the same second, else of the unsent one.

    Only rows made by the assistant count. ``rag`` is filled where blank, ``thought_unit`` replaced where the other
    has one; the sources say where each came from.
    """
    timed = df.withColumn("__at", event_time(F.col("message_time")))
    made = F.upper(strip(F.coalesce("producer", F.lit("")))) == PRODUCER
    source = timed.filter(F.col("sender").isin(*ANCHORS) & made & F.col("__at").isNotNull())
    best = first_per_key(
        source.select(*KEYS, "__at", F.col("sender").alias("a_sender"), F.col("rag").alias("a_rag"), F.col("thought_unit").alias("a_unit"), "row_order"),
        [*KEYS, "__at"], [F.when(F.col("a_sender") == AGENT, 0).otherwise(1), F.col("row_order")],
    ).drop("row_order").withColumn("__customer", F.lit(CUSTOMER))
    rows = timed.withColumn("__customer", F.col("sender"))
    joined = rows.join(best, [*KEYS, "__at", "__customer"], "left")
    take_rag, take_unit = is_blank(F.col("rag")) & ~is_blank(F.col("a_rag")), ~is_blank(F.col("a_unit"))
    return joined.select(
        *[c for c in df.columns if c not in ("rag", "thought_unit")],
        F.when(take_rag, F.col("a_rag")).otherwise(F.col("rag")).alias("rag"), F.when(take_unit, F.col("a_unit")).otherwise(F.col("thought_unit")).alias("thought_unit"),
        F.when(take_rag, F.col("a_sender")).when(~is_blank(F.col("rag")), F.lit("原始")).otherwise("").alias("rag_source"),
        F.when(take_unit, F.col("a_sender")).when(~is_blank(F.col("thought_unit")), F.lit("原始")).otherwise("").alias("thought_unit_source"),
    )


CYCLE_IN_TEXT = r"""['"]周期标签['"]\s*:\s*(\{[^{}]*\})"""


def cycle_in_payload(rag: Column) -> Column:
    """The cycle label that a payload's text holds, as a map; null where there is none."""
    found = F.regexp_extract(F.replace(rag, F.lit('\\"'), F.lit('"')), CYCLE_IN_TEXT, 1)
    return F.when(found != "", F.from_json(F.replace(found, F.lit("'"), F.lit('"')), "map<string,int>"))


def same_day_payload(df: DataFrame, drop_cycle: tuple[str, int] = ("行课期", 2)) -> DataFrame:
    """Customer rows with the day's payload: the agent's first valid one, else the first unsent one with a label.

    Customers without either, and those whose label is ``drop_cycle``, are left out.
    """
    sent, asked = F.to_date(event_time(F.col("send_time"))), F.to_date(event_time(F.col("message_time")))
    cycle = cycle_in_payload(F.col("rag"))
    valid = is_valid_payload(F.col("rag"))
    day = F.when(F.col("sender") == AGENT, sent).when(F.col("sender") == UNSENT, F.coalesce(sent, asked))
    usable = df.filter(F.col("sender").isin(*ANCHORS) & valid).select(*KEYS, day.alias("day"), F.col("sender").alias("rag_source"), F.col("rag").alias("day_rag"), cycle.alias("cycle"), "row_order")
    usable = usable.filter(F.col("day").isNotNull() & ((F.col("rag_source") == AGENT) | F.col("cycle").isNotNull()))
    chosen = first_per_key(usable, [*KEYS, "day"], [F.when(F.col("rag_source") == AGENT, 0).otherwise(1), F.col("row_order")]).drop("row_order")
    customers = df.filter(F.col("sender") == CUSTOMER).withColumn("day", asked)
    return customers.join(chosen, [*KEYS, "day"]).filter(~F.coalesce(F.col("cycle")[drop_cycle[0]] == drop_cycle[1], F.lit(False)))


def first_reply(df: DataFrame) -> DataFrame:
    """Customer rows with the first agent's row of the same customer and the same written time."""
    replies = df.filter(F.col("sender") == AGENT).select("customer_id", "message_time", F.col("ai_text").alias("reply_ai"), F.col("sent_text").alias("reply_sent"), F.col("audit_match").alias("reply_audit"), "row_order")
    first = first_per_key(replies.filter("message_time <> ''"), ["customer_id", "message_time"], [F.col("row_order")]).drop("row_order")
    return df.filter(F.col("sender") == CUSTOMER).join(first, ["customer_id", "message_time"], "left")


def all_replies(df: DataFrame) -> DataFrame:
    """Customer rows with the texts of all agents' rows of the same conversation and second, joined in order."""
    timed = df.withColumn("__at", event_time(F.col("message_time")))
    texts = timed.filter((F.col("sender") == AGENT) & ~is_blank(F.col("sent_text")) & F.col("__at").isNotNull()).groupBy(*KEYS, "__at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_order", "sent_text"))), lambda x: x["sent_text"]), "；").alias("replies")
    )
    return timed.filter(F.col("sender") == CUSTOMER).join(texts, [*KEYS, "__at"], "left").drop("__at")


def nearest_unused(df: DataFrame) -> DataFrame:
    """Customer rows without a thought unit take that of the nearest row of an equal message, each used once.

    Customers are served in order; distances are counted in the customer's own rows. The rule is sequential, so one
    task serves one (customer, message); of its rows it gets positions only.
    """
    placed = running_sum(df, ["customer_id"], "row_order", F.lit(1), "position")
    empty = F.coalesce(F.col("thought_unit"), F.lit("")) == ""
    asks = (F.col("sender") == CUSTOMER) & empty
    gives = F.col("sender").isin(*ANCHORS) & F.col("thought_unit").isNotNull() & (F.col("thought_unit") != "nan")
    slim = placed.filter((asks | gives) & F.col("message").isNotNull()).select("customer_id", "message", "row_order", "position", asks.alias("asks"))

    def serve(group: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left

        group = group.sort_values("position")
        free = group[~group["asks"]][["position", "row_order"]].values.tolist()
        out = []
        for position, row in group[group["asks"]][["position", "row_order"]].values.tolist():
            i = bisect_left(free, [position, -1])
            near = [j for j in (i - 1, i) if 0 <= j < len(free)]
            if near:
                j = min(near, key=lambda j: (abs(free[j][0] - position), j))
                out.append((int(row), int(free.pop(j)[1])))
        return pd.DataFrame(out, columns=["row_order", "from_row"])

    pairs = slim.groupBy("customer_id", "message").applyInPandas(serve, "row_order long, from_row long")
    given = df.select(F.col("row_order").alias("from_row"), F.col("thought_unit").alias("given"), F.col("sender").alias("given_by"))
    return pairs.join(given, "from_row").select("row_order", "from_row", "given_by", "given")


def map_ids(labels: DataFrame, schema: DataFrame) -> DataFrame:
    """Ids of (l1, l2) labels: equal names, else the only sub-theme of the task that begins with the label, else
    the only one that the label begins with; null where neither tells."""
    own = schema.select(F.col("task_theme").alias("l1"), F.col("sub_theme").alias("theme"), F.col("sub_id"))
    tasks = own.groupBy("l1").agg(F.collect_list(F.struct("theme", "sub_id")).alias("subs"))
    joined = labels.join(small(tasks), "l1", "left")
    same = F.filter("subs", lambda s: s["theme"] == F.col("l2"))
    longer = F.filter("subs", lambda s: s["theme"].startswith(F.col("l2")))
    shorter = F.filter("subs", lambda s: F.col("l2").startswith(s["theme"]))
    one = lambda a: F.when(F.size(a) == 1, F.element_at(a, 1)["sub_id"])
    return joined.withColumn("sub_id", F.coalesce(F.try_element_at(same, F.lit(1))["sub_id"], one(longer), F.when(F.size(longer) == 0, one(shorter)))).drop("subs")
