"""Fields of the nested payloads, one row per case, from the labelled nodes of ``operators.nested``.

A payload that can't be decoded has no nodes; fields with a fallback are then looked for in its text. Cases whose
payload holds nothing of the kind are not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators import nested

# The stores that recall items come from, and the names of their fields.
STORES = {
    "用户信息库": {"batch_id": "批次ID", "cycle_batch_id": "周期批次ID", "tags": "标签", "nickname": "用户昵称"},
    "调查问卷库": {"questionnaire_title": "问卷标题", "questionnaire_id": "问卷ID"},
    "试卷库": {"paper_name": "试卷名称", "paper_id": "试卷ID", "score": "分数", "exam_day": "天", "accuracy": "正确率"},
    "销售信息库": {
        "live_time": "直播课时间", "activate_link": "激活直播课链接", "archive_link": "学习档案链接", "mobile_link": "手机平板上课链接", "pc_link": "电脑上课链接", "tips_link": "秒题技巧链接",
        "enrol_link": "报课链接", "trial_link": "试学链接",
    },
}
ENTRY_FIELDS = {out: name for fields in STORES.values() for out, name in fields.items()}
#: Fields that are looked for in the text where the structure gives none.
FALLBACK = ("batch_id", "cycle_batch_id", "questionnaire_title", "questionnaire_id", "tags", "nickname", *STORES["销售信息库"])
# Names of a unit's fields.
TASK_KEYS = ("task_theme", "taskTheme", "task_theme_name")
SUB_TASK_KEYS = ("sub_task_theme", "sub_task_name", "subTaskTheme", "subTaskName")
FORCED = "强遵循"
#: Recall items inside a thought unit, which hold the cycle label of newer logs.
UNIT_RECALL = {"thought_unit": [("unit", ((),))], "unit": [("recall", (("rag_chat_result",),))], "recall": [("entry", (("content",),))]}


def _kept(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value)


def _first(value: Column, place: str = "pre") -> Column:
    """The first non-empty value in document order."""
    return F.min_by(_kept(value), F.when(_kept(value).isNotNull(), F.col(place)))


def _last(value: Column, place: str = "pre") -> Column:
    return F.max_by(_kept(value), F.when(_kept(value).isNotNull(), F.col(place)))


def _with_store(nodes: DataFrame) -> DataFrame:
    """The nodes below a recall item, with its store (``db_name``): the last item that began before and contains them."""
    within = Window.partitionBy("row_no", "payload").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    item = F.when(F.col("kind") == "recall", F.struct("post", F.get_json_object("fields", "$.db_name").alias("store")))
    return nodes.withColumn("__item", F.last(item, ignorenulls=True).over(within)).filter("kind <> 'recall' and __item.post > post").withColumn("store", F.col("__item.store")).drop("__item")


def entry_fields(df: DataFrame, key: str, last_wins: tuple[str, ...] = ()) -> DataFrame:
    """key, ENTRY_FIELDS and questionnaire_content: of each the first value among the entries of its store in the recall
    payload (the last one for the names in ``last_wins``). ``questionnaire_content`` is JSON, or the text as it stands."""
    nodes = _with_store(nested.label_nodes(df, key, payloads=["rag"], kinds=["recall", "entry", "question"])).withColumn("f", F.from_json("fields", "map<string,string>"))
    pick = lambda out: _last if out in last_wins else _first
    entry, asked = F.col("kind") == "entry", (F.col("kind") == "question") & (F.col("store") == "调查问卷库")
    columns = [pick(out)(F.when(entry & (F.col("store") == store), F.col("f")[name])).alias(out) for store, fields in STORES.items() for out, name in fields.items()]
    questions = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(asked, F.struct("pre", "fields")))), lambda x: x["fields"]), ",")
    written = _first(F.when(entry & (F.col("store") == "调查问卷库"), F.col("f")["问卷内容"]))
    content = F.when(questions != "", F.concat(F.lit("["), questions, F.lit("]"))).otherwise(written)
    found = nodes.groupBy(F.col("key").alias(key)).agg(*columns, content.alias("questionnaire_content"))
    in_text = lambda name: F.nullif(F.regexp_extract(F.col("rag").cast("string"), rf"[\\'\"]{name}[\\'\"]+\s*:\s*[\\]*['\"]([^'\"\\]+)", 1), F.lit(""))
    texts = df.select(key, *[in_text(ENTRY_FIELDS[c]).alias(f"__{c}") for c in FALLBACK]).filter(F.coalesce(*[F.col(f"__{c}") for c in FALLBACK]).isNotNull())
    once = texts.groupBy(key).agg(*[F.min(f"__{c}").alias(f"__{c}") for c in FALLBACK])
    joined = found.join(once, key, "full")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in FALLBACK}).drop(*[f"__{c}" for c in FALLBACK])


def unit_labels(df: DataFrame, key: str) -> DataFrame:
    """key, l1, l2: the first task and sub-task named in a unit or any object inside it; forced, has_answer, knowledge:
    its flags; node_1, node_2: the nodes of its history request; reference_script: the first one, a list as JSON."""
    nodes = nested.label_nodes(df, key, payloads=["thought_unit"], kinds=["unit", "object", "answer"])
    f = nodes.withColumn("f", F.from_json("fields", "map<string,string>"))
    any_of = lambda names: F.coalesce(*[_kept(F.col("f")[n]) for n in names])
    labelled, history = F.col("kind") != "answer", F.col("field") == "rag_history_chat_request_body"
    script = F.when((F.col("kind") == "unit") & ~F.col("f")["reference_script"].isin("[]", "null"), F.col("f")["reference_script"])
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return f.groupBy(F.col("key").alias(key)).agg(
        _first(F.when(labelled, any_of(TASK_KEYS))).alias("l1"), _first(F.when(labelled, any_of(SUB_TASK_KEYS))).alias("l2"),
        flag((F.col("kind") == "unit") & (F.col("f")["endpoint_step"] == FORCED)).alias("forced"), flag(F.col("kind") == "answer").alias("has_answer"),
        flag((F.col("kind") == "unit") & (F.col("f")["knowledge_scenario_result"] == "true")).alias("knowledge"),
        _first(F.when(history, F.col("f")["node_1st"])).alias("node_1"), _first(F.when(history, F.col("f")["node_2nd"])).alias("node_2"), _first(script).alias("reference_script"),
    )


def unit_cycle_label(df: DataFrame, key: str) -> DataFrame:
    """key, cycle_label: the first cycle label among the user entries of the recall items in a thought unit, as text."""
    nodes = _with_store(nested.label_nodes(df, key, payloads=["thought_unit"], kinds=["recall", "entry", "object"], rules=UNIT_RECALL)).filter("store = '用户信息库'")
    value = F.when(F.col("kind") == "entry", F.get_json_object("fields", "$.周期标签")).when(F.col("field") == "周期标签", F.col("fields"))
    return nodes.groupBy(F.col("key").alias(key)).agg(_first(value).alias("cycle_label")).filter("cycle_label is not null")
