"""Splitting of history blobs into messages, for the operators that judge single messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speaker and time heads of the line layouts.
HEAD = r"^\s*(?:\[[^\]\n]++\](?:\[[^\]\n]*+\])?|客户|销售|CSM|系统)\s*[:：]\s?"


def history_messages(history: Column) -> Column:
    """Array of message texts (and continuation lines) of a history in any layout; empty where there is none."""
    as_json = F.from_json(history, "array<struct<role:string,content:string,time:string>>")
    contents = F.filter(F.transform(as_json, lambda m: m["content"]), lambda x: x.isNotNull())
    lines = F.transform(F.split(history, "\n"), lambda line: F.regexp_replace(line, HEAD, ""))
    is_json = history.rlike(r"^\s*\[\s*\{")
    return F.coalesce(F.when(is_json, contents), lines, F.array().cast("array<string>"))
