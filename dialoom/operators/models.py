"""Calls of a language model from a table, with any function that answers a batch of prompts.

The library has no client of its own: ``answer`` takes a list of texts and returns as many answers. A call that fails
gives empty answers for its batch, so one bad batch never ends a job; null prompts are not sent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Answer = Callable[[list[str]], list[str]]
#: What a judge's reply has to contain to count as a verdict.
VERDICT = r"[是否]"


def call(prompts: Column, answer: Answer, batch: int = 32) -> Column:
    """The model's answers to a column of prompts, ``batch`` at a time; empty where a call failed."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        asked = [i for i, t in zip(texts.index, texts, strict=True) if isinstance(t, str)]
        for k in range(0, len(asked), batch):
            part = asked[k : k + batch]
            try:
                got = [str(a) for a in answer([texts[i] for i in part])]
            except Exception:  # whatever a remote model raises
                got = []
            for n, i in enumerate(part):
                out[i] = got[n] if len(got) == len(part) else ""
        return out

    return run(prompts)


def judge(df: DataFrame, template: str, columns: dict[str, str], answer: Answer, otherwise: Column, out: str = "verdict") -> DataFrame:
    """Add a model's verdict on each row: ``template`` with the columns' values at ``{name}``, the first 是 or 否 of the
    reply; where there is none, the heuristic verdict ``otherwise``."""
    prompt: Column = F.lit("")
    pieces = re.split(r"\{(\w+)\}", template)
    for n, piece in enumerate(pieces):
        prompt = F.concat(prompt, F.coalesce(F.col(columns[piece]).cast("string"), F.lit("")) if n % 2 else F.lit(piece))
    reply = F.regexp_extract(call(prompt, answer), VERDICT, 0)
    return df.withColumn("__reply", reply).withColumn(out, F.when(F.col("__reply") != "", F.col("__reply")).otherwise(otherwise)).drop("__reply")
