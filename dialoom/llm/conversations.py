"""Rebuilding conversations from message rows (problem 2).

Method: rows are range-partitioned and sorted by (conversation, time, message id), so every partition holds
runs of whole or split conversations in order; a finite-state automaton reads each run. Its transition
functions compose, so a conversation that is longer than a partition is read by several tasks at once and the
parts are joined afterwards (at most two parts per partition travel to the driver). No group is ever gathered.

Behaviour at the edges
----------------------
* rows with a null conversation key belong to none and give no rows; an empty table gives an empty result;
* a message sent again (same conversation and id) counts once, as its earliest loaded copy (then smallest row);
* a null message id, or ids that are not exactly 1..n, break the conversation; blank texts count for the ids only;
* a non-blank message without time or with an unknown or null role breaks the conversation;
* equal times are ordered by message id; texts of any length are kept whole (``with_texts``); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank, strip
from dialoom.session import ensure_checkpoint_dir

#: Role codes. OTHER stands for a missing or unknown role, or a missing time.
CUSTOMER, SALES, SYSTEM, OTHER = 0, 1, 2, 3
#: States: nothing asked yet, a customer spoke, a sales reply followed, broken.
START, ASKED, ANSWERED, BROKEN = 0, 1, 2, 3
#: TRANSITIONS[role][state]
TRANSITIONS = (
    (ASKED, ASKED, ANSWERED, BROKEN),
    (START, ANSWERED, ANSWERED, BROKEN),
    (START, ASKED, ANSWERED, BROKEN),
    (BROKEN, BROKEN, BROKEN, BROKEN),
)
IDENTITY = (START, ASKED, ANSWERED, BROKEN)


def _compose(first: tuple, then: tuple) -> tuple:
    return tuple(then[s] for s in first)


def _closure() -> tuple[list[tuple], list[list[int]]]:
    """Every transition function that words over the roles can make, and step[function][role]."""
    functions, step = [IDENTITY], []
    for f in functions:
        row = []
        for t in TRANSITIONS:
            g = _compose(f, t)
            if g not in functions:
                functions.append(g)
            row.append(functions.index(g))
        step.append(row)
    return functions, step


FUNCTIONS, STEP = _closure()


def role_code(role: Column) -> Column:
    """Customer, sales, system or other, in any letter case and with surrounding white space."""
    r = F.lower(strip(role))
    return (
        F.when(r.isin("客户", "customer"), CUSTOMER).when(r.isin("csm", "sales") | r.startswith("销售"), SALES)
        .when(r.isin("系统", "system"), SYSTEM).otherwise(OTHER).cast("int")
    )


class _Run:
    """What is known of one conversation's rows within one partition."""

    __slots__ = ("bad_id", "function", "high", "low", "rows", "talk")

    def __init__(self) -> None:
        self.rows, self.talk, self.low, self.high, self.bad_id, self.function = 0, 0, None, None, False, 0

    def add(self, ids: np.ndarray, known: np.ndarray, codes: list[int]) -> None:
        self.rows += len(ids)
        if not known.all():
            self.bad_id = True
            ids = ids[known]
        if len(ids):
            low, high = int(ids.min()), int(ids.max())
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)
        f = self.function
        for c in codes:
            f = STEP[f][c]
        self.function = f
        self.talk += len(codes)

    def summary(self) -> tuple:
        return self.rows, self.talk, self.low, self.high, self.bad_id, self.function


def _join(a: tuple, b: tuple) -> tuple:
    pick = lambda f, x, y: y if x is None else x if y is None else f(x, y)
    return a[0] + b[0], a[1] + b[1], pick(min, a[2], b[2]), pick(max, a[3], b[3]), a[4] or b[4], FUNCTIONS.index(_compose(FUNCTIONS[a[5]], FUNCTIONS[b[5]]))


def _kept(s: tuple) -> bool:
    rows, talk, low, high, bad_id, function = s
    return talk > 0 and not bad_id and low == 1 and high == rows and FUNCTIONS[function][START] == ANSWERED


def _runs(batch: pd.DataFrame) -> Iterator[tuple[str, slice]]:
    keys = batch["file_id"].to_numpy()
    if len(keys):
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield keys[a], slice(a, b)


def _edges(pid: int, batches: Iterator[pd.DataFrame]) -> list[tuple]:
    """Summaries of the first and the last conversation of a partition: (pid, place, key, summary...)."""
    first, last, key, run = None, None, None, None
    for batch in batches:
        ids = batch["msg_id"].to_numpy(dtype="float64", na_value=np.nan)
        known = ~np.isnan(ids)
        ids, codes, blank = np.where(known, ids, 0).astype("int64"), batch["code"].to_numpy(), batch["blank"].to_numpy()
        for k, part in _runs(batch):
            if k != key:
                if run is not None and first is None:
                    first = (key, run.summary())
                key, run = k, _Run()
            run.add(ids[part], known[part], codes[part][~blank[part]].tolist())
    if run is not None:
        last = (key, run.summary())
        first = first or last
    return [(pid, place, k, *s) for place, (k, s) in enumerate([first, last])] if last else []


EDGE_SCHEMA = "pid int, place int, file_id string, rows long, talk long, low long, high long, bad_id boolean, function int"


def rebuild(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """(file_id, seq, msg_id, role): the non-blank messages of every whole, answered conversation, in order.

    ``messages`` needs file_id, row_id, msg_id, sender_role, processed_text, dialogue_time, loaded_at.
    """
    spark = messages.sparkSession
    ensure_checkpoint_dir(spark)
    text_blank = is_blank(F.col("processed_text"))
    code = F.when(text_blank, SYSTEM).when(F.col("dialogue_time").isNull(), OTHER).otherwise(role_code(F.col("sender_role")))
    slim = messages.filter(F.col("file_id").isNotNull()).select(
        "file_id", F.col("msg_id").cast("long").alias("msg_id"), F.struct("loaded_at", "row_id").alias("age"),
        F.struct(F.col("dialogue_time").alias("at"), code.cast("int").alias("code"), text_blank.alias("blank")).alias("m"),
    )
    once = slim.groupBy("file_id", "msg_id").agg(F.min_by("m", "age").alias("m")).select("file_id", "msg_id", "m.at", "m.code", "m.blank")
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("file_id"), F.col("at"), F.col("msg_id")]
    ordered = once.repartitionByRange(width, *order).sortWithinPartitions(*order).select("file_id", "msg_id", "code", "blank").checkpoint()

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        names = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]
        out = pd.DataFrame(_edges(TaskContext.get().partitionId(), batches), columns=names)
        for c in ("low", "high"):
            out[c] = out[c].astype("Int64")
        yield out

    # Two rows for each partition at most.
    found = sorted(ordered.mapInPandas(edges, EDGE_SCHEMA).collect(), key=lambda r: (r.pid, r.place))
    whole: dict[str, tuple] = {}
    before: dict[tuple[int, str], int] = {}
    seen: set[tuple[int, str]] = set()
    for r in found:
        if (r.pid, r.file_id) in seen:
            continue  # a partition with one conversation reports it twice
        seen.add((r.pid, r.file_id))
        s = (r.rows, r.talk, r.low, r.high, r.bad_id, r.function)
        before[r.pid, r.file_id] = whole[r.file_id][1] if r.file_id in whole else 0
        whole[r.file_id] = _join(whole[r.file_id], s) if r.file_id in whole else s
    split = spark.sparkContext.broadcast((before, {k: _kept(s) for k, s in whole.items()}))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, (offsets, verdicts) = TaskContext.get().partitionId(), split.value
        key, run, held = None, None, []

        def finish() -> pd.DataFrame | None:
            kept = verdicts[key] if key in verdicts else _kept(run.summary())
            if not kept or not run.talk:
                return None
            ids, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            start = offsets.get((pid, key), 0) + 1
            return pd.DataFrame({"file_id": key, "seq": np.arange(start, start + len(ids), dtype="int32"), "msg_id": ids, "code": codes})

        for batch in batches:
            ids = batch["msg_id"].to_numpy(dtype="float64", na_value=np.nan)
            known = ~np.isnan(ids)
            ids, codes, blank = np.where(known, ids, 0).astype("int64"), batch["code"].to_numpy(), batch["blank"].to_numpy()
            done = []
            for k, part in _runs(batch):
                if k != key:
                    if run is not None and (out := finish()) is not None:
                        done.append(out)
                    key, run, held = k, _Run(), []
                talk = ~blank[part]
                run.add(ids[part], known[part], codes[part][talk].tolist())
                held.append((ids[part][talk], codes[part][talk].astype("int32")))
            if done:
                yield pd.concat(done, ignore_index=True)
        if run is not None and (out := finish()) is not None:
            yield out

    role = F.element_at(F.array(F.lit("customer"), F.lit("sales"), F.lit("system")), F.col("code") + 1)
    return ordered.mapInPandas(number, "file_id string, seq int, msg_id long, code int").select("file_id", "seq", "msg_id", role.alias("role"))


def with_texts(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """(file_id, seq, role, msg_id, at, text): ``rebuild`` with each message's time and whole text.

    Texts take no part in the sort: they are joined to the kept messages, once, by conversation and id.
    """
    kept = rebuild(messages, partitions)
    told = F.min_by(F.struct(F.col("dialogue_time").alias("at"), F.col("processed_text").alias("text")), F.struct("loaded_at", "row_id")).alias("m")
    texts = messages.filter(F.col("file_id").isNotNull()).groupBy("file_id", F.col("msg_id").cast("long").alias("msg_id")).agg(told)
    return kept.join(texts, ["file_id", "msg_id"]).select("file_id", "seq", "role", "msg_id", "m.at", "m.text")
