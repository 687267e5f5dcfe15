"""Deeply nested payloads to flat node tables (problem 1).

Method: depth-first traversal gives every object of a payload a pre-order and a post-order number; each kind
of object becomes a flat table, and an ancestor is found by interval containment (``pre`` smaller and ``post``
larger), never by copying the ancestor's keys into the child.

Behaviour at the edges
----------------------
* null, empty or undecodable payloads hold no objects and give no rows, as does an empty table;
* JSON, Python literals, and either of them written as text inside the other (any number of times) are decoded;
* an object outside the ruled arrays is a node, too, of kind ``object``, in whatever field or array (of arrays) it
  stands; its ``field`` names the field and its ``pos`` the place in the array (-1 outside arrays, the places within
  arrays of arrays are counted through); arrays of plain values stay with the fields of their object;
* an array element that is no object gives no row, but keeps its position; a lone object stands at position 0;
* a null key is kept (rows are told apart by an internal row number, so repeated rows give repeated nodes);
* payloads deeper than the decoder's limit count as undecodable; very long payloads are read whole;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind of the parent -> [(kind of the child, alternative key paths to the array that holds it)].
#: The empty path is the payload itself.
PAYLOAD_RULES: dict[str, list[tuple[str, tuple[tuple[str, ...], ...]]]] = {
    "rag": [("recall", (("data", "recall"), ("recall",)))],
    "recall": [("entry", (("content",),))],
    "entry": [("question", (("问卷内容",),))],
    "thought_unit": [("unit", ((),))],
    "unit": [("answer", (("rag_fast_chat_result",),))],
}
#: kind -> kinds of its ancestors, outermost first.
LINEAGE = {
    "recall": (),
    "entry": ("recall",),
    "question": ("recall", "entry"),
    "unit": (),
    "answer": ("unit",),
}


def decode(value: object) -> object:
    """An object or array from a value that may be text in JSON or Python-literal form, else None.

    Text within text is decoded layer by layer; each layer is shorter than the one around it.
    """
    while isinstance(value, str):
        text = value.strip()
        if text[:1] not in "{[\"'(":
            return None
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            if text[-1:] not in "}]\"')":
                return None
            try:
                value = ast.literal_eval(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                return None
    if isinstance(value, tuple):
        return list(value)
    return value if isinstance(value, dict | list) else None


def _follow(node: object, path: tuple[str, ...]) -> object:
    for key in path:
        node = decode(node)
        if not isinstance(node, dict) or key not in node:
            return None
        node = node[key]
    return node


def _objects(value: object) -> Iterable[tuple[int, dict]]:
    found = decode(value)
    if isinstance(found, dict):
        return [(0, found)]
    if isinstance(found, list):
        return [(i, o) for i, x in enumerate(found) if isinstance(o := x if isinstance(x, dict) else decode(x) if isinstance(x, str) else None, dict)]
    return []


def _elements(value: object) -> Iterator[object]:
    """The elements of an array, those of arrays in it in their place."""
    stack = [iter(value)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list | tuple):
                stack.append(iter(x))
                break
            yield x
        else:
            stack.pop()


def _unruled(node: object, skip: set[str]) -> Iterator[tuple[int, str, str, dict]]:
    """The objects in the fields of a node outside ``skip``, in document order."""
    for key, value in node.items() if isinstance(node, dict) else ():
        if key in skip:
            continue
        if isinstance(value, dict):
            yield -1, "object", str(key), value
        elif isinstance(value, list | tuple):
            yield from ((i, "object", str(key), x) for i, x in enumerate(_elements(value)) if isinstance(x, dict))


def _children(node: object, kind: str, rules: dict) -> list[tuple[int, str, str, dict]]:
    """(pos, kind, field, object): the ruled arrays, then every other object, each in document order."""
    out, ruled = [], set()
    within: list[tuple[object, str]] = []
    for child, paths in rules.get(kind, []):
        for path in paths:
            value = _follow(node, path) if path else node
            if value is not None:
                out += [(i, child, path[-1] if path else "", o) for i, o in _objects(value)]
                if not path:
                    return out
                ruled.add(path[0])
                within += [(decode(_follow(node, path[:i])), path[i]) for i in range(1, len(path))]
                break
    out += _unruled(node, ruled)
    for inner, key in within:  # what else stands beside a ruled array on the way down to it
        out += _unruled(inner, {key})
    return out


def traverse(payload: object, root: str, rules: dict = PAYLOAD_RULES) -> list[tuple[str, int, int, int, int, str, dict]]:
    """(kind, pre, post, depth, pos, field, object) of every object below a payload.

    The payload itself has pre 0; it is given, as kind ``root``, where it is an object and no object by rule.
    """
    value = decode(payload)
    if value is None:
        return []
    out: list = []
    pre, post = 1, 0
    if isinstance(value, dict) and not any(() in paths for _, paths in rules.get(root, [])):
        out.append([root, 0, 0, 0, -1, "", value])
    elif isinstance(value, list) and not any(() in paths for _, paths in rules.get(root, [])):
        value = {"": value}  # a list where the rules want an object: its objects are still nodes
    stack = [[iter(_children(value, root, rules)), len(out) - 1]]
    while stack:
        step = next(stack[-1][0], None)
        if step is None:
            _, row = stack.pop()
            if row >= 0:
                out[row][2] = post
            post += 1
            continue
        pos, kind, field, node = step
        out.append([kind, pre, 0, len(stack), pos, field, node])
        pre += 1
        stack.append([iter(_children(node, kind, rules)), len(out) - 1])
    return out


def _plain(value: object, layers: int = 50) -> object:
    """A value without the objects in it, which are nodes of their own; None where nothing else is left.

    Arrays within more than ``layers`` arrays are given as one.
    """
    if isinstance(value, dict):
        return None
    if isinstance(value, list | tuple):
        kept = [_plain(x, layers - 1) for x in value] if layers else [x for x in _elements(value) if not isinstance(x, dict)]
        return kept if not value or any(x is not None for x in kept) else None
    return value


def _scalars(node: dict) -> str:
    """The plain values of an object and its arrays of them, as JSON."""
    kept = {str(k): _plain(v) for k, v in node.items() if v is None or _plain(v) is not None}
    return json.dumps(kept, ensure_ascii=False, default=str)


def label_nodes(
    df: DataFrame, key: str, payloads: Iterable[str] = ("rag", "thought_unit"), kinds: Iterable[str] | None = None,
    with_fields: bool = True, rules: dict = PAYLOAD_RULES,
) -> DataFrame:
    """One row per object: row_no, key, payload, kind, pre, post, depth, pos, field, fields (JSON of its plain values).

    Rows are numbered in the order they come in, so that order must be repeatable (a scan, or sorted partitions).

    ``payloads`` are columns whose names are root kinds in ``rules``; numbering covers every object even
    where ``kinds`` restricts what is emitted.
    """
    names, wanted = list(payloads), None if kinds is None else set(kinds)
    key_type = df.schema[key].dataType
    source = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(key).alias("key"), *[F.col(p).cast("string").alias(f"payload_{i}") for i, p in enumerate(names)])
    schema = T.StructType([
        T.StructField("row_no", T.LongType()), T.StructField("key", key_type), T.StructField("payload", T.StringType()), T.StructField("kind", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ("pre", "post", "depth", "pos")],
        *([T.StructField("field", T.StringType()), T.StructField("fields", T.StringType())] if with_fields else []),
    ])
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in columns]
            row_nos, keys = batch.column("row_no").to_pylist(), batch.column("key").to_pylist()
            for i, name in enumerate(names):
                for row_no, k, text in zip(row_nos, keys, batch.column(f"payload_{i}").to_pylist(), strict=True):
                    if text is None:
                        continue
                    for kind, pre, post, depth, pos, field, node in traverse(text, name, rules):
                        if wanted is None or kind in wanted:
                            for column, value in zip(made, (row_no, k, name, kind, pre, post, depth, pos, *([field, _scalars(node)] if with_fields else [])), strict=True):
                                column.append(value)
            arrays = [pa.array(c, type=t) for c, t in zip(made, (pa.int64(), batch.schema.field("key").type, pa.string(), pa.string(), *[pa.int32()] * 4, *([pa.string()] * 2 if with_fields else [])), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return source.mapInArrow(run, schema)


def node_tables(nodes: DataFrame, kinds: Iterable[str] = tuple(LINEAGE)) -> dict[str, DataFrame]:
    """One flat table per kind of object."""
    return {k: nodes.filter(F.col("kind") == k) for k in kinds}


def with_ancestors(nodes: DataFrame, lineage: dict[str, tuple[str, ...]] = LINEAGE) -> DataFrame:
    """Add ``<kind>_pre`` and ``<kind>_pos`` of the containing object of each ancestor kind.

    Siblings' intervals never overlap, so the candidate is the last object of that kind that began before the
    child in pre-order; containment of ``post`` decides. One sort per payload, no pairs of nodes are formed.
    """
    payload = Window.partitionBy("row_no", "payload").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    for kind in sorted({a for up in lineage.values() for a in up}):
        near = F.last(F.when(F.col("kind") == kind, F.struct("pre", "post", "pos")), ignorenulls=True).over(payload)
        nodes = nodes.withColumn(f"_{kind}", near)
    for kind in sorted({a for up in lineage.values() for a in up}):
        inside = F.col(f"_{kind}.post") > F.col("post")
        nodes = nodes.withColumns({f"{kind}_pre": F.when(inside, F.col(f"_{kind}.pre")), f"{kind}_pos": F.when(inside, F.col(f"_{kind}.pos"))}).drop(f"_{kind}")
    return nodes


def positions(nodes: DataFrame, lineage: dict[str, tuple[str, ...]] = LINEAGE, width: int = 3) -> DataFrame:
    """(key, kind, pos_1..pos_width): the positions along the chain of containing objects, -1 where unused."""
    linked = with_ancestors(nodes.filter(F.col("kind").isin(*lineage)), lineage)

    def at(place: int) -> Column:
        value = F.lit(-1)
        for kind, up in lineage.items():
            chain = [F.col(f"{a}_pos") for a in up] + [F.col("pos")]
            if place < len(chain):
                value = F.when(F.col("kind") == kind, chain[place]).otherwise(value)
        return value.cast("int").alias(f"pos_{place + 1}")

    return linked.select("key", "kind", *[at(i) for i in range(width)])
