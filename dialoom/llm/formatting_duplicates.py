"""Duplicates hidden by formatting differences (problem 3).

Method: every record is reduced, once, to a canonical text and a 64-bit hash of (scope, canonical text). The hash space
is cut into ranges of about ``RANGE_ROWS`` records. Each partition gives every range its distinct hashes and which of
them it has seen again; the range merges the partitions into two Bloom filters, hashes seen once and hashes seen again:
what a partition saw again, or what the filter of the partitions before may hold already, goes into the second one, so
no repeated hash can be missed. Both have about ``BITS`` bits a record whatever the number of records. A range's
filter of repeats is then written anew at the size of the hashes that it lets through. These are put together and
broadcast; only records that they may hold are shuffled and grouped exactly by the canonical text, all others are
singletons and never shuffled.

The filters of repeats take 2 to 4 bytes a repeated hash; should they exceed ``max_filter_bytes``, each is folded in half
until they fit: more singletons are shuffled then, results stay exact. Groups with more than a ``1 / hot_groups``
share of the candidates (so fewer than ``hot_groups`` of them) are joined by broadcast; the rest by a shuffle.

Behaviour at the edges
----------------------
* null and blank texts, and texts of which nothing is left, belong to no group and are never collapsed;
* a null scope is a scope of its own only with other nulls; a null id is kept as a copy, never as the survivor's id;
* the survivor is the smallest id; exact repeats of a row count as copies; ties and empty tables need no care;
* texts are used whole, item names and runs of signs of any length; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.blank import is_blank
from dialoom.session import ensure_checkpoint_dir

HASHES = 4
BITS = 16
RANGE_ROWS = 1 << 18
#: Hashes that a partition holds before it hands them on.
BUFFER_ROWS = 1 << 20
#: What may part two items, and what may stand around them.
SEPARATORS = r",，;；、|/\r\n\t"
_RUN = r"[\s\p{P}|]"


def canonical(text: Column) -> Column:
    """Lower case without white space and punctuation; the items of a name:value message in sorted order.

    Items begin where the start, or a run of signs and white space that holds a separator, a sentence end or two white
    spaces, is followed by a name and a colon. Text between two such places belongs to the item before it, so stray
    punctuation within a value changes nothing. Every run is looked at once, so the time is linear in the length.
    """
    mark = chr(1)
    plain = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\s\p{P}]+", "")
    name = rf"[^{SEPARATORS}:：{{}}\[\]()（）{mark}]++"
    parting = rf"(?<!{_RUN})(?={_RUN}*?(?:[{SEPARATORS}。.!！?？…]|\s\s)){_RUN}++"
    starts = F.regexp_replace(text, rf"(?U)(?:^{_RUN}*+|{parting})(?={name}[:：])", mark)
    items = F.filter(F.split(starts, mark), lambda x: plain(x) != "")
    made_of_items = F.forall(items, lambda x: F.regexp_extract(x, r"^([^:：]*)[:：]", 1).rlike(r"[\p{L}\p{N}]")) & (F.size(items) > 1)
    return F.when(made_of_items, F.array_join(F.array_sort(F.transform(items, plain)), "")).otherwise(plain(text))


def _positions(hashes: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """HASHES bit positions for each hash, by double hashing; bits are powers of two."""
    h = hashes.astype(np.uint64)
    mask = (np.asarray(bits, dtype=np.int64) - 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        step = (((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        at = h[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]
    return (at & (mask[:, None] if mask.ndim else mask)).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def _size(rows: int) -> int:
    """Bits for so many hashes: a power of two, 64 at least."""
    return 1 << max(6, (max(1, rows) * BITS - 1).bit_length())


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its upper half, which takes no part in the first position."""
    return (((hashes.astype(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def partial(values: np.ndarray, again: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, distinct hashes, which of them were seen again) of one partition's distinct hashes."""
    place = _range_of(values, ranges)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(place[part[0]]), values[part].tobytes(), np.packbits(again[part]).tobytes()


def merge(parts: list[tuple[bytes, bytes]]) -> bytes:
    """A range's filter of repeats, merged from the partials of all partitions; empty where nothing repeats."""
    hashes = [np.frombuffer(h, np.int64) for h, _ in parts]
    bits = _size(sum(map(len, hashes)))
    once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for values, (_, flags) in zip(hashes, parts, strict=True):
        at = _positions(values, bits)
        seen = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(values)).astype(bool) | _has(once, at)
        _put(again, at[seen])
        _put(once, at)
    through = np.unique(np.concatenate([v[_has(again, _positions(v, bits))] for v in hashes]))
    if not len(through):
        return b""
    bits = _size(len(through))
    tight = np.zeros(bits // 8, np.uint8)
    _put(tight, _positions(through, bits))
    return tight.tobytes()


def fold(filled: bytes) -> bytes:
    """A filter of half the size that holds at least the same hashes."""
    whole = np.frombuffer(filled, np.uint8)
    return (whole[: len(whole) // 2] | whole[len(whole) // 2 :]).tobytes() if len(whole) > 8 else filled


class Repeats:
    """The ranges' filters of repeats, put together."""

    def __init__(self, filters: dict[int, bytes], ranges: int) -> None:
        self.ranges = ranges
        self.sizes = np.array([len(filters.get(r, b"")) for r in range(ranges)], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bitmap = np.frombuffer(b"".join(filters.get(r, b"") for r in range(ranges)), np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = _range_of(hashes, self.ranges)
        found = self.sizes[place] > 0
        rows = np.flatnonzero(found)
        at = _positions(hashes[rows], self.sizes[place[rows]] * 8) + self.starts[place[rows]][:, None] * 8
        found[rows] = _has(self.bitmap, at) if len(rows) else False
        return found


def repeat_filter(hashes: DataFrame, rows: int, range_rows: int = RANGE_ROWS, max_filter_bytes: int = 256 << 20) -> Repeats:
    """The filter of the hashes (column h) that may occur more than once."""
    ranges = max(1, -(-rows // range_rows))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def hand_on(held: list[np.ndarray]) -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame(list(partial(values, counts > 1, ranges)), columns=["range", "hashes", "again"])

        held, n = [], 0
        for batch in batches:
            held.append(batch["h"].to_numpy(dtype="int64"))
            n += len(held[-1])
            if n >= BUFFER_ROWS:
                yield hand_on(held)
                held, n = [], 0
        if n:
            yield hand_on(held)

    def put_together(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"range": parts["range"].iloc[:1], "filled": [merge(list(zip(parts["hashes"], parts["again"], strict=True)))]})

    partials = hashes.mapInPandas(fill, "range long, hashes binary, again binary")
    merged = partials.groupBy("range").applyInPandas(put_together, "range long, filled binary")
    filters: dict[int, bytes] = {}
    folds = 0
    # At most 4 bytes a record come from a range; one by one, so the driver holds max_filter_bytes and one more at most.
    for r in merged.collect() if ranges * range_rows * 4 <= max_filter_bytes else merged.toLocalIterator():
        filled = r.filled
        for _ in range(folds):
            filled = fold(filled)
        filters[r.range] = filled
        while sum(map(len, filters.values())) > max_filter_bytes and any(len(f) > 8 for f in filters.values()):
            filters = {k: fold(f) for k, f in filters.items()}
            folds += 1
    return Repeats(filters, ranges)


def candidates(df: DataFrame, id_col: str, text_col: str, scope_cols: list[str], **filter_options: int) -> tuple[DataFrame, DataFrame]:
    """(records that may have copies, records that have none): id, scope struct, canon."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    scope = F.struct(*[F.col(c) for c in scope_cols]) if scope_cols else F.struct(F.lit(0).alias("all"))
    canon = F.when(~is_blank(F.col(text_col)), canonical(F.col(text_col)))
    slim = df.select(F.col(id_col).alias("id"), scope.alias("scope"), F.nullif(canon, F.lit("")).alias("canon"))
    keyed = slim.withColumn("h", F.xxhash64("scope", "canon")).checkpoint()
    shared = spark.sparkContext.broadcast(repeat_filter(keyed.filter(F.col("canon").isNotNull()).select("h"), keyed.count(), **filter_options))

    @F.pandas_udf(T.BooleanType())
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h.to_numpy(dtype="int64")))

    marked = keyed.withColumn("maybe", F.col("canon").isNotNull() & may_repeat("h"))
    return marked.filter("maybe").select("id", "scope", "canon"), marked.filter(~F.col("maybe")).select("id", "scope", "canon")


def collapse(df: DataFrame, id_col: str, text_col: str, scope_cols: list[str], **filter_options: int) -> DataFrame:
    """One row per group of equal records: keep_id, copies. Records without usable text stand alone."""
    maybe, single = candidates(df, id_col, text_col, scope_cols, **filter_options)
    grouped = maybe.groupBy("scope", "canon").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("keep_id", "copies").unionByName(single.select(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies")))


def copies(df: DataFrame, id_col: str, text_col: str, scope_cols: list[str], hot_groups: int = 1000, **filter_options: int) -> DataFrame:
    """(keep_id, id): every record but the first of each group, with the id that stays."""
    maybe, _ = candidates(df, id_col, text_col, scope_cols, **filter_options)
    groups = maybe.groupBy("scope", "canon").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").checkpoint()
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # Fewer than hot_groups groups can hold more than this share, so that side may be broadcast.
    limit = max(1000, total // hot_groups)
    hot, rest = groups.filter(F.col("copies") > limit), groups.filter(F.col("copies") <= limit)
    on = ["scope", "canon"]
    small = maybe.join(F.broadcast(hot.select(*on).withColumn("hot", F.lit(True))), on, "left").filter(F.col("hot").isNull()).drop("hot")
    joined = maybe.join(F.broadcast(hot), on).unionByName(small.join(rest, on))
    return joined.filter(F.col("id") != F.col("keep_id")).select("keep_id", "id")
