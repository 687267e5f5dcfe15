"""Filling fixed-capacity containers with items (problem 9).

Method: conflict-constrained best fit. Items come in order of falling size; open bins are ordered by the room they
have left, and each carries a bitmap of the sources and one of the duplicate clusters in it. The successor search
begins at the tightest bin that has room and goes on to the next tightest until a compatible one is found; else a
bin is opened. Copies of one text are kept apart, and so are sources named in ``conflicts``. A cluster with more
copies than there are containers at best may put as many into one as spreading them evenly needs, so the
constraint never costs a container by itself.

A text is divided only if it exceeds the capacity alone: its full pieces fill containers of their own, its rest is
an item. Items are dealt by hash to shards of about ``shard_tokens`` tokens and at most about ``shard_items`` items,
which are packed in parallel; a source, desk or cluster of any share is dealt over all shards, and so are rows without
an id and repeated rows. Room is lost only in the last bins of a shard; a shard has room for ``LEAST_BINS`` bins at
least, however large the capacity, so that is at most about one in as many.

Behaviour at the edges
----------------------
* null, empty and zero-sized texts are items of size 0, so that every row gets a container;
* equal sizes are ordered by id, then piece; a null source is a source; a null id is an item like any other;
* an empty table gives an empty result; no row is dropped; columns other than those named are ignored;
* a capacity that is null or below 1 is an error.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import tokens
from dialoom.session import ensure_checkpoint_dir

LEAST_BINS = 64
OUTPUT = "capacity_id long, container_id string, id long, piece int, tokens long"


class Bins:
    """Open bins of one capacity, ordered by residual room."""

    def __init__(self, capacity: int, conflicts: dict[int, int], quota: dict[int, int]) -> None:
        self.capacity, self.conflicts, self.quota = capacity, conflicts, quota
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms = 0  # bit r is set where a bin with r left is open
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.copies: list[Counter | None] = []

    def _fits(self, b: int, source: int, cluster: int) -> bool:
        if self.sources[b] & self.conflicts.get(source, 0):
            return False
        if cluster < 0 or not self.clusters[b] >> cluster & 1:
            return True
        return self.quota[cluster] > 1 and self.copies[b][cluster] < self.quota[cluster]

    def put(self, size: int, source: int, cluster: int) -> int:
        later = self.rooms >> size
        room = size
        while later:
            step = (later & -later).bit_length() - 1
            room += step
            for place, b in enumerate(self.by_room[room]):
                if self._fits(b, source, cluster):
                    self.by_room[room].pop(place)
                    if not self.by_room[room]:
                        self.rooms &= ~(1 << room)
                    self._load(b, room - size, source, cluster)
                    return b
            later >>= step + 1
            room += 1
        b = len(self.sources)
        self.sources.append(0)
        self.clusters.append(0)
        self.copies.append(None)
        self._load(b, self.capacity - size, source, cluster)
        return b

    def _load(self, b: int, room: int, source: int, cluster: int) -> None:
        self.sources[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
            if self.quota[cluster] > 1:
                self.copies[b] = self.copies[b] or Counter()
                self.copies[b][cluster] += 1
        self.by_room[room].append(b)
        self.rooms |= 1 << room


def pack_shard(items: pd.DataFrame, capacity: int, conflicts: frozenset[tuple[str, str]] = frozenset()) -> list[int]:
    """The bin of each item (columns size, source, cluster), items in the order given (falling size)."""
    sources = {s: i for i, s in enumerate(dict.fromkeys(items["source"]))}
    forbidden: dict[int, int] = defaultdict(int)
    for a, b in conflicts:
        if a in sources and b in sources:
            forbidden[sources[a]] |= 1 << sources[b]
            forbidden[sources[b]] |= 1 << sources[a]
    # Only texts that occur again need a bit; the emptiest number of bins tells how many copies one must hold.
    counts = Counter(items["cluster"])
    again = {c: i for i, c in enumerate(c for c, n in counts.items() if n > 1)}
    least = max(1, -(-int(items["size"].sum()) // capacity))
    quota = {i: -(-counts[c] // least) for c, i in again.items()}
    bins = Bins(capacity, forbidden, quota)
    return [bins.put(int(n), sources[s], again.get(c, -1)) for n, s, c in zip(items["size"], items["source"], items["cluster"], strict=True)]


def pack(
    sized: DataFrame, capacities: DataFrame, conflicts: frozenset[tuple[str, str]] = frozenset(), shard_tokens: int = 4_000_000, shard_items: int = 50_000
) -> DataFrame:
    """(capacity_id, container_id, id, piece, tokens) for every item and every capacity.

    ``sized``: id, tokens, source, cluster. ``capacities``: capacity_id, capacity_tokens, a small fixed table.
    """
    ensure_checkpoint_dir(sized.sparkSession)
    rooms = {r.capacity_id: r.capacity_tokens for r in capacities.select("capacity_id", "capacity_tokens").collect()}
    if any(c is None or c < 1 for c in rooms.values()):
        raise ValueError("capacities must be positive")
    # Rows of a checkpoint keep their order, so a row's number tells equal rows apart in every attempt.
    sized = sized.select("id", "tokens", F.coalesce("source", F.lit("")).alias("source"), "cluster").checkpoint().withColumn("row", F.monotonically_increasing_id())
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("items")).first()
    wanted = max(-(-total.tokens // shard_tokens), -(-total.items // shard_items))
    shards = {k: max(1, min(wanted, total.tokens // (LEAST_BINS * c))) for k, c in rooms.items()}
    each = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in ((k, "capacity_id"), (c, "room"), (shards[k], "shards"))]) for k, c in sorted(rooms.items())]))
    items = sized.select("*", each.alias("c")).select(
        "c.capacity_id", "c.room", F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "row", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "cluster",
        F.pmod(F.xxhash64("row"), F.col("c.shards")).alias("shard"),
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        room, shard = int(group["room"].iloc[0]), group["shard"].iloc[0]
        full = (group["tokens"] // room).where(group["tokens"] > room, 0).to_numpy()
        rest = group.assign(piece=full, size=group["tokens"].to_numpy() - full * room)[lambda g: (g["piece"] == 0) | (g["size"] > 0)]
        rest = rest.sort_values(["size", "no_id", "id", "row", "piece"], ascending=[False, True, True, True, True], kind="stable")
        whole = group.loc[group.index.repeat(full)]
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        names = [f"s{shard}-{b}" for b in pack_shard(rest, room, conflicts)] + [f"s{shard}-full-{b}" for b in range(len(whole))]
        ids, no_id = (pd.concat([rest[c], whole[c]]).reset_index(drop=True) for c in ("id", "no_id"))
        return pd.DataFrame({
            "capacity_id": group["capacity_id"].iloc[0], "container_id": names, "id": ids.astype("Int64").mask(no_id),
            "piece": np.concatenate([rest["piece"], piece]).astype("int32"), "tokens": np.concatenate([rest["size"], np.full(len(whole), room)]).astype("int64"),
        })

    return items.repartition(sum(shards.values()), "capacity_id", "shard").groupBy("capacity_id", "shard").applyInPandas(fill, OUTPUT)


def sizes(documents: DataFrame, id_col: str, text_col: str, source_col: str, path: str = tokens.VOCABULARY) -> DataFrame:
    """(id, tokens, source, cluster): token counts and the hash of the text regardless of case and spacing."""
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+", " ")))
    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.col(text_col).alias("text"))
    return tokens.count(slim, "text", path=path)
