"""Shards of near equal bytes: a minimax contiguous partition of atomic groups.

Rows with equal texts are one group, never split. Groups stand in the order of their text's hash, and
`SHARDS` contiguous runs of groups are cut so that the largest run is as small as it can be: the
smallest feasible capacity is found by binary search, each capacity checked by filling shards greedily.

The groups themselves stay distributed. The driver holds a summary: the range of hashes cut into
nodes, with each node's bytes, largest group and number of groups. Taken whole, nodes give a capacity
that is certainly feasible; taken as divisible, one that is certainly needed; the answer lies between.
Only nodes in which a cut may fall are then split in `FAN` parts, and so on until every cut falls
between single groups, which makes the result exact. The summary's size is set by SHARDS and FIRST, and
not by the number of groups; a round adds one aggregate over the groups' hashes.

Defined results: a null text has no bytes and is equal to an empty one; two texts with the same hash are one group
(at worst they share a shard); fewer groups than shards leave shards empty; a group larger than the mean shard
makes the capacity at least its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, next_power_of_two, numbered_groups

SHARDS = 40
OVERHEAD = 16
#: Parts of the hash range in the first summary, and parts of a node that is split.
FIRST = 1 << 12
FAN = 1 << 6
HASH_BITS = 62
#: Rows that a slice of a shard has, about, when its rows are numbered.
SLICE_ROWS = 20_000
LEAST_SLICES = 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def group_of(text: Column) -> Column:
    """The hash that orders groups, from 0 to 2**HASH_BITS - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - HASH_BITS)


@dataclass
class Summary:
    """Nodes in order: first hash, width of the range, bytes, largest group, groups."""

    low: np.ndarray
    width: np.ndarray
    size: np.ndarray
    largest: np.ndarray
    groups: np.ndarray

    def whole(self) -> np.ndarray:
        return (self.groups <= 1) | (self.width <= 1)


def _walk(total: np.ndarray, fixed: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Where greedy shards end, as bytes from the start: in a node that is not fixed, anywhere."""
    ends, at = [], 0
    for _ in range(shards):
        goal = at + capacity
        if goal >= total[-1]:
            at = int(total[-1])
        else:
            node = int(np.searchsorted(total, goal, side="right")) - 1
            at = max(int(total[node]), at) if fixed[node] else goal
        ends.append(at)
    return np.array(ends)


def smallest_capacity(sizes: np.ndarray, fixed: np.ndarray, least: int, shards: int) -> int:
    """The smallest capacity, `least` or more, whose greedy shards take everything."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    low, high = max(least, -(-int(total[-1]) // shards)), max(least, int(total[-1]))
    while low < high:
        middle = (low + high) // 2
        if _walk(total, fixed, middle, shards)[-1] >= total[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _summary(rows: list) -> Summary:
    data = np.array([[r["low"], r["width"], r["size"], r["largest"], r["groups"]] for r in rows], np.int64).reshape(-1, 5)
    data = data[np.argsort(data[:, 0])]
    return Summary(*data.T)


def cuts(groups: DataFrame, shards: int = SHARDS, first: int = FIRST, fan: int = FAN) -> tuple[list[int], int]:
    """Hashes at which shards 1, 2, ... begin (fewer if shards stay empty), and the capacity.

    groups: (group, size), a row for each group.
    """
    width = (1 << HASH_BITS) // first

    def told(low: Column, wide: Column, over: DataFrame) -> list:
        return (
            over.groupBy(low.alias("low"), wide.alias("width"))
            .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"))
            .collect()  # `first` rows, later `fan` rows for each node near a cut
        )

    now = _summary(told(F.col("group") - F.col("group") % width, F.lit(width), groups))
    if not len(now.low):
        return [], 0
    while True:
        total = np.concatenate(([0], np.cumsum(now.size)))
        fixed, firm = now.whole(), np.ones(len(now.low), bool)
        least = int(now.largest.max())
        needed = smallest_capacity(now.size, fixed, least, shards)
        enough = smallest_capacity(now.size, firm, max(least, int(now.size.max())), shards)
        begin, end = _walk(total, firm, needed, shards), _walk(total, fixed, enough, shards)
        reach = np.zeros(len(total) + 1, np.int64)
        a = np.maximum(np.searchsorted(total, begin, side="right") - 1, 0)
        b = np.searchsorted(total, end, side="left")
        np.add.at(reach, np.minimum(a, b), 1)
        np.add.at(reach, np.maximum(a, b), -1)
        split = (np.cumsum(reach)[: len(now.low)] > 0) & ~fixed
        if int(now.size[~fixed].max(initial=0)) > needed:
            split |= ~fixed & (now.size > needed)
        if not split.any():
            ends = _walk(total, firm, enough, shards)
            starts = np.searchsorted(total, np.unique(ends[ends < total[-1]]), side="left")
            return [int(now.low[i]) for i in starts], enough
        nodes = groups.sparkSession.createDataFrame(
            list(zip(now.low[split].tolist(), now.width[split].tolist())), "node_low bigint, node_width bigint"
        )
        by_width = []
        for wide in np.unique(now.width[split]).tolist():
            inside = groups.join(
                F.broadcast(nodes.where(F.col("node_width") == wide)),  # bounded like the summary
                (F.col("group") - F.col("group") % wide) == F.col("node_low"),
                "left_semi",
            )
            part = max(1, wide // fan)
            by_width += told(F.col("group") - F.col("group") % part, F.lit(part), inside)
        finer = _summary(by_width)
        joined = [np.concatenate((x[~split], y)) for x, y in zip(vars(now).values(), vars(finer).values())]
        order = np.argsort(joined[0])
        now = Summary(*(x[order] for x in joined))


def shard_of(group: Column, starts: list[int]) -> Column:
    """Number of cuts at or before a group; a search by halves in a literal expression."""

    def within(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(group >= F.lit(starts[middle]), within(middle + 1, b)).otherwise(within(a, middle))

    return within(0, len(starts)).cast("int")


def with_shards(docs: DataFrame, text: str = "text", ident: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Add size, shard (0 to shards - 1) and slot (gapless from 0 in each shard) to each row; columns with these names are replaced.

    Slots are counted in slices of a shard and, over the slices' counts, between them.
    """
    group, part, before, turn = fresh(docs, "shard_group", "shard_slice", "shard_before", "shard_turn")
    body, key = fresh(docs, "shard_text", "shard_ident")
    docs, text, ident = docs.withColumns({body: docs[text], key: docs[ident]}), body, key
    sized = docs.withColumn("size", size_of(F.col(text))).withColumn(group, group_of(F.col(text)))
    groups = checkpointed(sized.groupBy(F.col(group).alias("group")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("held")))
    starts, _ = cuts(groups, shards)
    total = groups.agg(F.sum("held")).first()[0] or 0
    slices = max(LEAST_SLICES, next_power_of_two(-(-total // (shards * SLICE_ROWS))) * LEAST_SLICES)
    dealt = sized.withColumn("shard", shard_of(F.col(group), starts)).withColumn(
        part, F.pmod(F.xxhash64(F.col(ident)), F.lit(slices)).cast("int")
    )
    counts = dealt.groupBy("shard", part).agg(F.count(F.lit(1)).alias("held"))
    counts = numbered_groups(counts, ["shard"], [part], "held", before).drop("held")
    inside = Window.partitionBy("shard", part).orderBy(F.col(ident), F.col(group))
    # Both sides meet on the window's keys, so each row is dealt out once.
    placed = dealt.join(counts, ["shard", part]).withColumn(turn, F.row_number().over(inside))
    return placed.withColumn("slot", (F.col(before) + F.col(turn) - 1).cast("long")).drop(group, part, before, turn, body, key)


def assignment(docs: DataFrame, text: str = "text", ident: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, under the law `bytes`."""
    (crc,) = fresh(docs, "text_crc32")
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn(crc, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return with_shards(rows, "text", "doc_id", shards).select(
        "doc_id", "size", F.col(crc).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
