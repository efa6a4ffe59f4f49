"""Sharding by a minimax contiguous partition: equal texts stay together and the largest shard is as small as it can be.

Groups of equal texts are ordered by their hash. The driver never sees them all: it starts from the sums of
2^14 ranges of the hash and asks Spark for finer ranges only where a cut may fall, until the cuts fall between
whole groups. What it holds is bounded by the number of shards and ranges, not by the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ranked

SHARDS = 40
OVERHEAD = 16
#: Bits of the hash that the first ranges differ in, and that each refinement adds.
FIRST_BITS, STEP_BITS = 14, 6


class Ranges:
    """Consecutive ranges of hash values: first value, bits below the range, sum, largest group, number of groups."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.low = np.array([r[0] for r in rows], np.int64)
        self.shift = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([r[2] for r in rows], np.int64)
        self.top = max((r[3] for r in rows), default=0)
        self.n = np.array([r[4] for r in rows], np.int64)
        self.ends = np.concatenate(([0], np.cumsum(self.size)))

    def reach(self, at: int, capacity: int) -> int:
        """The furthest boundary that one shard from boundary `at` can end on."""
        return int(np.searchsorted(self.ends, self.ends[at] + capacity, "right")) - 1

    def feasible(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.reach(at, capacity)
        return at == len(self.size)

    def least_capacity(self, shards: int) -> int:
        """Binary search for the smallest capacity that the greedy check accepts."""
        total = int(self.ends[-1])
        low, high = max(-(-total // shards), self.top, 1), max(total, 1)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards) else (mid + 1, high)
        return low

    def cuts(self, shards: int) -> list[int]:
        """First hash values of shards 1 on, at most shards - 1.

        No shard exceeds the least capacity. Within that, a cut goes to the boundary nearest to an equal share of
        what is left, but not so early that the shards after it could not hold the rest.
        """
        capacity, total, last = self.least_capacity(shards), int(self.ends[-1]), len(self.size)
        earliest = [last]  # from the right: the first boundary from which the shards behind can hold the rest
        for _ in range(shards - 1):
            earliest.append(int(np.searchsorted(self.ends, self.ends[earliest[-1]] - capacity, "left")))
        earliest.reverse()
        found, at = [], 0
        for k in range(shards - 1):
            goal = self.ends[at] + (total - self.ends[at]) / (shards - k)
            near = int(np.searchsorted(self.ends, goal, "left"))
            if near > 0 and goal - self.ends[near - 1] <= self.ends[min(near, last)] - goal:
                near -= 1
            at = min(max(near, earliest[k], at), self.reach(at, capacity), last)
            if at < last:
                found.append(int(self.low[at]))
        return found


def _sums(groups: DataFrame, shift: int) -> list[tuple]:
    part = F.shiftright("key", shift)
    rows = groups.groupBy(part.alias("part")).agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["part"] << shift, shift, r["s"], r["m"], r["n"]) for r in rows]


def _within(rows: list[tuple]) -> Column:
    """Whether a key lies in one of the ranges, by (first value, bits below); a bounded list."""
    hit = F.lit(False)
    for shift in sorted({r[1] for r in rows}):
        hit = hit | F.shiftright("key", shift).isin([r[0] >> shift for r in rows if r[1] == shift])
    return hit


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """Keys at which shards 1, 2, ... begin, for groups (key, bytes) with distinct keys, ordered by key."""
    rows = _sums(groups, 64 - FIRST_BITS)
    while rows:
        ranges = Ranges(rows)
        floor = max(-(-int(ranges.ends[-1]) // shards), ranges.top)
        many = (ranges.n > 1) & (ranges.shift > 0)
        wanted = many & (ranges.size > floor)
        if not wanted.any():
            capacity, total = ranges.least_capacity(shards), int(ranges.ends[-1])
            if capacity > floor:
                # a cut k of any partition within the capacity lies between these two sums
                for k in range(1, shards):
                    a, b = total - (shards - k) * capacity, k * capacity
                    wanted |= many & (ranges.ends[1:] >= a) & (ranges.ends[:-1] <= b)
        if not wanted.any():
            return ranges.cuts(shards)
        lows = set(ranges.low[wanted].tolist())
        split = [r for r in rows if r[0] in lows]
        rows = [r for r in rows if r[0] not in lows]
        for shift in sorted({r[1] for r in split}):
            rows += _sums(groups.where(_within([r for r in split if r[1] == shift])), max(0, shift - STEP_BITS))
    return []


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) under the law `bytes`: sizes near equal, equal texts in one shard.

    Null texts have size OVERHEAD, a null checksum and form one group; rows with equal or null ids are separate
    rows. A group larger than an equal share has a shard of at least its own size. With few groups some shards
    stay empty; an empty table gives an empty result. Texts of any length count whole. Other columns, whatever their
    names, are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col).alias("key"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    cuts = minimax_cuts(groups, shards)
    shard = sum(((F.col("key") >= F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")
    return ranked(rows.withColumn("shard", shard), ["shard"], ["key", "id", "text_crc32"], "slot", tie="row").drop("key", "row")


def op7(docs: DataFrame) -> DataFrame:
    return sharded(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
