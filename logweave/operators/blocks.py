"""Order-dependent folds: next-fit blocks, read pages, files and what can be reclaimed.

In a fold the group of an entry depends on all entries of its topic before it.
But a group that begins at entry i ends where the lengths after i say, whatever
came before.  So a topic is cut into chunks of entries, in three passes over
lengths only:

1. each chunk, alone, finds for every place where its first new group may begin
   which group would be open at its end, and how many groups there are until
   then (by doubling jumps from group to group);
2. the chunks of a topic are chained by their short summaries;
3. each chunk is folded from the state that the chain gives it.

The first and last pass are parallel over chunks, so a topic of any size is
spread over all tasks; the second one reads a summary of one group's length a
chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BLOCK_BYTES, FILE_BLOCKS, HEADER_BYTES, MAX_BATCH_ENTRIES
from ..plans.prefix import running


CHUNK_ENTRIES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A greedy grouping: where the group that begins at an entry ends, and the state before a topic's first entry.

    A state is (group number, capacity, used, entries).  An entry joins the open
    group if it fits into it; one whose length is given as a negative number
    joins if there is any room left, and may overfill it.
    """

    first: tuple[int, int, int, int]
    header: int
    room: int  # largest capacity left after a group's first entry, or before a topic's first entry
    entries: int  # most entries of a group
    capacity: Callable[[np.ndarray], np.ndarray]  # of a group by its first entry's size

    def sizes(self, lengths: np.ndarray) -> np.ndarray:
        return np.abs(lengths) + self.header

    def needs(self, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Up to where a group that began at 0 must reach, for each entry to join it; ascending like the ends."""
        return np.where(lengths < 0, ends - self.sizes(lengths) + 1, ends)

    def boundary(self, needs: np.ndarray, state: tuple) -> int:
        """First entry that does not join the open group."""
        _, capacity, used, entries = state
        return min(int(np.searchsorted(needs, capacity - used, side="right")), max(0, self.entries - entries))

    def next_starts(self, sizes: np.ndarray, ends: np.ndarray, needs: np.ndarray) -> np.ndarray:
        at = np.arange(len(sizes))
        stop = np.searchsorted(needs, ends - sizes + self.capacity(sizes), side="right")
        return np.maximum(np.minimum(stop, at + self.entries), at + 1)


_NEVER = 1 << 62


def block_rule(unit: int, whole_units: bool = True) -> Rule:
    """Next-fit blocks: an entry that does not fit opens one of its own size rounded up to units.

    Without `whole_units` the new block is just large enough.  A topic's first
    block is one unit.
    """

    def capacity(sizes: np.ndarray) -> np.ndarray:
        return -(-sizes // unit) * unit if whole_units else np.maximum(sizes, unit)

    return Rule((0, unit, 0, 0), HEADER_BYTES, unit, _NEVER, capacity)


def page_rule(max_bytes: int, max_entries: int) -> Rule:
    """Read pages: closed when another entry would pass the budget, unless empty, or when full of entries.

    Headers do not count, and empty payloads are entries like any other.
    """
    return Rule((-1, -1, 0, max_entries), 0, max_bytes, max_entries, lambda sizes: np.full(len(sizes), max_bytes, dtype=np.int64))


def room_rule(capacity: int) -> Rule:
    """Groups of equal capacity, the first one open and empty."""
    return Rule((0, capacity, 0, 0), 0, capacity, _NEVER, lambda sizes: np.full(len(sizes), capacity, dtype=np.int64))


def fold(lengths: np.ndarray, state: tuple, rule: Rule) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Group and offset in the group of each entry, and the state after them."""
    sizes = rule.sizes(lengths)
    ends = np.cumsum(sizes)
    needs = rule.needs(lengths, ends)
    groups, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    group, capacity, used, entries = state
    at, before = 0, 0
    while at < len(sizes):
        stop = min(int(np.searchsorted(needs, before + capacity - used, side="right")), at + max(0, rule.entries - entries))
        if stop <= at:
            # the next entry begins a group, and fits it even if it is larger than the group should be
            group, capacity, used, entries = group + 1, int(rule.capacity(sizes[at : at + 1])[0]), 0, 0
            stop = max(at + 1, min(int(np.searchsorted(needs, before + capacity, side="right")), at + rule.entries))
        groups[at:stop] = group
        offsets[at:stop] = used + ends[at:stop] - sizes[at:stop] - before
        used += int(ends[stop - 1]) - before
        entries += stop - at
        before, at = int(ends[stop - 1]), stop
    return groups, offsets, (group, capacity, used, entries)


def summarize(lengths: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """What chaining needs of a chunk: running sizes up to a group's room, and for a first boundary at each of these places the groups and the open group's start and capacity at the end."""
    sizes = rule.sizes(lengths)
    ends, n = np.cumsum(sizes), len(sizes)
    needs = rule.needs(lengths, ends)
    jump = np.append(rule.next_starts(sizes, ends, needs), n)
    last, count = np.append(np.arange(n), -1), np.append(np.ones(n, dtype=np.int64), 0)
    while (jump[:n] < n).any():
        inside = jump < n
        last = np.where(inside, last[jump], last)
        count = count + count[jump]
        jump = jump[jump]
    k = min(n, int(np.searchsorted(needs, rule.room, side="right")) + 1, rule.entries + 1)
    start = last[:k]
    return {"ends": needs[:k], "count": count[:k], "used": ends[-1] - ends[start] + sizes[start], "capacity": rule.capacity(sizes[start]), "entries": n - start}


def chain(state: tuple, total: int, n: int, summary: dict[str, np.ndarray], rule: Rule) -> tuple:
    """State after a chunk of `n` entries and `total` bytes, from the state before it."""
    j = rule.boundary(summary["ends"], state)
    group, capacity, used, entries = state
    if j >= len(summary["ends"]):  # all of a chunk that is no larger than its summary fits
        return group, capacity, used + total, entries + n
    return group + int(summary["count"][j]), int(summary["capacity"][j]), int(summary["used"][j]), int(summary["entries"][j])


_STATE = ("__group", "__capacity", "__used", "__entries")
_PARTS = ("ends", "count", "used", "capacity", "entries")


def _runs(batch: pa.RecordBatch, columns: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of a batch in which the columns do not change."""
    change = np.zeros(batch.num_rows, dtype=bool)
    for c in columns:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    begin = np.flatnonzero(change).tolist()
    return list(zip([0, *begin], [*begin, batch.num_rows], strict=True)) if batch.num_rows else []


def grouped(log: DataFrame, rule: Rule, names: tuple[str, str], keep: tuple[str, ...] = (), chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """topic, seq, payload_len, `keep`, and two columns with the group (0-based per topic) and the offset in it."""
    size = F.coalesce(F.col("payload_len").cast("bigint"), F.lit(0))
    rows = log.select("topic", F.col("seq").cast("bigint").alias("seq"), size.alias("payload_len"), *keep).withColumn("__chunk", F.floor(F.col("seq") / chunk_entries).cast("bigint"))
    topic = rows.schema["topic"]
    binary = [T.StructField(p, T.BinaryType()) for p in _PARTS]
    told = T.StructType([topic, T.StructField("__chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()), *binary])

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        lengths = table.column("payload_len").to_numpy()
        made = summarize(lengths, rule)
        head = [table.column("topic").slice(0, 1), table.column("__chunk").slice(0, 1), pa.array([len(lengths)], pa.int64()), pa.array([int(rule.sizes(lengths).sum())], pa.int64())]
        return pa.Table.from_arrays([*head, *(pa.array([made[p].astype("<i8").tobytes()], pa.binary()) for p in _PARTS)], told.fieldNames())

    states = T.StructType([topic, T.StructField("__chunk", T.LongType()), *(T.StructField(s, T.LongType()) for s in _STATE)])

    def chained(batches):
        current, state = object(), rule.first
        for batch in batches:
            found = []
            for name, n, total, *parts in zip(*(batch.column(c).to_pylist() for c in ("topic", "n", "total", *_PARTS)), strict=True):
                if name != current:
                    current, state = name, rule.first
                found.append(state)
                state = chain(state, total, n, {p: np.frombuffer(x, dtype="<i8") for p, x in zip(_PARTS, parts, strict=True)}, rule)
            yield pa.RecordBatch.from_arrays([batch.column("topic"), batch.column("__chunk"), *(pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * 4))], states.fieldNames())

    chunks = rows.select("topic", "__chunk", "seq", "payload_len").groupBy("topic", "__chunk").applyInArrow(summary, told)
    before = chunks.repartition("topic").sortWithinPartitions("topic", "__chunk").mapInArrow(chained, states)
    out = T.StructType([*(f for f in rows.schema.fields if f.name != "__chunk"), *(T.StructField(n, T.LongType()) for n in names)])

    def assign(batches):
        current, state = object(), None
        for batch in batches:
            parts = []
            for a, b in _runs(batch, ("topic", "__chunk")):
                key = (batch.column("topic")[a].as_py(), batch.column("__chunk")[a].as_py())
                if key != current:
                    current, state = key, tuple(batch.column(s)[a].as_py() for s in _STATE)
                groups, offsets, state = fold(batch.column("payload_len").slice(a, b - a).to_numpy(), state, rule)
                parts.append((groups, offsets))
            made = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, dtype=np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in out.fieldNames()[:-2]), *(pa.array(x, pa.int64()) for x in made)], out.fieldNames())

    joined = rows.alias("l").join(before.alias("r"), F.col("l.topic").eqNullSafe(F.col("r.topic")) & (F.col("l.__chunk") == F.col("r.__chunk"))).select("l.*", *(F.col(f"r.{s}") for s in _STATE))
    return joined.repartition("topic", "__chunk").sortWithinPartitions("topic", "__chunk", "seq").mapInArrow(assign, out)


def pack_blocks(log: DataFrame, unit: int = BLOCK_BYTES, batched: bool = False, keep: tuple[str, ...] = (), chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """Add block (0-based per topic) and block_off to each entry; `batched` sizes new blocks as batch appends do."""
    return grouped(log, block_rule(unit, not batched), ("block", "block_off"), keep, chunk_entries)


def block_stats(packed: DataFrame) -> DataFrame:
    """First entry, entries and used bytes of each block."""
    return packed.groupBy("topic", "block").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.sum(F.col("payload_len") + HEADER_BYTES).alias("used"))


def page_reads(log: DataFrame, max_bytes: int, max_entries: int = MAX_BATCH_ENTRIES, chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """Pages of a reader that drains each topic: first entry, entries and payload bytes."""
    paged = grouped(log, page_rule(max_bytes, max_entries), ("page", "page_off"), chunk_entries=chunk_entries)
    return paged.groupBy("topic", "page").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


def place_files(blocks: DataFrame, order: str, per_file: int = FILE_BLOCKS) -> DataFrame:
    """Add file_no to blocks of equal size, which fill files in the order they were opened, all topics together.

    `order` must be unique: for instance the append position of the first entry.
    """
    ranked = running(blocks.withColumn("__all", F.lit(0)), ["__all"], order, {"__rank": ("sum", F.lit(1).cast("bigint"))}, exclusive=True)
    return ranked.withColumn("file_no", F.floor(F.col("__rank") / per_file).cast("bigint")).drop("__all", "__rank")


def place_sized(blocks: DataFrame, order: str, size: str = "size", first: str = "first", file_bytes: int = FILE_BLOCKS * BLOCK_BYTES, chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """file_no and file_off of blocks of any size, in the order they were opened, all topics together.

    The first block of a topic goes into the open file if that has any room left;
    any other only if it fits, or else begins a new file.  `order` is a unique
    integer; returns it with the size and the two new columns.
    """
    lengths = F.when(F.col(first), -F.col(size)).otherwise(F.col(size)).cast("bigint")
    ranked = running(blocks.select(F.lit(0).alias("topic"), F.col(order), lengths.alias("payload_len")), ["topic"], order, {"seq": ("sum", F.lit(1).cast("bigint"))}, exclusive=True)
    placed = grouped(ranked, room_rule(file_bytes), ("file_no", "file_off"), (order,), chunk_entries)
    return placed.select(order, F.abs("payload_len").alias(size), "file_no", "file_off")


def reclaimable(blocks: DataFrame, per_file: int = FILE_BLOCKS) -> DataFrame:
    """Whether each file can be deleted: all its slots given out, none open, and every block consumed.

    Needs file_no and the booleans is_open and consumed.
    """
    whole = (F.count("*") == per_file) & (F.count_if("is_open") == 0) & (F.count_if("consumed") >= F.count("*"))
    return blocks.groupBy("file_no").agg(whole.alias("reclaim"))
