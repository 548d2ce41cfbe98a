"""Offsets, cursors, counts and stateless reads over a log DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import footprint
from ..model import HEADER_BYTES, MAX_BATCH_BYTES, MAX_BATCH_ENTRIES, MAX_ENTRY_BYTES, InvalidBatch
from ..plans.prefix import running


def topic_size(log: DataFrame) -> DataFrame:
    """Entries, payload bytes and stored bytes of each topic, consumed entries included."""
    size = F.col("payload_len")
    return log.groupBy("topic").agg(F.count("*").alias("entries"), F.sum(size).alias("payload_bytes"), F.sum(footprint(size)).alias("footprint"))


def offset_map(log: DataFrame, range_size: int = 1 << 18) -> DataFrame:
    """Add start_off and end_off of each entry in the byte space of its topic."""
    out = running(log, ["topic"], "seq", {"end_off": ("sum", footprint(F.col("payload_len")))}, range_size)
    return out.withColumn("start_off", F.col("end_off") - footprint(F.col("payload_len")))


def at_tail(positions: DataFrame, chain: DataFrame) -> DataFrame:
    """Where readers that stand in the writer's block go on once it is sealed.

    `positions` (topic, block_id, offset) name a block; `chain` (topic, block_id,
    place) are the sealed blocks of each topic in order.  Adds place and offset
    of the sealed copy; a position whose block is not in the chain begins at its
    start, place 0 and offset 0.
    """
    known = chain.select("topic", "block_id", F.col("place").alias("__place"))
    joined = positions.join(known, ["topic", "block_id"], "left")
    found = F.col("__place").isNotNull()
    return joined.withColumns({"place": F.coalesce("__place", F.lit(0)).cast("bigint"), "offset": F.when(found, F.col("offset")).otherwise(0).cast("bigint")}).drop("__place")


def at_cursor(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """The next unread entry of each topic: the one whose seq is the topic's cursor; a topic without cursor is at its start.

    Reading it moves nothing: a new cursor is the caller's to keep.
    """
    return log.join(cursors.select("topic", "cursor"), "topic", "left").where(F.col("seq") == F.coalesce("cursor", F.lit(0))).drop("cursor")


def unread(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Entries at or after each topic's cursor; never below zero."""
    counts = log.groupBy("topic").agg(F.count("*").alias("entries"))
    left = F.greatest(F.col("entries") - F.coalesce("cursor", F.lit(0)), F.lit(0))
    return counts.join(cursors.select("topic", "cursor"), "topic", "left").select("topic", left.cast("bigint").alias("unread"))


def recovered_unread(offsets: DataFrame, durable: DataFrame) -> DataFrame:
    """Unread entries rebuilt from durable byte offsets: those that end after the topic's offset."""
    placed = offsets.join(durable.select("topic", "durable_off"), "topic", "left")
    return placed.groupBy("topic").agg(F.count_if(F.col("end_off") > F.coalesce("durable_off", F.lit(0))).alias("unread"))


def stateless_read(offsets: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested byte offset, the entry that holds it and the payload bytes to trim from its start.

    An offset at or past the end of a topic finds nothing.  Offsets are sought in
    ranges of the byte space: every entry is dealt to the ranges it touches, so
    the search is an equi-join on topic and range whatever the topic's size.
    """
    width = 1 << 20
    ranges = F.sequence(F.floor(F.col("start_off") / width), F.floor((F.col("end_off") - 1) / width))
    dealt = offsets.select("topic", "seq", "start_off", "end_off", F.explode(ranges).alias("part"))
    asked = requests.select("topic", "req", F.floor(F.col("req") / width).alias("part"))
    found = dealt.join(asked, ["topic", "part"]).where("start_off <= req AND req < end_off")
    return found.select("topic", "req", "seq", F.greatest(F.col("req") - F.col("start_off") - HEADER_BYTES, F.lit(0)).cast("bigint").alias("trim"))


def read_from(offsets: DataFrame, requests: DataFrame) -> DataFrame:
    """All entries from each requested offset on, the first one's payload trimmed."""
    trimmed = F.greatest(F.col("req") - F.col("start_off") - HEADER_BYTES, F.lit(0))
    joined = offsets.join(requests.select("topic", "req"), "topic").where("end_off > req")
    return joined.withColumn("payload", F.expr(f"substring(cast(payload as binary), int(greatest(req - start_off - {HEADER_BYTES}, 0)) + 1)")).withColumn("trim", trimmed.cast("bigint"))


def batch_checks(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Entries, stored bytes and verdict of each batch by the batch limits."""
    size = footprint(F.col("payload_len"))
    sums = batches.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return sums.withColumn("ok", (F.col("n") <= MAX_BATCH_ENTRIES) & (F.col("bytes") <= MAX_BATCH_BYTES))


def entry_ok(payload_len: Column) -> Column:
    return footprint(payload_len) <= MAX_ENTRY_BYTES


def check_batch(batch: DataFrame) -> None:
    """Raise before anything is written if a batch breaks a limit; an empty batch is fine."""
    size = footprint(F.octet_length("payload").cast("bigint"))
    n, total, largest = batch.agg(F.count("*"), F.sum(size), F.max(size)).first()
    if n > MAX_BATCH_ENTRIES:
        raise InvalidBatch(f"{n} entries; a batch holds {MAX_BATCH_ENTRIES} at most")
    if (total or 0) > MAX_BATCH_BYTES or (largest or 0) > MAX_ENTRY_BYTES:
        raise InvalidBatch("too many bytes")
