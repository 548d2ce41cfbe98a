"""Integrity, delivery guarantees, clean markers, the monotone clock and flush schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros
from ..model import CorruptEntry
from ..plans.prefix import previous, running


def verify(log: DataFrame, computed: Column, on_corrupt: str = "stop") -> DataFrame:
    """Entries whose stored checksum holds.

    `stop` ends each topic before its first bad entry, `skip` leaves out the bad
    entries only, `fail` raises.
    """
    bad = ~F.coalesce(computed == F.col("checksum"), F.lit(False))
    if on_corrupt == "skip":
        return log.where(~bad)
    first = log.where(bad).groupBy("topic").agg(F.min("seq").alias("__first"))
    if on_corrupt == "fail":
        found = first.limit(5).collect()
        if found:
            raise CorruptEntry(", ".join(f"{r.topic} at {r['__first']}" for r in found))
        return log
    # what comes before a topic's first bad entry is sound, so checksums are computed once
    return log.join(first, "topic", "left").where(F.col("__first").isNull() | (F.col("seq") < F.col("__first"))).drop("__first")


def valid_prefix(packed: DataFrame, bad: Column) -> DataFrame:
    """Entries before the first bad one of their block; other blocks are not affected."""
    upto = Window.partitionBy("topic", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return packed.withColumn("__bad", F.max(bad.cast("int")).over(upto)).where("__bad = 0").drop("__bad")


def durable_point(reads: Column, every: Column) -> Column:
    """Reads that survive a crash when every k-th is made durable; k of 0 counts as 1."""
    k = F.greatest(every, F.lit(1))
    return (F.floor(reads / k) * k).cast("bigint")


def replayed(reads: Column, every: Column) -> Column:
    """Entries delivered again after a crash."""
    return (reads - durable_point(reads, every)).cast("bigint")


def generations(flags: DataFrame, key: str, order: str, clean: str) -> DataFrame:
    """Final clean flag of each key and how often the flag changed; a key begins clean.

    The order must be unique within a key.
    """
    before = previous(flags, [key], order, {"__before": clean})
    changed = F.coalesce(F.col("__before"), F.lit(True)) != F.col(clean)
    return before.groupBy(key).agg(F.count_if(changed).alias("generation"), F.max_by(clean, order).alias("is_clean"))


def monotone_clock(ticks: DataFrame, order: str, millis: str) -> DataFrame:
    """Add `clock`: each reading at least one above the one before, c[i] = max(t[i], c[i-1] + 1), from 0.

    Closed form: with i the 0-based position, max over j <= i of (t[j] - j), at
    least 1, plus i.  The order is an integer; nulls come last, and rows of equal
    order stand by their readings.
    """
    placed = ticks.withColumns({"__all": F.lit(0), "__at": F.coalesce(F.col(order), F.lit(2**63 - 1)), "__null": F.col(order).isNull()})
    ranked = running(placed, ["__all"], "__at", {"__i": ("sum", F.lit(1).cast("bigint"))}, exclusive=True, ties=["__null", millis]).drop("__at", "__null")
    # by position, which is unique: ties would not have to stand as they were numbered
    best = running(ranked, ["__all"], "__i", {"__m": ("max", F.col(millis) - F.col("__i"))})
    return best.withColumn("clock", F.greatest(F.col("__m"), F.lit(1)) + F.col("__i")).drop("__all", "__i", "__m")


def coalesced_flushes(writes: DataFrame, ts: str, path: str, tick: str) -> DataFrame:
    """Distinct dirty paths of each tick that has any: what one flush round touches."""
    return writes.groupBy(F.window(ts, tick).start.alias("bucket")).agg(F.countDistinct(path).alias("paths"))


def overlapping(batches: DataFrame, range_size: int = 3_600_000_000) -> DataFrame:
    """Batches (topic, batch, start_ts, end_ts) that began while another one of their topic ran.

    The later of two is refused; the largest end among the earlier ones tells.
    Starts are times or integers; `range_size` is in microseconds, or units, of them.
    """
    whole = batches.schema["start_ts"].dataType.typeName() in ("long", "integer", "short", "byte")
    timed = batches.withColumn("__at", F.col("start_ts") if whole else micros(F.col("start_ts")))
    placed = running(timed, ["topic"], "__at", {"__end": ("max", F.col("end_ts"))}, range_size, exclusive=True, ties=["batch"])
    return placed.where(F.col("start_ts") < F.col("__end")).drop("__at", "__end")


_ACK = {"ok": 0, "checksum": 1, "error": 2}  # fixed values of the protocol


def chunk_acks(sent: DataFrame, received: DataFrame, key: str = "chunk") -> DataFrame:
    """Status byte for each chunk sent (key, size, sha256): 0 if it came whole, 1 if its checksum differs, 2 if it is missing or of another size.

    `received` has key and content; of several the first whole one counts.
    """
    got = received.select(key, F.octet_length("content").cast("bigint").alias("__size"), F.sha2("content", 256).alias("__sha"))
    same_size = F.col("__size") == F.col("size")
    status = F.when(same_size & (F.col("__sha") == F.col("sha256")), _ACK["ok"]).when(same_size, _ACK["checksum"]).otherwise(_ACK["error"])
    return sent.join(got, key, "left").groupBy(key).agg(F.min(status).cast("int").alias("ack"))
