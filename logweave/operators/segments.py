"""Segments: rollover, leaders, sealed counts, cursors over segments, and the model's invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import initial_leader, micros
from ..plans.prefix import running
from .blocks import grouped, room_rule


def segment_of(seq: Column, size: int) -> Column:
    """A topic rolls over right after its `size`-th entry, so a segment is a matter of position."""
    return (F.floor(seq / size) + 1).cast("bigint")


def segment_table(log: DataFrame, size: int) -> DataFrame:
    """Segments of each topic with first entry and entries; a topic just rolled over has an empty open one."""
    full = log.groupBy("topic", segment_of(F.col("seq"), size).alias("segment")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    totals = full.groupBy("topic").agg(F.sum("n").alias("total"))
    empty = totals.where(F.col("total") % size == 0).select("topic", segment_of(F.col("total"), size).alias("segment"), F.col("total").alias("first_seq"), F.lit(0).cast("bigint").alias("n"))
    return full.unionByName(empty)


def with_open(segments: DataFrame) -> DataFrame:
    """Add the topic's open segment, its largest, as `current`."""
    return segments.join(segments.groupBy("topic").agg(F.max("segment").alias("current")), "topic")


def tick_rollover(log: DataFrame, ts: str, tick: str, size: int) -> DataFrame:
    """Segments of topics that are only looked at once a tick: one is sealed at the first tick that finds `size` entries or more.

    Entries are counted by tick first; a tick's entries join the open segment as
    long as that holds fewer than `size`.
    """
    counts = log.groupBy("topic", micros(F.window(ts, tick).start).alias("tick")).agg((-F.count("*")).alias("payload_len"))
    ranked = running(counts, ["topic"], "tick", {"seq": ("sum", F.lit(1).cast("bigint"))}, 1_000_000 * 86_400 * 366, exclusive=True)
    placed = grouped(ranked, room_rule(size), ("group", "held"))
    return placed.groupBy("topic", (F.col("group") + 1).alias("segment")).agg(F.sum(F.abs("payload_len")).alias("n"))


def leader_of(topic: Column, segment: Column, nodes: int) -> Column:
    """Leaders take turns: each rollover passes the topic to the next node (1-based)."""
    return (F.pmod(initial_leader(topic, nodes) + segment - 1, F.lit(nodes)) + 1).cast("bigint")


def with_leader(entries: DataFrame, leaders: DataFrame, current: DataFrame) -> DataFrame:
    """Add the recorded leader of each entry's segment (topic, segment, leader), else its topic's current one (topic, leader)."""
    recorded = leaders.select("topic", "segment", F.col("leader").alias("__recorded"))
    now = current.select("topic", F.col("leader").alias("__now"))
    joined = entries.join(recorded, ["topic", "segment"], "left").join(now, "topic", "left")
    return joined.withColumn("leader", F.coalesce("__recorded", "__now")).drop("__recorded", "__now")


def with_address(rows: DataFrame, nodes: DataFrame, node: str = "leader") -> DataFrame:
    """Add the address of a node column from the node table (node, address); null for an unknown node."""
    return rows.join(nodes.select(F.col("node").alias(node), "address"), node, "left")


def next_leader(voters: Column, me: Column) -> Column:
    """The voter after `me` in sorted order; the first one if `me` is none."""
    ordered = F.array_sort(voters)
    return F.element_at(ordered, F.pmod(F.array_position(ordered, me), F.size(ordered)).cast("int") + 1)


def sealed_cumulative(segments: DataFrame) -> DataFrame:
    """Entries of each sealed segment and of all sealed ones up to it."""
    sealed = with_open(segments).where("segment < current")
    upto = Window.partitionBy("topic").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return sealed.select("topic", "segment", F.col("n").alias("sealed"), F.sum("n").over(upto).alias("cum"))


def locate(consumed: Column, size: int) -> tuple[Column, Column]:
    """Segment and entries delivered in it after `consumed` reads.

    A reader at the end of a segment stays there until its next read.
    """
    segment = F.when(consumed == 0, 1).otherwise(F.floor((consumed - 1) / size) + 1).cast("bigint")
    return segment, (consumed - (segment - 1) * size).cast("bigint")


def advance(cursors: DataFrame, segments: DataFrame) -> DataFrame:
    """One read of each cursor (topic, segment, delivered): the entry's seq, or null if there is none, and the new cursor.

    Segment 0 means the first.  Exhausted sealed segments are passed, several if
    some are empty; on the open segment a reader waits.  Each segment knows the
    next one that has entries, so a cursor meets one segment only.
    """
    later = Window.partitionBy("topic").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    full = F.min(F.when(F.col("n") > 0, F.struct(F.col("segment").alias("s"), "first_seq"))).over(later)
    table = with_open(segments).withColumn("full", full).withColumnRenamed("segment", "s")
    at = F.greatest(F.col("segment"), F.lit(1))
    met = cursors.withColumn("s", at).join(table, ["topic", "s"])
    here = F.col("n") > F.col("delivered")
    found = here | F.col("full").isNotNull()
    return met.select(
        "topic",
        "segment",
        "delivered",
        F.when(here, F.col("first_seq") + F.col("delivered")).otherwise(F.col("full.first_seq")).alias("seq"),
        F.when(here, F.col("s")).otherwise(F.coalesce("full.s", "current")).alias("new_segment"),
        F.when(here, F.col("delivered") + 1).when(found, 1).when(F.col("s") == F.col("current"), F.col("delivered")).otherwise(0).cast("bigint").alias("new_delivered"),
    )


def ownership(segments: DataFrame, nodes: int) -> DataFrame:
    """Open topics led by each node that leads any."""
    open_ = with_open(segments).where("segment = current")
    return open_.groupBy(leader_of(F.col("topic"), F.col("current"), nodes).alias("node")).agg(F.count("*").alias("open_topics"))


def invariants(log: DataFrame, segments: DataFrame, states: DataFrame, size: int, nodes: int) -> DataFrame:
    """Violations of the model's invariants, by name; all zero on a sound log.

    `segments` (topic, segment, first_seq, n) and `states` (topic,
    current_segment, last_sealed, leader) are what the metadata says; both are
    held against the entries of the log.
    """
    placed = log.select("topic", "seq", segment_of(F.col("seq"), size).alias("segment"))
    counted = placed.groupBy("topic", "segment").agg(F.count("*").alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.countDistinct("seq").alias("distinct_seq"))
    current = states.select("topic", "current_segment")
    told = segments.join(current, "topic")
    joined = told.join(counted, ["topic", "segment"], "left")
    sealed = told.where("segment < current_segment").groupBy("topic").agg(F.sum("n").alias("sealed"))
    summed = states.join(sealed, "topic", "left")
    stray = placed.join(current, "topic").where("segment > current_segment")
    turn = leader_of(F.col("topic"), F.col("current_segment"), nodes)
    checks = [
        ("no_rows_after_open", stray.agg(F.count("*").alias("violations"))),
        ("sealed_count_matches", joined.where("segment < current_segment").agg(F.count_if(F.coalesce("rows", F.lit(0)) != F.col("n")).alias("violations"))),
        ("last_sealed_is_sum", summed.agg(F.count_if(F.coalesce("sealed", F.lit(0)) != F.col("last_sealed")).alias("violations"))),
        ("contiguous_order", counted.agg(F.count_if((F.col("high") - F.col("low") + 1 != F.col("rows")) | (F.col("distinct_seq") != F.col("rows"))).alias("violations"))),
        ("open_leader_valid", states.agg(F.count_if(~F.coalesce((F.col("leader") == turn) & F.col("leader").between(1, nodes), F.lit(False))).alias("violations"))),
    ]
    out = None
    for name, df in checks:
        row = df.select(F.lit(name).alias("invariant"), F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))
        out = row if out is None else out.unionAll(row)
    return out
