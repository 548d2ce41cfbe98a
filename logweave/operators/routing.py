"""Leases, as-of leaders, request pairs and the line protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_command
from ..plans.prefix import RANGE_ROWS, previous, running

VERBS = ("REGISTER", "PUT", "GET", "STATE", "METRICS")


def fenced(writes: DataFrame, leases: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Writes that hold the lease of their key, and those that do not.

    No side is broadcast by hint: lease tables grow with topics, and Spark knows
    their size.
    """
    held = leases.select(key).distinct()
    return writes.join(held, key, "left_semi"), writes.join(held, key, "left_anti")


def lease_changes(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Keys to grant and to revoke to get from one lease set to another."""
    granted = new.select(key).exceptAll(old.select(key)).withColumn("change", F.lit("granted"))
    return granted.unionAll(old.select(key).exceptAll(new.select(key)).withColumn("change", F.lit("revoked")))


def unknown_topics(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests for topics that the catalog does not have."""
    return requests.join(catalog.select("topic").distinct(), "topic", "left_anti")


def delayed(messages: DataFrame, slow: DataFrame, source: str = "src", target: str = "dst", ts: str = "ts") -> DataFrame:
    """Add `arrives`: sent time plus the delay of its pair (src, dst, millis), whichever way it goes; the largest of several."""
    pair = [F.least(source, target).alias("__a"), F.greatest(source, target).alias("__b")]
    waits = slow.select(*pair, "millis").groupBy("__a", "__b").agg(F.max("millis").alias("__millis"))
    joined = messages.select("*", *pair).join(waits, ["__a", "__b"], "left")
    return joined.withColumn("arrives", F.col(ts) + F.make_dt_interval(secs=F.coalesce("__millis", F.lit(0)) / 1000)).drop("__a", "__b", "__millis")


def range_width(rows: DataFrame, order: str, rows_a_range: int = RANGE_ROWS) -> int:
    """Width of a range of an integer order that holds about so many rows, if the orders are spread evenly."""
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    return max(1, (high - low + 1) * rows_a_range // n) if n and high is not None else 1


def as_of(events: DataFrame, changes: DataFrame, key: str, order: str, value: str, range_size: int | None = None) -> DataFrame:
    """Add to each event the value of the latest change of its key at or before it, by an integer order.

    Both sides are one relation of which changes are a running last value, so
    neither is looped over nor compared pair by pair.  Without `range_size` the
    width of a range is that of `range_width`, found in a pass over the events.
    """
    left = events.withColumns({"__is_change": F.lit(1), "__value": F.lit(None).cast(changes.schema[value].dataType)})
    right = changes.select(key, F.col(order), F.col(value).alias("__value")).withColumn("__is_change", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    last = F.when(F.col("__is_change") == 0, F.struct(F.col(order).alias("o"), F.col("__value").alias("v")))
    width = range_size or range_width(events, order)
    placed = running(both, [key], order, {"__last": ("max", last)}, range_size=width, ties=["__is_change"])
    return placed.where("__is_change = 1").withColumn(value, F.col("__last.v")).drop("__is_change", "__value", "__last")


def reply_pairs(turns: DataFrame, conversation: str, turn: str, role: str, asks: str = "user", answers: str = "assistant") -> DataFrame:
    """Each asking turn with the next answering turn of its conversation; asking turns without one are left out."""
    after = Window.partitionBy(conversation).orderBy(turn).rowsBetween(1, Window.unboundedFollowing)
    reply = F.min(F.when(F.col(role) == answers, F.col(turn))).over(after)
    return turns.withColumn("reply_turn", reply).where((F.col(role) == asks) & F.col("reply_turn").isNotNull()).select(conversation, turn, "reply_turn")


def matched_calls(requests: DataFrame, responses: DataFrame, timeout_seconds: int) -> DataFrame:
    """Requests (id, ts) with their first response in time; the others have a null response."""
    answer = responses.select("id", F.col("ts").alias("answered"))
    late = F.col("ts") + F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    joined = requests.join(answer, "id", "left").withColumn("answered", F.when(F.col("answered").between(F.col("ts"), late), F.col("answered")))
    return joined.groupBy("id", "ts").agg(F.min("answered").alias("answered"))


def parse_commands(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add verb, topic, payload and error of protocol lines; error is null for a valid line."""
    parts = split_command(F.col(line))
    verb, topic, payload = (F.get(parts, F.lit(k)) for k in range(3))
    missing = topic.isNull() | (topic == "")
    error = (
        F.when(~verb.isin(*VERBS), "unknown command")
        .when(verb.isin("REGISTER", "PUT", "GET", "STATE") & missing, F.concat(verb, F.lit(" requires a topic")))
        .when((verb == "PUT") & payload.isNull(), "PUT requires a payload")
    )
    return lines.withColumns({"verb": verb, "topic": topic, "payload": payload, "error": error})


def dropped(messages: DataFrame, cut: DataFrame, source: str = "src", target: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Messages that pass a network partition and those on a cut pair, by the unordered pairs of `cut`."""
    pair = [F.least(source, target).alias("__a"), F.greatest(source, target).alias("__b")]
    keyed = messages.select("*", *pair)
    gone = cut.select(*pair).distinct()
    return keyed.join(gone, ["__a", "__b"], "left_anti").drop("__a", "__b"), keyed.join(gone, ["__a", "__b"], "left_semi").drop("__a", "__b")


def consecutive_distinct(log: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Rows that differ from the row before them; the integer order is unique within a key."""
    named = log.withColumn("__value", value)
    return previous(named, keys, order, {"__before": "__value", "__seen": order}).where(F.col("__seen").isNull() | ~F.col("__before").eqNullSafe(F.col("__value"))).drop("__value", "__before", "__seen")


def order_check(log: DataFrame, expected: Column) -> DataFrame:
    """Whether every entry of a topic stands where its own number says."""
    return log.groupBy("topic").agg(F.bool_and(F.coalesce(F.col("seq") == expected, F.lit(False))).alias("ok"))
