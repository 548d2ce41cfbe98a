"""Tables as topic logs.

A log row has topic, seq (0-based, gapless per topic), payload, payload_len and
append_ts where the table has a time, beside the table's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import footprint
from ..plans.prefix import running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_log(df: DataFrame, topic: Column, order: str, payload: Column, keep: tuple[str, ...] = (), range_size: int | None = None, offsets: bool = False) -> DataFrame:
    """Log of a table: one entry a row, numbered per topic by a unique integer column.

    With `offsets` it also has start_off and end_off, found in the same pass.
    """
    base = df.select(topic.alias("topic"), payload.alias("payload"), *dict.fromkeys((order, *keep))).withColumn("payload_len", F.octet_length("payload").cast("bigint"))
    size = {} if range_size is None else {"range_size": range_size}
    values = {"seq": ("sum", F.lit(1).cast("bigint"))}
    if offsets:
        values["start_off"] = ("sum", footprint(F.col("payload_len")))
    out = running(base, ["topic"], order, values, exclusive=True, **size)
    return out.withColumn("end_off", F.col("start_off") + footprint(F.col("payload_len"))) if offsets else out


def events_log(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    payload = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    return as_log(table(spark, sf_dir, "events"), F.col("event_type"), "event_id", payload, ("user_id", "ts"), offsets=offsets)


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "documents"), F.col("source"), "doc_id", F.col("text"))


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "conversations"), F.col("conv_id").cast("string"), "turn", F.col("text"), ("conv_id", "role"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), "o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus"))
