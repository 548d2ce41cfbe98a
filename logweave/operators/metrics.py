"""Rates, logarithmic histograms and benchmark sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_minimum, histogram_bucket, micros
from ..plans.prefix import RANGE_ROWS, previous

# Columns of the benchmark sample files.
SAMPLES = {
    "writes": "timestamp bigint, elapsed_seconds double, writes_per_second double, bytes_per_second double, total_writes bigint, total_bytes bigint, dirty_pages_kb bigint, dirty_ratio_percent double",
    "batch": "timestamp bigint, elapsed_seconds double, batches_per_second double, entries_per_second double, bytes_per_second double, total_batches bigint, total_entries bigint, total_bytes bigint, dirty_pages_kb bigint, dirty_ratio_percent double",
    "reads": "timestamp bigint, elapsed_seconds double, phase string, write_mb_per_sec double, read_mb_per_sec double, total_write_mb double, total_read_mb double, dirty_pages_kb bigint, dirty_ratio_percent double",
    "scaling": "threads int, throughput double",
}


def read_samples(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.csv(path, schema=SAMPLES[kind], header=True)


def rates(samples: DataFrame, keys: list[str], ts: str, total: str, seconds: float = 0.5, range_size: int = RANGE_ROWS) -> DataFrame:
    """Add `rate`: growth of a running total since the sample before, by the sampling interval.

    Samples are in the order of `ts`, an integer, or a time counted in seconds;
    `range_size` is the width of a range in its units.
    """
    whole = samples.schema[ts].dataType.typeName() in ("long", "integer", "short", "byte")
    timed = samples.withColumn("__at", F.col(ts) if whole else micros(F.col(ts)))
    before = previous(timed, keys, "__at", {"__before": total}, range_size if whole else range_size * 1_000_000)
    return before.withColumn("rate", (F.col(total) - F.col("__before")) / F.lit(seconds)).drop("__at", "__before")


def write_samples(samples: DataFrame, path: str, kind: str) -> None:
    """Samples as CSV files with a header, in the columns of their kind."""
    names = [f.split()[0] for f in SAMPLES[kind].split(", ")]
    samples.select(*names).write.mode("overwrite").option("header", True).csv(path)


def totals(samples: DataFrame, keys: list[str], total: str, elapsed: str, rate: str) -> DataFrame:
    """Total, average and largest rate of each series."""
    return samples.groupBy(*keys).agg(F.max(total).alias("total"), (F.max(total) / F.max(elapsed)).alias("avg_rate"), F.max(rate).alias("max_rate"))


def rate_series(rows: DataFrame, ts: str, unit: str) -> DataFrame:
    """Rows of each time bucket that has any, and the change since the bucket before.

    Counts are summed before the window, which therefore sees one row a bucket.
    """
    counts = rows.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("bucket")))


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    return rows.where(value.isNotNull()).groupBy(histogram_bucket(value).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(hist: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Smallest value of the bucket in which each share of the counts is reached; 0 of an empty histogram.

    A histogram has at most 252 buckets, so the window is over as many rows.
    """
    upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    total = F.coalesce(F.max("upto"), F.lit(0))
    # as one row of buckets; a share is found in it without another pass
    row = upto.agg(total.alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "upto"))).alias("h"))
    asked = row.select("total", "h", F.explode(F.array(*map(F.lit, shares))).alias("p"))
    need = F.greatest(F.ceil(F.col("total") * F.col("p")), F.lit(1))
    hit = F.expr("filter(h, x -> x.upto >= need)[0].bucket")
    found = asked.withColumn("need", need).withColumn("bucket", F.when(F.col("total") > 0, hit))
    return found.select("p", F.coalesce(bucket_minimum(F.col("bucket")), F.lit(0)).cast("bigint").alias("value"))
