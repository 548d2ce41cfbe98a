"""Following a log: streaming reads, exactly-once and at-least-once sinks, per-topic state, event-time windows."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow.dataset as pa_dataset
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import MAX_BATCH_ENTRIES
from ..storage import Files


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's state beside the session's checkpoints, which all executors share.

    Only where the session has none and all of Spark is in this process, it is a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def follow(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Streaming DataFrame of a Parquet log folder, or of one file; reading it as a batch is the peek that moves nothing."""
    reader = spark.readStream.schema(schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        reader, path = reader.option("pathGlobFilter", target.getName()), target.getParent().toString()
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def exactly_once(stream: DataFrame, target: str, checkpoint: str) -> Any:
    """Deliver every row to `target` once: a micro-batch that is repeated after a crash replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def at_least_once(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """Call `act` for every micro-batch; one that was not committed before a crash is delivered again, none is lost."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TopicCursor(StatefulProcessor):
    """Entries seen and the last seq of each topic, kept in the state store; an entry at or below the cursor is not counted again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "seq bigint, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, n = self.cursor.get() if self.cursor.exists() else (-1, 0)
        for pdf in rows:
            fresh = pdf[pdf["seq"] > seq]
            if len(fresh):
                n += int(fresh["seq"].nunique())
                seq = int(fresh["seq"].max())
        self.cursor.update((seq, n))
        yield pd.DataFrame({"topic": [key[0]], "seq": [seq], "n": [n]})

    def close(self) -> None:
        pass


def topic_cursors(stream: DataFrame) -> DataFrame:
    """Running cursor of each topic, by transformWithState; needs the RocksDB state store."""
    return stream.groupBy("topic").transformWithStateInPandas(TopicCursor(), outputStructType="topic string, seq bigint, n bigint", outputMode="Update", timeMode="None")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Counts by event time in tumbling windows, or in sliding ones that begin every `slide`.

    On a stream, rows of windows that end before the watermark are dropped.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, lateness).groupBy(window, key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, lateness: str) -> DataFrame:
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def progress(records: DataFrame) -> DataFrame:
    """Furthest index of each node and kind of progress (log, vote, commit, snapshot, apply), as a stream of changes or a table.

    Needs node, kind and log_index; indexes only rise.
    """
    return records.groupBy("node", "kind").agg(F.max("log_index").alias("log_index"))


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What one available-now run of a streaming aggregate says.

    `complete` is its state at the end; `append` are the rows that the
    watermark has closed.  The result is a table in the shared folder; the
    run's own state is removed.
    """
    spark = stream.sparkSession
    name = f"run_{uuid.uuid4().hex[:12]}"
    state, result = shared_folder(spark, name), shared_folder(spark, f"{name}-result")

    def put(batch: DataFrame, number: int) -> None:
        # a complete batch replaces the one before; appended ones stand side by side
        batch.write.mode("overwrite").parquet(result if mode == "complete" else f"{result}/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    Files(spark).delete(state)
    return spark.read.schema(stream.schema).parquet(result).select(stream.columns)


class PagedSource(DataSource):
    """A topic of a log folder as a stream; a micro-batch is one read page.

    Options: `path` (the engine's folder), `topic`, `max_bytes`, `max_entries`.
    A page holds payloads up to the byte budget, at least one entry, and no more
    than `max_entries`.  Needs a path that pyarrow can open.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_log"

    def schema(self) -> str:
        return "topic string, seq bigint, payload binary"

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        return _PageReader(self.options)


# Characters that Spark escapes in the folder name of a partition, beside control characters.
_ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def partition_name(value: str) -> str:
    """A partition's value as its folder name has it."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in value)


class _PageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.topic = options["topic"]
        self.max_bytes = int(options.get("max_bytes", 10 * 1024 * 1024))
        self.max_entries = min(int(options.get("max_entries", MAX_BATCH_ENTRIES)), MAX_BATCH_ENTRIES)
        self.store, self.root = pa_fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (pa_fs.LocalFileSystem(), options["path"])

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _rows(self, low: int, high: int) -> list[tuple]:
        """Entries of the topic with low <= seq < high, in order, from the folders of all commits that touch them."""
        folders = {}
        for f in self.store.get_file_info(pa_fs.FileSelector(f"{self.root}/commits", allow_not_found=True)):
            if f.base_name.removesuffix(".json").isdigit():
                commit = json.loads(self.store.open_input_stream(f.path).read())
                folders[f.base_name] = commit
        parts, replaced = [], ""
        for name in sorted(folders):
            if folders[name]["replaces"]:
                replaced = name
        for name in sorted(folders):
            commit = folders[name]
            part = commit["topics"].get(self.topic)
            if commit["replaces"] and name == replaced or name > replaced and part and part["first"] < high and part["first"] + part["n"] > low:
                parts.append(commit["folder"])
        out = []
        for folder in parts:
            where = f"{self.root}/data/{folder}/topic={partition_name(self.topic)}"
            if self.store.get_file_info(where).type == pa_fs.FileType.NotFound:
                continue
            rows = pa_dataset.dataset(where, filesystem=self.store, format="parquet").to_table(columns=["seq", "payload"], filter=(pa_dataset.field("seq") >= low) & (pa_dataset.field("seq") < high))
            out += zip(rows.column("seq").to_pylist(), rows.column("payload").to_pylist(), strict=True)
        return [(self.topic, seq, payload) for seq, payload in sorted(out)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page, held = [], 0
        for row in self._rows(start["seq"], start["seq"] + self.max_entries):
            if page and held + len(row[2]) > self.max_bytes:
                break
            page.append(row)
            held += len(row[2])
        return iter(page), {"seq": page[-1][1] + 1 if page else start["seq"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["seq"], end["seq"]))

    def commit(self, end: dict) -> None:
        pass


def tail_counts(spark: SparkSession, path: str, schema: str, topic: str) -> DataFrame:
    """Entries of each topic as one available-now streaming run finds them; one row a topic."""
    return finished(follow(spark, path, schema).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n")))
