"""A log in a folder: append, read with cursors, count, recover.

The log is Parquet, partitioned by topic, in one folder a commit; numbered
commit files say which folders count and where each topic ends (`storage`).  A
batch is therefore visible whole or not at all, and an append reads no entries.
Cursors are numbered versions a topic, each of which can be written once: of two
readers that want the same entries one gets them and the other moves on, and a
crash loses no version but the one being written.  Calls are batch jobs: a
reader states how much it wants.
"""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import _fnv_batch, fnv1a_vector, footprint
from .model import HEADER_BYTES, LOG_SCHEMA, MAX_BATCH_BYTES, MAX_BATCH_ENTRIES, MAX_ENTRY_BYTES, InvalidBatch, NotLeader, UnknownTopic
from .operators import blocks, delivery, logs
from .plans.prefix import running
from .storage import Catalog, Files, Versions, topic_folder

STRICT = "strictly_at_once"
AT_LEAST_ONCE = "at_least_once"
SEGMENT_ENTRIES = 1_000_000
DRAIN_BYTES = 10 * 1024 * 1024
_SAFE = "[^A-Za-z0-9._-]"


class LogEngine:
    """Topics of one namespace below `root`.

    `mode` is STRICT, where every consuming read makes its cursor durable, so
    that readers in any number of processes share it, or AT_LEAST_ONCE, where
    only every `persist_every`-th does (0 counts as 1) and a restart may deliver
    the reads since then again.  With `leases`, only those topics are written.
    """

    def __init__(self, spark: SparkSession, root: str, namespace: str = "default", mode: str = STRICT, persist_every: int = 1, on_corrupt: str = "stop", leases: Iterable[str] | None = None, segment_entries: int = SEGMENT_ENTRIES):
        name = re.sub(_SAFE, "_", namespace)
        if not name.strip("_"):
            import pandas as pd

            name = f"ns_{int(_fnv_batch(pd.Series([namespace]))[0]) % (1 << 64):016x}"
        self.spark, self.namespace, self.mode, self.on_corrupt = spark, namespace, mode, on_corrupt
        self.persist_every = max(1, persist_every) if mode == AT_LEAST_ONCE else 1
        self.leases = None if leases is None else set(leases)
        self.segment_entries = segment_entries
        self.folder = f"{root.rstrip('/')}/{name}"
        self.files = Files(spark)
        self.catalog = Catalog(self.files, f"{self.folder}/commits")
        self._lock = threading.RLock()
        self._held: dict[str, dict] = {}  # cursors that are ahead of their durable versions

    @classmethod
    def from_environment(cls, spark: SparkSession, **options) -> LogEngine:
        """An engine by LOGWEAVE_DATA_DIR, LOGWEAVE_INSTANCE_KEY and LOGWEAVE_MAX_SEGMENT_ENTRIES; given options win.

        LOGWEAVE_QUIET sets Spark's log level to errors.
        """
        said = os.environ
        if said.get("LOGWEAVE_QUIET"):
            spark.sparkContext.setLogLevel("ERROR")
        if said.get("LOGWEAVE_INSTANCE_KEY"):
            options.setdefault("namespace", said["LOGWEAVE_INSTANCE_KEY"])
        if said.get("LOGWEAVE_MAX_SEGMENT_ENTRIES", "").isdigit():
            options.setdefault("segment_entries", max(1, int(said["LOGWEAVE_MAX_SEGMENT_ENTRIES"])))
        return cls(spark, options.pop("root", None) or said.get("LOGWEAVE_DATA_DIR", "wal_files"), **options)

    # -- storage -------------------------------------------------------------

    def log(self) -> DataFrame:
        """All entries, consumed ones included."""
        self.catalog.refresh()
        return self._read(self.catalog.folders)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        base = f"{self.folder}/data"
        rows = self.spark.read.schema(LOG_SCHEMA).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))
        return rows.select(*self.spark.createDataFrame([], LOG_SCHEMA).columns)

    def compact(self) -> None:
        """Write all entries as one folder in place of those of their commits, which stay until `vacuum`.

        Raises ConcurrentWrite if something was appended meanwhile; nothing is changed then.
        """
        self.catalog.refresh()
        base = self.catalog.upto
        if len(self.catalog.folders) > 1:
            name = f"commit={uuid.uuid4().hex}"
            self._read(self.catalog.folders).repartition("topic").sortWithinPartitions("topic", "seq").write.partitionBy("topic").parquet(f"{self.folder}/data/{name}")
            self._publish(base, {}, name, replaces=True)

    def vacuum(self) -> None:
        """Delete data folders that no commit names.  Only when no writer is at work: theirs are not named yet."""
        self.catalog.refresh()
        for name in set(self.files.names(f"{self.folder}/data")).difference(self.catalog.folders):
            self.files.delete(f"{self.folder}/data/{name}")

    def _publish(self, base: int, topics: dict[str, dict], folder: str | None, replaces: bool = False) -> None:
        try:
            self.catalog.commit(base, topics, folder, replaces)
        except BaseException:
            if folder:
                self.files.delete(f"{self.folder}/data/{folder}")
            raise

    # -- writing -------------------------------------------------------------

    def register(self, topic: str) -> None:
        """Make a topic known; a known one stays as it is."""
        if not topic:
            raise InvalidBatch("a topic needs a name")
        self.catalog.refresh()
        if topic not in self.catalog.ends:
            self.catalog.commit(self.catalog.upto, {topic: {"first": 0, "n": 0, "bytes": 0}})

    def topics(self) -> set[str]:
        """All topics that were registered or written."""
        self.catalog.refresh()
        return set(self.catalog.ends)

    def append(self, topic: str, payload: bytes) -> None:
        self.append_batch(topic, [payload])

    def append_batch(self, topic: str, payloads: list[bytes]) -> None:
        """All payloads, in order, or none; an empty batch does nothing."""
        sizes = [HEADER_BYTES + len(p) for p in payloads]
        if len(payloads) > MAX_BATCH_ENTRIES:
            raise InvalidBatch(f"{len(payloads)} entries; a batch holds {MAX_BATCH_ENTRIES} at most")
        if sum(sizes) > MAX_BATCH_BYTES or max(sizes, default=0) > MAX_ENTRY_BYTES:
            raise InvalidBatch("too many bytes")
        if payloads:
            rows = self.spark.createDataFrame([(topic, i, bytearray(p)) for i, p in enumerate(payloads)], "topic string, position bigint, payload binary")
            self.append_frame(rows, [topic])

    def append_frame(self, rows: DataFrame, topics: Iterable[str] | None = None) -> None:
        """Append (topic, position, payload) rows of any number of topics, numbered on from each topic's end.

        Either all of them or none.  Raises ConcurrentWrite if another writer
        appended to one of the topics meanwhile, InvalidBatch for an entry above
        the limit or without a topic, NotLeader for a topic without a lease.  `topics` may name the
        topics of the rows, so that only their ends are looked up.
        """
        self.catalog.refresh()
        base = self.catalog.upto
        if topics is not None:
            self._lead(topics)
        ends = {t: self.catalog.ends[t] for t in (self.catalog.ends if topics is None else topics) if t in self.catalog.ends}
        known = self.spark.createDataFrame([(t, e["next"], e["batches"]) for t, e in ends.items()], "topic string, next bigint, batch bigint")
        placed = running(rows, ["topic"], "position", {"__i": ("sum", F.lit(1).cast("bigint"))}, exclusive=True).join(known, "topic", "left")
        log = placed.select(
            F.lit(self.namespace).alias("ns"),
            (F.coalesce("next", F.lit(0)) + F.col("__i")).alias("seq"),
            "payload",
            F.octet_length("payload").cast("bigint").alias("payload_len"),
            fnv1a_vector(F.col("payload")).alias("checksum"),
            F.current_timestamp().alias("append_ts"),
            F.coalesce("batch", F.lit(0)).cast("bigint").alias("batch_id"),
            "topic",
        )
        name = f"commit={uuid.uuid4().hex}"
        log.write.partitionBy("topic").parquet(f"{self.folder}/data/{name}")
        try:
            size = footprint(F.col("payload_len"))
            found = self._read([name]).groupBy("topic").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("largest")).collect()
            if not all(r.topic for r in found):
                raise InvalidBatch("a topic needs a name")
            if max((r.largest for r in found), default=0) > MAX_ENTRY_BYTES:
                raise InvalidBatch("too many bytes in an entry")
            self._lead(r.topic for r in found)
        except BaseException:
            self.files.delete(f"{self.folder}/data/{name}")
            raise
        if not found:
            self.files.delete(f"{self.folder}/data/{name}")
            return
        self._publish(base, {r.topic: {"first": r["first"], "n": r.n, "bytes": r.bytes} for r in found}, name)
        for r in found:
            self._mark(r.topic, False)

    def _lead(self, topics: Iterable[str]) -> None:
        missing = [] if self.leases is None else sorted(set(topics) - self.leases)
        if missing:
            raise NotLeader(f"no lease for {', '.join(missing)}")

    # -- reading -------------------------------------------------------------

    def read_next(self, topic: str, checkpoint: bool = True) -> bytes | None:
        """The next unread payload, or None; without `checkpoint` it stays unread."""
        found = self.read_page(topic, 0, checkpoint=checkpoint, max_entries=1)
        return found[0] if found else None

    def read_page(self, topic: str, max_bytes: int, checkpoint: bool = True, max_entries: int = MAX_BATCH_ENTRIES) -> list[bytes]:
        """Unread payloads in order up to a byte budget, at least one if there is any."""
        with self._lock:
            while True:
                number, state = self._cursor(topic)
                found, end = self._page(topic, state["cursor"], max_bytes, max_entries)
                if not (found and checkpoint) or self._advance(topic, number, state, end, len(found)):
                    return found

    def read_all(self, topic: str, page_bytes: int = DRAIN_BYTES) -> list[bytes]:
        """Drain a topic: all that is unread, page by page, consumed."""
        out: list[bytes] = []
        while page := self.read_page(topic, page_bytes):
            out += page
        return out

    def drain(self, topic: str) -> DataFrame:
        """All unread entries of a topic as a DataFrame, consumed in one step; for topics too large to be listed."""
        with self._lock:
            while True:
                number, state = self._cursor(topic)
                at, end = state["cursor"], self._end(topic)
                rows = self.log().where((F.col("topic") == topic) & (F.col("seq") >= at) & (F.col("seq") < end))
                if end <= at or self._advance(topic, number, state, end, end - at):
                    return delivery.verify(rows, fnv1a_vector(F.col("payload")), self.on_corrupt).orderBy("seq")

    def _page(self, topic: str, at: int, max_bytes: int, max_entries: int) -> tuple[list[bytes], int]:
        if at >= self._end(topic):
            return [], at
        ahead = self.log().where((F.col("topic") == topic) & (F.col("seq") >= at) & (F.col("seq") < at + max_entries))
        sound = delivery.verify(ahead, fnv1a_vector(F.col("payload")), self.on_corrupt)
        # lengths decide before payloads are fetched; both are at most one page of rows
        end, held, n = at, 0, 0
        for r in sound.select("seq", "payload_len").orderBy("seq").collect():
            if n and held + r.payload_len > max_bytes:
                break
            end, held, n = r.seq + 1, held + r.payload_len, n + 1
        rows = sound.where(F.col("seq") < end).orderBy("seq").select("payload").collect() if n else []
        return [bytes(r.payload) for r in rows], end

    def read_at(self, topic: str, offset: int) -> DataFrame:
        """Entries from a byte offset of the topic on, the first payload trimmed; changes no cursor or count."""
        offsets = logs.offset_map(self.log().where(F.col("topic") == topic))
        return logs.read_from(offsets, self.spark.createDataFrame([(topic, offset)], "topic string, req bigint")).orderBy("seq")

    # -- cursors and markers ---------------------------------------------------

    def _versions(self, kind: str, topic: str) -> Versions:
        return Versions(self.files, topic_folder(f"{self.folder}/{kind}", topic))

    def _cursor(self, topic: str) -> tuple[int, dict]:
        """Number of the durable version, and the cursor as this reader has it."""
        number, state = self._versions("cursors", topic).latest()
        state = state or {"topic": topic, "cursor": 0, "reads": 0}
        held = self._held.get(topic)
        return number, held if held and held["cursor"] > state["cursor"] else state

    def _advance(self, topic: str, number: int, state: dict, end: int, n: int) -> bool:
        """Move the cursor after a read of n entries; False if another reader moved it first."""
        after = {"topic": topic, "cursor": end, "reads": state["reads"] + n}
        if self.mode == STRICT or after["reads"] // self.persist_every > state["reads"] // self.persist_every:
            if not self._versions("cursors", topic).put(number + 1, after):
                return False
        if self.mode == AT_LEAST_ONCE:
            self._held[topic] = after
        if end >= self._end(topic):
            self._mark(topic, True)
        return True

    def _mark(self, topic: str, clean: bool) -> None:
        """Keep whether all of a topic is consumed; each change is a new generation."""
        while True:
            number, now = self._versions("clean", topic).latest()
            if now.get("clean", True) == clean or self._versions("clean", topic).put(number + 1, {"topic": topic, "clean": clean, "generation": now.get("generation", 0) + 1}):
                return

    def clean_marker(self, topic: str) -> tuple[bool, int]:
        """The durable marker: whether the topic was consumed to its end, and how often that changed."""
        _, now = self._versions("clean", topic).latest()
        return now.get("clean", True), now.get("generation", 0)

    # -- state ---------------------------------------------------------------

    def _end(self, topic: str) -> int:
        self.catalog.refresh()
        return self.catalog.ends.get(topic, {"next": 0})["next"]

    def _cursor_frame(self) -> DataFrame:
        """Durable cursors of all topics, with those that this reader has further on."""
        held = self.spark.createDataFrame([(t, s["cursor"]) for t, s in self._held.items()], "topic string, cursor bigint")
        if self.files.exists(f"{self.folder}/cursors"):
            held = held.unionAll(self.spark.read.schema("topic string, cursor bigint").json(f"{self.folder}/cursors/*/*.json"))
        return held.groupBy("topic").agg(F.max("cursor").alias("cursor"))

    def unread(self, topic: str | None = None) -> int | DataFrame:
        """Unread entries of a topic (0 if unknown), or of all topics."""
        if topic is None:
            self.catalog.refresh()
            ends = self.spark.createDataFrame([(t, e["entries"]) for t, e in self.catalog.ends.items()], "topic string, entries bigint")
            left = F.greatest(F.col("entries") - F.coalesce("cursor", F.lit(0)), F.lit(0))
            return ends.join(self._cursor_frame(), "topic", "left").select("topic", left.alias("unread"))
        return max(0, self._end(topic) - self._cursor(topic)[1]["cursor"])

    def size(self, topic: str) -> int:
        """Stored bytes of a topic."""
        self.catalog.refresh()
        return self.catalog.ends.get(topic, {"bytes": 0})["bytes"]

    def state(self, topic: str) -> str:
        self.catalog.refresh()
        end = self.catalog.ends.get(topic)
        if end is None:
            raise UnknownTopic(topic)
        return json.dumps({"topic": topic, "entries": end["entries"], "current_segment": end["entries"] // self.segment_entries + 1, "unread": self.unread(topic)})

    def is_clean(self, topic: str) -> bool:
        """Whether all entries of the topic are consumed."""
        return self.unread(topic) == 0

    def recover(self, unit: int = blocks.BLOCK_BYTES) -> DataFrame:
        """Scan of all topics: entries, stored bytes and entries before the first bad one of their block."""
        log = self.log().withColumn("__ok", fnv1a_vector(F.col("payload")) == F.col("checksum"))
        packed = blocks.pack_blocks(log, unit, keep=("__ok",))
        good = delivery.valid_prefix(packed, ~F.col("__ok"))
        return packed.groupBy("topic").agg(F.count("*").alias("entries"), F.sum(F.col("payload_len") + HEADER_BYTES).alias("footprint")).join(good.groupBy("topic").agg(F.count("*").alias("visible")), "topic", "left").fillna(0, ["visible"])
