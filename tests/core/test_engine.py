import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from logweave.cli import Client, Commands, converse, serve
from logweave.engine import AT_LEAST_ONCE, LogEngine
from logweave.model import ConcurrentWrite, InvalidBatch, NotLeader, UnknownTopic
from logweave.streaming import tail


def test_exactly_once_over_restarts(spark, tmp_path):
    log = LogEngine(spark, str(tmp_path), "prod/payments::v1")
    assert log.folder.endswith("/prod_payments__v1")
    log.append_batch("t", [bytes([i]) for i in range(6)])
    log.append("u", b"")
    assert [log.read_next("t") for _ in range(3)] == [b"\0", b"\1", b"\2"]
    assert log.read_next("t", checkpoint=False) == b"\3" and log.unread("t") == 3
    again = LogEngine(spark, str(tmp_path), "prod/payments::v1")
    assert again.read_page("t", 2) == [b"\3", b"\4"] and again.read_next("t") == b"\5" and again.read_next("t") is None
    assert again.read_next("u") == b"" and again.read_next("nothing") is None and again.is_clean("t")
    assert [(r.seq, bytes(r.payload)) for r in again.read_at("t", 257 * 4 + 256).collect()] == [(4, b"\4"), (5, b"\5")]
    with pytest.raises(InvalidBatch):
        again.append_batch("t", [b"x"] * 2001)
    again.append_batch("t", [])
    assert {r.topic: (r.entries, r.visible) for r in again.recover().collect()} == {"t": (6, 6), "u": (1, 1)}


def test_at_least_once_replays(spark, tmp_path):
    log = LogEngine(spark, str(tmp_path), mode=AT_LEAST_ONCE, persist_every=3)
    log.append_batch("t", [f"m{i}".encode() for i in range(1, 8)])
    assert [log.read_next("t"), log.read_next("t")] == [b"m1", b"m2"]
    log = LogEngine(spark, str(tmp_path), mode=AT_LEAST_ONCE, persist_every=3)
    assert [log.read_next("t") for _ in range(3)] == [b"m1", b"m2", b"m3"]
    log = LogEngine(spark, str(tmp_path), mode=AT_LEAST_ONCE, persist_every=3)
    assert log.read_next("t") == b"m4"


def test_protocol_over_tcp(spark, tmp_path):
    with serve(Commands(LogEngine(spark, str(tmp_path))), 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address) as s:
            f = s.makefile("rb")

            def ask(line):
                body = line.encode()
                s.sendall(len(body).to_bytes(4, "little") + body)
                return f.read(int.from_bytes(f.read(4), "little")).decode()

            assert ask("PUT logs x") == "ERR unknown topic"
            assert ask("REGISTER logs") == "OK"
            assert [ask(f"PUT logs {w}") for w in ("one", "two  2")] == ["OK", "OK"]
            assert [ask("GET logs\n") for _ in range(3)] == ["OK one", "OK two  2", "EMPTY"]
            assert ask("FETCH logs") == "ERR unknown command" and ask("GET") == "ERR GET requires a topic"
            assert '"entries": 2' in ask("STATE logs") and ask("METRICS").startswith("OK {")
        server.shutdown()


def test_streaming_sinks(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(10).select(F.lit("t").alias("topic"), F.col("id").alias("seq")).coalesce(1).write.parquet(source)
    schema = "topic string, seq bigint"
    tail.exactly_once(tail.follow(spark, source, schema), target, state).awaitTermination()
    spark.range(10, 15).select(F.lit("t").alias("topic"), F.col("id").alias("seq")).coalesce(1).write.mode("append").parquet(source)
    tail.exactly_once(tail.follow(spark, source, schema, 1), target, state).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(target).collect()) == list(range(15))
    failed, seen = [], []

    def act(batch, number):
        rows = [r.seq for r in batch.collect()]
        if not failed:
            failed.append(number)
            raise RuntimeError("crash after the batch was read")
        seen.extend(rows)

    other = str(tmp_path / "other")
    with pytest.raises(Exception, match="crash"):
        tail.at_least_once(tail.follow(spark, source, schema), act, other).awaitTermination()
    tail.at_least_once(tail.follow(spark, source, schema), act, other).awaitTermination()
    assert sorted(seen) == list(range(15))


def test_cursor_state_survives(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    got = {}

    def keep(batch, number):
        got.update({r.topic: (r.seq, r.n) for r in batch.collect()})

    for part in ([("a", 0), ("a", 1), ("b", 0)], [("a", 1), ("a", 2)]):
        spark.createDataFrame(part, "topic string, seq bigint").coalesce(1).write.mode("append").parquet(source)
        stream = tail.topic_cursors(tail.follow(spark, source, "topic string, seq bigint"))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert got == {"a": (2, 3), "b": (0, 1)}


def test_paged_source_reads_the_log(spark, tmp_path):
    log = LogEngine(spark, str(tmp_path / "root"))
    topic = "a/b =c"
    log.append_batch(topic, [bytes([i]) * 3 for i in range(7)])
    log.append_batch("other", [b"no"])
    log.append_batch(topic, [bytes([i]) * 3 for i in range(7, 10)])
    spark.dataSource.register(tail.PagedSource)
    sizes, seen, state = [], [], str(tmp_path / "state")

    def keep(batch, number):
        rows = batch.orderBy("seq").collect()
        if rows:
            sizes.append(len(rows))
            seen.extend((r.seq, bytes(r.payload)) for r in rows)

    def run(until):
        query = spark.readStream.format("paged_log").option("path", log.folder).option("topic", topic).option("max_bytes", 13).load().writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        began = time.time()
        while len(seen) < until and time.time() - began < 60:
            time.sleep(0.2)
        query.stop()

    run(10)
    assert sizes == [4, 4, 2] and seen == [(i, bytes([i]) * 3) for i in range(10)]
    log.append(topic, b"later")
    log.compact()
    run(11)
    assert seen[10:] == [(10, b"later")]


def test_two_writers_of_a_topic(spark, tmp_path):
    one, two = LogEngine(spark, str(tmp_path)), LogEngine(spark, str(tmp_path))
    one.append("t", b"0")
    base = two.catalog.upto
    # both prepare an entry 1; the first to commit has the topic
    two.catalog.refresh()
    seen = two.catalog.upto
    one.append("t", b"1")
    with pytest.raises(ConcurrentWrite):
        two.catalog.commit(seen, {"t": {"first": 1, "n": 1, "bytes": 257}}, "commit=x")
    two.catalog.commit(seen, {"u": {"first": 0, "n": 0, "bytes": 0}})
    two.append("t", b"2")
    assert base == -1 and [bytes(r.payload) for r in one.log().where("topic = 't'").orderBy("seq").collect()] == [b"0", b"1", b"2"]
    errors, threads = [], []

    def write(engine, k):
        try:
            engine.append_batch("busy", [bytes([k])] * 5)
        except ConcurrentWrite as e:
            errors.append(e)

    for k, engine in enumerate((one, two)):
        threads.append(threading.Thread(target=write, args=(engine, k)))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = one.log().where("topic = 'busy'").orderBy("seq").collect()
    assert len(rows) == 10 - 5 * len(errors) and [r.seq for r in rows] == list(range(len(rows)))


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    log = LogEngine(spark, str(tmp_path))
    rows = spark.createDataFrame([("t", 0, bytearray(b"a")), ("t", 1, bytearray(b"b")), (None, 2, bytearray(b"c"))], "topic string, position bigint, payload binary")
    with pytest.raises(InvalidBatch):
        log.append_frame(rows)
    assert log.log().count() == 0 and log.files.names(f"{log.folder}/data") == []
    log.append_frame(rows.where("topic = 't'"))
    # data that no commit names, as a crash leaves it, does not count
    log.log().drop("topic").write.parquet(f"{log.folder}/data/commit=lost/topic=t")
    assert LogEngine(spark, str(tmp_path)).log().count() == 2
    log.vacuum()
    assert len(log.files.names(f"{log.folder}/data")) == 1
    log.append_frame(rows.limit(0))
    assert log.unread("t") == 2 and log.size("t") == 2 * 257


def test_readers_share_a_cursor(spark, tmp_path):
    one, two = LogEngine(spark, str(tmp_path)), LogEngine(spark, str(tmp_path))
    one.append_batch("t", [bytes([i]) for i in range(20)])
    got = [one.read_next("t"), two.read_next("t"), *two.read_page("t", 3), one.read_next("t")]
    assert got == [bytes([i]) for i in range(6)]
    taken = {0: [], 1: []}

    def read(k, engine):
        while (x := engine.read_next("t")) is not None:
            taken[k].append(x)

    threads = [threading.Thread(target=read, args=(k, e)) for k, e in enumerate((one, two))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken[0] + taken[1]) == [bytes([i]) for i in range(6, 20)]
    assert one.is_clean("t") and one.clean_marker("t") == (True, 2)
    one.append("t", b"x")
    assert two.clean_marker("t") == (False, 3) and two.read_all("t") == [b"x"] and one.read_all("t") == []


def test_many_commits_compaction_and_drain(spark, tmp_path):
    log = LogEngine(spark, str(tmp_path))
    for k in range(35):
        log.append("t", str(k).encode())
    again = LogEngine(spark, str(tmp_path))
    assert again.unread("t") == 35 and again.catalog.upto == log.catalog.upto and any(n.startswith("sum-") for n in log.files.names(f"{log.folder}/commits"))
    again.compact()
    assert len(again.catalog.folders) == 1
    assert [bytes(r.payload) for r in log.drain("t").collect()] == [str(k).encode() for k in range(35)]
    assert log.drain("t").collect() == [] and LogEngine(spark, str(tmp_path)).unread("t") == 0
    again.vacuum()
    assert log.log().count() == 35 and {r.topic: r.unread for r in log.unread().collect()} == {"t": 0}


def test_leases_environment_and_client(spark, tmp_path, monkeypatch):
    with pytest.raises(NotLeader):
        LogEngine(spark, str(tmp_path), leases=["u"]).append("t", b"x")
    monkeypatch.setenv("LOGWEAVE_DATA_DIR", str(tmp_path / "env"))
    monkeypatch.setenv("LOGWEAVE_INSTANCE_KEY", "node 1")
    monkeypatch.setenv("LOGWEAVE_MAX_SEGMENT_ENTRIES", "2")
    log = LogEngine.from_environment(spark)
    assert log.folder == f"{tmp_path}/env/node_1"
    log.append_batch("t", [b"1", b"2", b"3"])
    assert '"current_segment": 2' in log.state("t")
    with serve(Commands(log), 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with Client(server.server_address[1]) as client:
            client.register("v")
            client.put("v", "one  two")
            assert client.get("v") == "one  two" and client.get("v") is None and client.metrics()["topics"] == 2 and client.state("v")["entries"] == 1
            with pytest.raises(UnknownTopic):
                client.get("nothing")
            assert list(converse(client, ["get v", "", "quit", "get v"])) == ["EMPTY"]
        server.shutdown()
    # a registered topic is known after a restart
    log.register("only-registered")
    assert "only-registered" in LogEngine.from_environment(spark).topics()
    assert Commands(LogEngine.from_environment(spark)).handle("GET only-registered") == "EMPTY"


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:40:00", "a"), ("2024-01-01 00:50:00", "a")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in tail.windowed_counts(rows, "ts", "k", "30 minutes", "1 hour").collect()) == [1, 2]
    assert sorted(r.n for r in tail.windowed_counts(rows, "ts", "k", "30 minutes", "1 hour", "15 minutes").collect()) == [1, 1, 1, 1, 2]
    assert sorted(r.n for r in tail.sessions(rows, "ts", "k", "15 minutes", "1 hour").collect()) == [1, 2]
