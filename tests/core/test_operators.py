import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.model import CorruptEntry, InvalidBatch
from logweave.operators import blocks, delivery, logs, metrics, replication, routing, segments
from logweave.plans.prefix import previous, running


def log_of(spark, sizes, topic="t"):
    return spark.createDataFrame([(topic, i, n) for i, n in enumerate(sizes)], "topic string, seq bigint, payload_len bigint")


def plain_pages(sizes, budget, cap):
    pages, page, n, held = [], 0, 0, 0
    for s in sizes:
        if n and (held + s > budget or n >= cap):
            page, n, held = page + 1, 0, 0
        n, held = n + 1, held + s
        pages.append(page)
    return pages


def plain_blocks(sizes, unit):
    out, block, limit, used = [], 0, unit, 0
    for s in sizes:
        need = s + 256
        if used + need > limit:
            block, limit, used = block + 1, -(-need // unit) * unit, 0
        out.append((block, used))
        used += need
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=80), st.integers(1, 5000), st.integers(1, 9), st.integers(1, 40), st.booleans())
def test_folds_equal_plain_loops(sizes, budget, cap, chunk, paged):
    rule = blocks.page_rule(budget, cap) if paged else blocks.block_rule(1024)
    state, groups, offsets = rule.first, [], []
    for a in range(0, len(sizes), chunk):
        part = np.array(sizes[a : a + chunk], dtype=np.int64)
        chained = blocks.chain(state, int(rule.sizes(part).sum()), len(part), blocks.summarize(part, rule), rule)
        g, o, state = blocks.fold(part, state, rule)
        assert chained == state
        groups += g.tolist()
        offsets += o.tolist()
    if paged:
        assert groups == plain_pages(sizes, budget, cap)
    else:
        assert list(zip(groups, offsets, strict=True)) == plain_blocks(sizes, 1024)


def test_chunked_topics(spark):
    rng = random.Random(6)
    sizes = {t: [rng.randrange(0, 3000) for _ in range(rng.randrange(1, 300))] for t in ("a", "b", None)}
    rows = [(t, i, n) for t, v in sizes.items() for i, n in enumerate(v)]
    log = spark.createDataFrame(rows, "topic string, seq bigint, payload_len bigint").repartition(3)
    got = {(r.topic, r.seq): (r.block, r.block_off) for r in blocks.pack_blocks(log, 4096, chunk_entries=16).collect()}
    assert got == {(t, i): x for t, v in sizes.items() for i, x in enumerate(plain_blocks(v, 4096))}
    pages = {(r.topic, r.page): r.n for r in blocks.page_reads(log, 5000, 4, chunk_entries=16).collect()}
    assert pages == {(t, p): plain_pages(v, 5000, 4).count(p) for t, v in sizes.items() for p in plain_pages(v, 5000, 4)}


def pages_of(spark, sizes, budget, cap=2000):
    rows = blocks.page_reads(log_of(spark, sizes), budget, cap).orderBy("page").collect()
    return [r.n for r in rows]


def test_page_vectors(spark):
    assert pages_of(spark, [100] * 20, 300)[:1] == [3] and pages_of(spark, [100] * 20, 500)[:1] == [5]
    assert pages_of(spark, [100] * 20, 1)[:2] == [1, 1] and pages_of(spark, [100] * 20, 350)[:1] == [3]
    assert pages_of(spark, [10] * 4000, 1 << 40) == [2000, 2000]
    assert pages_of(spark, [10] * 100, 100) == [10] * 10
    assert pages_of(spark, [0, 6, 0, 0, 7, 0], 100) == [6]
    assert pages_of(spark, [], 100) == []


def test_large_entries_seal_blocks(spark):
    mib = 1 << 20
    stats = blocks.block_stats(blocks.pack_blocks(log_of(spark, [9 * mib] * 3))).orderBy("block").collect()
    assert [r.n for r in stats] == [1, 1, 1]
    packed = blocks.pack_blocks(log_of(spark, [50 * mib] * 5)).orderBy("seq").collect()
    assert [r.block for r in packed] == [1, 2, 3, 4, 5]


def test_offsets_and_stateless_reads(spark):
    offsets = logs.offset_map(log_of(spark, [10, 0, 5]), range_size=2)
    rows = offsets.orderBy("seq").collect()
    assert [(r.start_off, r.end_off) for r in rows] == [(0, 266), (266, 522), (522, 783)]
    asked = spark.createDataFrame([("t", 0), ("t", 260), ("t", 266), ("t", 782), ("t", 783), ("x", 0)], "topic string, req bigint")
    got = sorted((r.req, r.seq, r.trim) for r in logs.stateless_read(offsets, asked).collect())
    assert got == [(0, 0, 0), (260, 0, 4), (266, 1, 0), (782, 2, 4)]


def test_counts_and_limits(spark):
    log = log_of(spark, [3, 3, 3, 5])
    cursors = spark.createDataFrame([("t", 1)], "topic string, cursor bigint")
    assert logs.unread(log, cursors).first().unread == 3
    assert logs.unread(log, cursors.where("false")).first().unread == 4
    assert logs.at_cursor(log, cursors).first().seq == 1
    batch = spark.range(2001).select(F.lit("x").alias("payload"))
    with pytest.raises(InvalidBatch):
        logs.check_batch(batch)
    logs.check_batch(batch.limit(0))
    logs.check_batch(batch.limit(2000))


def test_running_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(-5, 9)) for k in rng.sample(range(-50, 900), 300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): (r.s, r.m, r.e) for r in running(running(df, ["k"], "o", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, 37), ["k"], "o", {"e": ("min", F.col("v"))}, 37, exclusive=True).collect()}
    for key in ("a", "b", None):
        total, top, low = 0, None, None
        for _, o, v in sorted(r for r in rows if r[0] == key) if key else sorted((x for x in rows if x[0] is None), key=lambda x: x[1]):
            total, top = total + v, v if top is None else max(top, v)
            assert got[(key, o)] == (total, top, low)
            low = v if low is None else min(low, v)
    lag = {(r.k, r.o): r.before for r in previous(df, ["k"], "o", {"before": "v"}, 37).where("k = 'a'").collect()}
    ordered = sorted((o, v) for k, o, v in rows if k == "a")
    assert lag == {("a", o): (ordered[i - 1][1] if i else None) for i, (o, _) in enumerate(ordered)}


def test_segments_and_cursors(spark):
    table = segments.segment_table(log_of(spark, [1] * 20), 10)
    assert sorted((r.segment, r.first_seq, r.n) for r in table.collect()) == [(1, 0, 10), (2, 10, 10), (3, 20, 0)]
    assert sorted((r.segment, r.sealed, r.cum) for r in segments.sealed_cumulative(table).collect()) == [(1, 10, 10), (2, 10, 20)]
    cursors = spark.createDataFrame([("t", 0, 0), ("t", 1, 10), ("t", 2, 3), ("t", 2, 10), ("t", 3, 0)], "topic string, segment bigint, delivered bigint")
    got = {(r.segment, r.delivered): (r.seq, r.new_segment, r.new_delivered) for r in segments.advance(cursors, table).collect()}
    assert got == {(0, 0): (0, 1, 1), (1, 10): (10, 2, 1), (2, 3): (13, 2, 4), (2, 10): (None, 3, 0), (3, 0): (None, 3, 0)}
    log = log_of(spark, [1] * 25)
    told = segments.segment_table(log, 10)
    leader = segments.leader_of(F.col("topic"), F.lit(3), 3)
    states = told.select("topic").distinct().select("topic", F.lit(3).cast("bigint").alias("current_segment"), F.lit(20).cast("bigint").alias("last_sealed"), leader.alias("leader"))

    def broken(log=log, told=told, states=states):
        return {r.invariant for r in segments.invariants(log, told, states, 10, 3).collect() if r.violations}

    assert broken() == set()
    assert broken(log=log.where("seq <> 4")) == {"sealed_count_matches", "contiguous_order"}
    assert broken(log=log.unionAll(log.where("seq = 24"))) == {"contiguous_order"}
    assert broken(states=states.withColumn("last_sealed", F.lit(19))) == {"last_sealed_is_sum"}
    assert broken(states=states.withColumn("leader", F.lit(4))) == {"open_leader_valid"}
    assert "no_rows_after_open" in broken(states=states.withColumn("current_segment", F.lit(2)))
    voters = F.array(F.lit(3), F.lit(1), F.lit(2))
    assert spark.range(1).select(segments.next_leader(voters, F.lit(3)), segments.next_leader(voters, F.lit(1)), segments.next_leader(voters, F.lit(9))).first()[:] == (1, 2, 1)


def test_empty_segments_are_passed(spark):
    table = spark.createDataFrame([("t", 1, 0, 5), ("t", 2, 5, 0), ("t", 3, 5, 0), ("t", 4, 5, 3), ("t", 5, 8, 0)], "topic string, segment bigint, first_seq bigint, n bigint")
    cursors = spark.createDataFrame([("t", 1, 5), ("t", 2, 0), ("t", 4, 3), ("t", 5, 0)], "topic string, segment bigint, delivered bigint")
    got = {(r.segment, r.delivered): (r.seq, r.new_segment, r.new_delivered) for r in segments.advance(cursors, table).collect()}
    assert got == {(1, 5): (5, 4, 1), (2, 0): (5, 4, 1), (4, 3): (None, 5, 0), (5, 0): (None, 5, 0)}


def test_ticks_fold_like_a_loop(spark):
    import datetime

    rng = random.Random(3)
    base, rows, want = datetime.datetime(2024, 1, 1), [], {}
    for topic in "ab":
        segment, held = 1, 0
        for hour in range(150):
            n = rng.choice([0, 0, 1, 5, 12, 40])
            rows += [(topic, base + datetime.timedelta(hours=hour, minutes=k)) for k in range(n)]
            if n:
                if held >= 20:
                    segment, held = segment + 1, 0
                held += n
                want[topic, segment] = want.get((topic, segment), 0) + n
    got = segments.tick_rollover(spark.createDataFrame(rows, "topic string, ts timestamp").repartition(3), "ts", "1 hour", 20).collect()
    assert {(r.topic, r.segment): r.n for r in got} == want


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_sized_blocks_fill_files_like_a_loop(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i * 3, rng.choice([10, 10, 25, 90, 130]), rng.random() < 0.3) for i in range(300)]
    file_no, used, want = 0, 0, {}
    for at, size, first in rows:
        if not (used < 100 if first else used + size <= 100):
            file_no, used = file_no + 1, 0
        want[at] = (file_no, used)
        used += size
    df = spark.createDataFrame(rows, "at bigint, size bigint, first boolean").repartition(3)
    assert {r["at"]: (r.file_no, r.file_off) for r in blocks.place_sized(df, "at", file_bytes=100, chunk_entries=chunk).collect()} == want


def test_corruption_policies(spark):
    log = log_of(spark, [1] * 6).withColumn("checksum", F.when(F.col("seq") == 2, 0).otherwise(F.col("seq") + 1))
    good = F.col("seq") + 1
    assert sorted(r.seq for r in delivery.verify(log, good).collect()) == [0, 1]
    assert sorted(r.seq for r in delivery.verify(log, good, "skip").collect()) == [0, 1, 3, 4, 5]
    with pytest.raises(CorruptEntry):
        delivery.verify(log, good, "fail")
    packed = log.withColumn("block", F.floor(F.col("seq") / 4))
    assert sorted(r.seq for r in delivery.valid_prefix(packed, F.col("seq") == 2).collect()) == [0, 1, 4, 5]


def test_delivery(spark):
    row = spark.range(1).select(*(delivery.durable_point(F.lit(7), F.lit(k)) for k in (0, 1, 3, 10)), delivery.replayed(F.lit(7), F.lit(3))).first()
    assert tuple(row) == (7, 7, 6, 0, 1)
    rng = random.Random(5)
    ticks = [(i, rng.randrange(0, 40)) for i in range(200)]
    got = {r.i: r.clock for r in delivery.monotone_clock(spark.createDataFrame(ticks, "i bigint, ms bigint"), "i", "ms").collect()}
    c = 0
    for i, t in ticks:
        c = max(t, c + 1)
        assert got[i] == c
    batches = spark.createDataFrame([("t", 1, 0, 10), ("t", 2, 5, 8), ("t", 3, 11, 12), ("u", 1, 5, 6)], "topic string, batch int, start_ts int, end_ts int")
    assert [r.batch for r in delivery.overlapping(batches).collect()] == [2]
    sent = spark.createDataFrame([(1, 2, "x"), (2, 2, "x"), (3, 2, "x"), (4, 3, "x")], "chunk int, size bigint, sha256 string").withColumn("sha256", F.sha2(F.lit("ab"), 256))
    came = spark.createDataFrame([(1, "zz"), (1, "ab"), (2, "xy"), (4, "ab")], "chunk int, content string")
    assert {r.chunk: r.ack for r in delivery.chunk_acks(sent, came).collect()} == {1: 0, 2: 1, 3: 2, 4: 2}


def test_clock_of_equal_and_missing_orders(spark):
    rng = random.Random(11)
    ticks = [(rng.choice([None, 2**63 - 1, -5, 0, 1, 2, 300_000]), rng.randrange(0, 2000)) for _ in range(400)]
    got = delivery.monotone_clock(spark.createDataFrame(ticks, "i bigint, ms bigint").repartition(7), "i", "ms").collect()
    c, want = 0, []
    for i, t in sorted(ticks, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        c = max(t, c + 1)
        want.append((i, t, c))
    assert [tuple(r) for r in sorted(got, key=lambda r: r.clock)] == want


def test_replay_against_loop(spark):
    rng = random.Random(2)
    records, alive, purged = [], {}, None
    for pos in range(600):
        kind = rng.choices(["entry", "purge", "truncate", "vote"], [20, 1, 1, 1])[0]
        index = rng.randrange(0, 120)
        records.append((pos, kind, index))
        if kind == "entry":
            alive[index] = pos
        elif kind == "purge":
            alive = {i: p for i, p in alive.items() if i > index}
            purged = index if purged is None else max(purged, index)
        elif kind == "truncate":
            alive = {i: p for i, p in alive.items() if i < index}
    df = spark.createDataFrame(records, "pos bigint, kind string, log_index bigint")
    assert {r.idx: r.pos for r in replication.replay(df).collect()} == alive
    assert tuple(replication.log_state(df).first()) == (purged, max(alive, default=purged))


def test_kv_and_metadata(spark):
    lines = spark.createDataFrame([(0, "SET a 1"), (1, "SET  b 2 extra"), (2, "DELETE a"), (3, "GET b"), (4, "nonsense"), (5, "SET c")], "seq bigint, line string")
    parsed = replication.parse_kv(lines)
    assert {r.key: r.value for r in replication.materialize(parsed).collect()} == {"b": "2"}
    assert {r.key for r in replication.materialize(replication.parse_kv(lines, strict=True)).collect()} == set()
    snap = spark.createDataFrame([("a", "0"), ("z", "9")], "key string, value string")
    assert {r.key: r.value for r in replication.with_snapshot(snap, parsed, 0).collect()} == {"b": "2", "z": "9"}
    commands = spark.createDataFrame([(0, "rollover", "x", 5), (1, "create", "x", None), (2, "create", "x", None), (3, "rollover", "x", 10), (4, "rollover", "x", 0), (5, "upsert_node", None, None)], "log_index bigint, kind string, topic string, sealed_count bigint")
    state = replication.topic_states(commands, 3).first()
    assert (state.current_segment, state.last_sealed) == (3, 10)
    assert [r.reply for r in replication.command_results(commands).orderBy("log_index").collect()] == ["ERR", "CREATED", "EXISTS", "ROLLED", "ROLLED", "NODE"]


def test_quorums(spark):
    def accepted(values):
        return replication.quorum(spark.createDataFrame([(1, v) for v in values], "g int, matched bigint"), "g").first().committed

    cases = [((6, 3, 1), 3), ((5, 4, 1), 4), ((5, 6, 1), 5), ((5, 3, 2), 3), ((5, 3, 3), 3), ((5, 3, 4), 4), ((5, 3, 6), 5)]
    assert [accepted(v) for v, _ in cases] == [w for _, w in cases]


def test_log_runs_and_joins(spark):
    entries = spark.createDataFrame([(i, b) for i, b in enumerate("aaabbccca")], "i bigint, by string")
    assert sorted((r.idx, r.leader) for r in replication.leader_runs(entries, "i", "by").collect()) == [(0, "a"), (3, "b"), (5, "c"), (8, "a")]
    events = spark.createDataFrame([("k", 5), ("k", 1), ("k", 9), ("q", 3)], "key string, at bigint")
    changes = spark.createDataFrame([("k", 2, 1), ("k", 5, 2), ("k", 8, 3)], "key string, at bigint, leader bigint")
    assert sorted((r.key, r["at"], r.leader) for r in routing.as_of(events, changes, "key", "at", "leader").collect() if r.leader) == [("k", 5, 2), ("k", 9, 3)]
    kept, cut = routing.dropped(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src int, dst int"), spark.createDataFrame([(2, 1)], "src int, dst int"))
    assert kept.count() == 1 and cut.count() == 2


def test_histogram_percentiles(spark):
    values = [1, 2, 3, 4, 100, 1000]
    hist = metrics.histogram(spark.createDataFrame([(v,) for v in values], "v bigint"), F.col("v"))
    assert [(r.p, r.value) for r in metrics.percentiles(hist).collect()] == [(0.5, 3), (0.9, 896), (0.99, 896)]
    assert [r.value for r in metrics.percentiles(hist.where("false")).collect()] == [0, 0, 0]


def test_sample_files(spark, tmp_path):
    for kind, head, row in (("scaling", "threads,throughput", "4,12.5"), ("writes", "timestamp,elapsed_seconds,writes_per_second,bytes_per_second,total_writes,total_bytes,dirty_pages_kb,dirty_ratio_percent", "1,0.5,10,100,5,50,0,0.0")):
        path = tmp_path / f"{kind}.csv"
        path.write_text(f"{head}\n{row}\n")
        got = metrics.read_samples(spark, str(path), kind)
        assert got.count() == 1 and got.columns == head.split(",")
    series = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 15)], "s string, t bigint, total bigint")
    assert [r.rate for r in metrics.rates(series, ["s"], "t", "total").orderBy("t").collect()] == [None, 10.0, 20.0]


def test_consecutive_appends(spark):
    mine = spark.createDataFrame([("f", 1, 1), ("f", 2, 2), ("g", 1, 1)], "follower string, log_index bigint, term bigint")
    asks = spark.createDataFrame([("f", None, None), ("f", 2, 2), ("f", 2, 1), ("f", 3, 2), ("g", 1, 1), ("h", 1, 1)], "follower string, prev_index bigint, prev_term bigint")
    got = {(r.follower, r.prev_index, r.prev_term): (r.accepted, r.local_term, r.truncate_from) for r in replication.consecutive(asks, mine, "follower").collect()}
    assert got == {("f", None, None): (True, None, None), ("f", 2, 2): (True, 2, None), ("f", 2, 1): (False, 2, 2), ("f", 3, 2): (False, None, 3), ("g", 1, 1): (True, 1, None), ("h", 1, 1): (False, None, 1)}


def test_metadata_goes_on_from_a_snapshot(spark):
    commands = spark.createDataFrame([(1, "create", "t", None), (2, "rollover", "t", 10), (3, "rollover", "u", 5), (4, "create", "u", None), (5, "rollover", "t", 7), (6, "create", "t", None), (7, "rollover", "u", 3)], "log_index bigint, kind string, topic string, sealed_count bigint")
    whole = sorted(map(tuple, replication.topic_states(commands, 3).collect()))
    for cut in range(8):
        saved = replication.snapshot_states(replication.topic_states(commands.where(F.col("log_index") <= cut), 3))
        again = replication.restore_states(saved.unionAll(spark.createDataFrame([("junk",), (None,)], "state string")))
        assert sorted(map(tuple, replication.topic_states(commands.where(F.col("log_index") > cut), 3, again).collect())) == whole


def test_entries_are_applied_in_order(spark):
    rows = [(5, "normal", "DELETE a"), (1, "normal", "SET a 1"), (3, "membership", "2,1"), (4, "normal", "SET b 2"), (2, "blank", None), (6, "membership", "3"), (7, "normal", "nonsense"), (4, "normal", "SET b 2")]
    table, state = replication.apply_entries(spark.createDataFrame(rows, "log_index bigint, kind string, data string"))
    assert [tuple(r) for r in table.collect()] == [("b", "2")] and tuple(state.first()) == (7, 6, [3])
    table, state = replication.apply_entries(spark.createDataFrame([], "log_index bigint, kind string, data string"))
    assert table.collect() == [] and tuple(state.first()) == (None, None, None)


def test_places_of_readers_leaders_and_messages(spark):
    chain = spark.createDataFrame([("t", 70, 0), ("t", 71, 1)], "topic string, block_id bigint, place bigint")
    at = spark.createDataFrame([("t", 71, 9), ("t", 99, 9), ("u", 70, 9)], "topic string, block_id bigint, offset bigint")
    assert sorted(map(tuple, logs.at_tail(at, chain).select("topic", "block_id", "offset", "place").collect())) == [("t", 71, 9, 1), ("t", 99, 0, 0), ("u", 70, 0, 0)]
    entries = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "topic string, segment bigint")
    known, now = spark.createDataFrame([("t", 1, 5)], "topic string, segment bigint, leader bigint"), spark.createDataFrame([("t", 6)], "topic string, leader bigint")
    led = segments.with_leader(entries, known, now)
    assert sorted(map(tuple, led.collect()), key=repr) == [("t", 1, 5), ("t", 2, 6), ("u", 1, None)]
    placed = segments.with_address(led, spark.createDataFrame([(5, "a:1")], "node bigint, address string"))
    assert sorted((r.topic, r.segment, r.address) for r in placed.where("leader is not null").collect()) == [("t", 1, "a:1"), ("t", 2, None)]
    assert [r.topic for r in routing.unknown_topics(entries, now).collect()] == ["u"]


def test_envelopes_and_sample_files(spark, tmp_path):
    lines = spark.createDataFrame([('{"type":"Request","id":1,"payload":{"kind":"vote","term":3},"error":"x"}',), ('{"type":"request"}',), ("junk",), ('{"type":"one_way","id":4}',), (None,)], "line string")
    got = [r.e for r in lines.select(replication.envelope(F.col("line")).alias("e")).collect()]
    assert (got[0].type, got[0].id, got[0].payload.term, got[0].error) == ("request", 1, 3, None) and got[1] is None and got[2] is None and (got[3].type, got[3].id) == ("one_way", None) and got[4] is None
    metrics.write_samples(spark.createDataFrame([(4, 2.5)], "threads int, throughput double"), str(tmp_path / "s"), "scaling")
    assert [tuple(r) for r in metrics.read_samples(spark, str(tmp_path / "s"), "scaling").collect()] == [(4, 2.5)]
