"""Every query of the engine, bound to the test tables, with its SQL twin.

Small constants let little tables seal blocks and segments; operators take
their real sizes as parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..engine import LogEngine
from ..operators import blocks, delivery, logs, metrics, replication, routing, segments
from ..sources.topics import conversations_log, documents_log, events_log, orders_log, table
from ..streaming.tail import finished, follow, progress, sessions, shared_folder, tail_counts, windowed_counts
from .prefix import running

BLOCK = 64 * 1024
SMALL_BLOCK = 4096
PAGE = 16 * 1024
SEGMENT = 100
ORDER_SEGMENT = 1000
NODES = 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# -- SQL fragments -----------------------------------------------------------

_E = "SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, event_id, user_id, ts, concat_ws('|', event_id, user_id, event_type, props) AS payload, strlen(concat_ws('|', event_id, user_id, event_type, props)) AS len FROM events"
_D = "SELECT source AS topic, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, strlen(text) AS len FROM documents"
_O = "SELECT o_orderpriority AS topic, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS seq, o_orderkey FROM orders"
_OFFSETS = f"e AS ({_E}), o AS (SELECT *, CAST(sum(len + 256) OVER (PARTITION BY topic ORDER BY seq) AS BIGINT) AS end_off FROM e), m AS (SELECT *, end_off - len - 256 AS start_off FROM o)"


def _fnv(text: str) -> str:
    """FNV-1a of an ASCII text, as a signed integer."""
    steps = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({text}, ''), lambda c: ord(c)::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)"
    return f"list_transform([{steps}], lambda v: CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)[1]::BIGINT"


def _init(topic: str) -> str:
    return f"((({_fnv(topic)} % {NODES}) + {NODES}) % {NODES})"


def _segments(log: str, size: int) -> str:
    return f"""l AS ({log}), t AS (SELECT topic, count(*) AS total FROM l GROUP BY topic),
        s AS (SELECT topic, seq // {size} + 1 AS segment, min(seq) AS first_seq, count(*) AS n FROM l GROUP BY ALL
              UNION ALL SELECT topic, total // {size} + 1, total, 0 FROM t WHERE total % {size} = 0),
        c AS (SELECT topic, max(segment) AS current FROM s GROUP BY topic)"""


def _next_fit(log: str, unit: int, whole_units: bool = True) -> str:
    """Blocks of every entry as relation b, one recursive step a row."""
    size = f"((d.need + {unit} - 1) // {unit}) * {unit}" if whole_units else f"greatest(d.need, {unit})"
    return f"""d AS (SELECT topic, seq + 1 AS rn, len + 256 AS need FROM ({log})),
        f AS (SELECT DISTINCT topic, 0::BIGINT AS rn, 0::BIGINT AS block, {unit}::BIGINT AS lim, 0::BIGINT AS used, 0::BIGINT AS need FROM d
              UNION ALL
              SELECT d.topic, d.rn, CASE WHEN f.used + d.need <= f.lim THEN f.block ELSE f.block + 1 END,
                     CASE WHEN f.used + d.need <= f.lim THEN f.lim ELSE {size} END,
                     CASE WHEN f.used + d.need <= f.lim THEN f.used + d.need ELSE d.need END, d.need
              FROM f JOIN d ON d.topic = f.topic AND d.rn = f.rn + 1),
        b AS (SELECT topic, rn - 1 AS seq, block, need FROM f WHERE rn > 0)"""


def _pages(log: str, budget: int, entries: int = 2000) -> str:
    fits = f"f.n > 0 AND (f.bytes + d.len > {budget} OR f.n >= {entries})"
    return f"""WITH RECURSIVE d AS (SELECT topic, seq + 1 AS rn, len FROM ({log})),
        f AS (SELECT DISTINCT topic, 0::BIGINT AS rn, 0::BIGINT AS page, 0::BIGINT AS n, 0::BIGINT AS bytes, 0::BIGINT AS len FROM d
              UNION ALL
              SELECT d.topic, d.rn, CASE WHEN {fits} THEN f.page + 1 ELSE f.page END, CASE WHEN {fits} THEN 1 ELSE f.n + 1 END,
                     CASE WHEN {fits} THEN d.len ELSE f.bytes + d.len END, d.len
              FROM f JOIN d ON d.topic = f.topic AND d.rn = f.rn + 1)
        SELECT topic, page, min(rn) - 1 AS first_seq, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM f WHERE rn > 0 GROUP BY topic, page"""


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def _half(log: DataFrame, column: str, share: int = 2) -> DataFrame:
    """Cursors that stand at an entries // share."""
    return log.groupBy("topic").agg(F.floor(F.count("*") / share).cast("bigint").alias(column))


# -- offsets and cursors -----------------------------------------------------


@query("topic_size", f"SELECT topic, count(*) AS entries, CAST(sum(len) AS BIGINT) AS payload_bytes, CAST(sum(len + 256) AS BIGINT) AS footprint FROM ({_E}) GROUP BY topic")
def topic_size(spark, sf_dir):
    return logs.topic_size(events_log(spark, sf_dir))


@query("append_seq", f"SELECT topic, seq, event_id FROM ({_E})")
def append_seq(spark, sf_dir):
    return events_log(spark, sf_dir).select("topic", "seq", "event_id")


@query("read_next_peek", f"WITH e AS ({_E}), c AS (SELECT topic, count(*) // 2 AS cursor FROM e GROUP BY topic) SELECT topic, seq, payload FROM e JOIN c USING (topic) WHERE seq = cursor")
def read_next_peek(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return logs.at_cursor(log, _half(log, "cursor")).select("topic", "seq", "payload")


@query("unread_count", "SELECT event_type AS topic, count(*) - count(*) // 3 AS unread FROM events GROUP BY event_type")
def unread_count(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return logs.unread(log, _half(log, "cursor", 3))


@query("recovered_count", f"WITH {_OFFSETS}, d AS (SELECT topic, max(end_off) // 2 AS durable_off FROM m GROUP BY topic) SELECT topic, count(*) FILTER (WHERE end_off > durable_off) AS unread FROM m JOIN d USING (topic) GROUP BY topic")
def recovered_count(spark, sf_dir):
    offsets = events_log(spark, sf_dir, offsets=True)
    durable = offsets.groupBy("topic").agg(F.floor(F.max("end_off") / 2).cast("bigint").alias("durable_off"))
    return logs.recovered_unread(offsets, durable)


@query("offset_map", f"WITH {_OFFSETS} SELECT topic, seq, start_off, end_off FROM m")
def offset_map(spark, sf_dir):
    return events_log(spark, sf_dir, offsets=True).select("topic", "seq", "start_off", "end_off")


@query("stateless_read", f"WITH {_OFFSETS}, q AS (SELECT topic, max(end_off) * k // 4 + 7 * k AS req FROM m, (SELECT unnest(range(5)) AS k) GROUP BY topic, k) SELECT q.topic, req, seq, greatest(req - start_off - 256, 0) AS trim FROM q JOIN m ON m.topic = q.topic AND start_off <= req AND req < end_off")
def stateless_read(spark, sf_dir):
    offsets = events_log(spark, sf_dir, offsets=True)
    ends = offsets.groupBy("topic").agg(F.max("end_off").alias("end"))
    asked = ends.select("topic", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "end").select("topic", (F.floor(F.col("end") * F.col("k") / 4) + 7 * F.col("k")).cast("bigint").alias("req"))
    return logs.stateless_read(offsets, asked)


@query("batch_validate", f"SELECT event_id // 2500 AS batch, count(*) AS n, CAST(sum(len + 256) AS BIGINT) AS bytes, count(*) <= 2000 AND sum(len + 256) <= 10737418240 AS ok FROM ({_E}) GROUP BY 1")
def batch_validate(spark, sf_dir):
    return logs.batch_checks(events_log(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 2500).cast("bigint")), ["batch"])


@query("order_check", "SELECT event_type AS topic, count(*) FILTER (WHERE event_id % 1000 = 7) = 0 AS ok FROM events GROUP BY event_type")
def order_check(spark, sf_dir):
    log = events_log(spark, sf_dir)
    # some entries were sent with the number of the one after them
    number = F.col("seq") + F.when(F.col("event_id") % 1000 == 7, 1).otherwise(0)
    sent = log.withColumn("line", F.concat(F.lit("seq-"), F.format_string("%06d", number), F.lit(":"), "payload"))
    return routing.order_check(sent, F.regexp_extract("line", r"^seq-(\d+):", 1).cast("bigint"))


# -- blocks, pages, files ----------------------------------------------------


@query("block_pack", f"WITH RECURSIVE {_next_fit(_D, BLOCK)} SELECT topic, block, min(seq) AS first_seq, count(*) AS n, CAST(sum(need) AS BIGINT) AS used FROM b GROUP BY topic, block")
def block_pack(spark, sf_dir):
    return blocks.block_stats(blocks.pack_blocks(documents_log(spark, sf_dir), BLOCK))


@query("page_reads", _pages(_D, PAGE))
def page_reads(spark, sf_dir):
    return blocks.page_reads(documents_log(spark, sf_dir), PAGE)


@query("page_entry_cap", _pages("SELECT 'all' AS topic, row_number() OVER (ORDER BY event_id) - 1 AS seq, 8::BIGINT AS len FROM events", 1 << 40))
def page_entry_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("topic"), "event_id", F.lit(8).cast("bigint").alias("payload_len"))
    return blocks.page_reads(running(rows, ["topic"], "event_id", {"seq": ("sum", F.lit(1).cast("bigint"))}, exclusive=True), 1 << 40)


_FILES = f"""WITH RECURSIVE {_next_fit(_E, SMALL_BLOCK)}, e2 AS ({_E}), x AS (
        SELECT b.topic, b.block, min(e2.event_id) AS opened, CAST(sum(b.need) AS BIGINT) AS used, max(b.seq) AS last_seq FROM b JOIN e2 ON b.topic = e2.topic AND b.seq = e2.seq GROUP BY ALL),
        p AS (SELECT *, (row_number() OVER (ORDER BY opened) - 1) // 100 AS file_no, max(block) OVER (PARTITION BY topic) = block AS is_open FROM x),
        c AS (SELECT topic, count(*) // 2 AS cursor FROM e2 GROUP BY topic)"""


def _placed(spark, sf_dir):
    packed = blocks.pack_blocks(events_log(spark, sf_dir), SMALL_BLOCK, keep=("event_id",))
    stats = packed.groupBy("topic", "block").agg(F.min("event_id").alias("opened"), F.sum(F.col("payload_len") + 256).alias("used"), F.max("seq").alias("last_seq"))
    return blocks.place_files(stats, "opened")


@query("file_place", f"{_FILES} SELECT file_no, count(*) AS blocks, CAST(sum(used) AS BIGINT) AS used FROM p GROUP BY file_no")
def file_place(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("file_no").agg(F.count("*").alias("blocks"), F.sum("used").alias("used"))


@query("reclaimable", f"{_FILES} SELECT file_no, count(*) = 100 AND count(*) FILTER (WHERE is_open) = 0 AND count(*) FILTER (WHERE last_seq < cursor) >= count(*) AS reclaim FROM p JOIN c USING (topic) GROUP BY file_no")
def reclaimable(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    opened = placed.groupBy("topic").agg(F.max("block").alias("open"), (F.max("last_seq") + 1).alias("entries"))
    state = placed.join(opened, "topic").withColumns({"is_open": F.col("block") == F.col("open"), "consumed": F.col("last_seq") < F.floor(F.col("entries") / 2)})
    return blocks.reclaimable(state)


@query("corrupt_prefix", f"WITH RECURSIVE {_next_fit(_E, SMALL_BLOCK)}, v AS (SELECT topic, max(CASE WHEN seq % 97 = 13 THEN 1 ELSE 0 END) OVER (PARTITION BY topic, block ORDER BY seq) AS bad FROM b) SELECT topic, count(*) AS visible FROM v WHERE bad = 0 GROUP BY topic")
def corrupt_prefix(spark, sf_dir):
    packed = blocks.pack_blocks(events_log(spark, sf_dir), SMALL_BLOCK)
    return delivery.valid_prefix(packed, F.col("seq") % 97 == 13).groupBy("topic").agg(F.count("*").alias("visible"))


# -- segments ----------------------------------------------------------------


@query("segment_assign", f"WITH {_segments(_E, SEGMENT)} SELECT topic, segment, first_seq, n FROM s")
def segment_assign(spark, sf_dir):
    return segments.segment_table(events_log(spark, sf_dir), SEGMENT)


@query("segment_leader", f"WITH {_segments(_E, SEGMENT)} SELECT topic, segment, ({_init('topic')} + segment - 1) % {NODES} + 1 AS leader FROM s")
def segment_leader(spark, sf_dir):
    table_ = segments.segment_table(events_log(spark, sf_dir), SEGMENT)
    return table_.select("topic", "segment", segments.leader_of(F.col("topic"), F.col("segment"), NODES).alias("leader"))


@query("sealed_cumulative", f"WITH {_segments(_E, SEGMENT)} SELECT topic, segment, n AS sealed, CAST(sum(n) OVER (PARTITION BY topic ORDER BY segment) AS BIGINT) AS cum FROM s JOIN c USING (topic) WHERE segment < current")
def sealed_cumulative(spark, sf_dir):
    return segments.sealed_cumulative(segments.segment_table(events_log(spark, sf_dir), SEGMENT))


_CONSUMED = (0, 1, 99, 100, 101, 1000)


@query("cursor_locate", f"WITH t AS (SELECT event_type AS topic, count(*) AS total FROM events GROUP BY 1), g AS (SELECT topic, least(k, total) AS g FROM t, (SELECT unnest([{', '.join(map(str, _CONSUMED))}])::BIGINT AS k)) SELECT DISTINCT topic, g, CASE WHEN g = 0 THEN 1 ELSE (g - 1) // 100 + 1 END AS segment, CASE WHEN g = 0 THEN 0 ELSE g - (g - 1) // 100 * 100 END AS delivered FROM g")
def cursor_locate(spark, sf_dir):
    counts = events_log(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("total"))
    consumed = counts.select("topic", F.explode(F.array(*(F.lit(k).cast("bigint") for k in _CONSUMED))).alias("k"), "total").select("topic", F.least("k", "total").alias("g")).distinct()
    segment, delivered = segments.locate(F.col("g"), SEGMENT)
    return consumed.select("topic", "g", segment.alias("segment"), delivered.alias("delivered"))


@query("cursor_advance", f"WITH {_segments(_E, SEGMENT)}, k AS (SELECT unnest([0, 50, 99, 100, 150, 250, 1000000])::BIGINT AS g), r AS (SELECT topic, CASE WHEN g = 0 THEN 0 ELSE (least(g, total) - 1) // 100 + 1 END AS segment, CASE WHEN g = 0 THEN 0 ELSE least(g, total) - (least(g, total) - 1) // 100 * 100 END AS delivered, least(g, total) AS done, total FROM t, k) SELECT DISTINCT topic, segment, delivered, CASE WHEN done < total THEN done END AS seq, CASE WHEN done < total THEN done // 100 + 1 ELSE total // 100 + 1 END AS new_segment, CASE WHEN done < total THEN done % 100 + 1 ELSE total % 100 END AS new_delivered FROM r")
def cursor_advance(spark, sf_dir):
    table_ = segments.segment_table(events_log(spark, sf_dir), SEGMENT)
    total = table_.groupBy("topic").agg(F.sum("n").alias("total"))
    at = total.select("topic", "total", F.explode(F.array(*(F.lit(k).cast("bigint") for k in (0, 50, 99, 100, 150, 250, 1000000)))).alias("k")).withColumn("g", F.least("k", "total"))
    segment, delivered = segments.locate(F.col("g"), SEGMENT)
    cursors = at.select("topic", F.when(F.col("g") == 0, 0).otherwise(segment).cast("bigint").alias("segment"), delivered.alias("delivered")).distinct()
    return segments.advance(cursors, table_)


@query("ownership", f"WITH {_segments(_E, SEGMENT)} SELECT ({_init('topic')} + current - 1) % {NODES} + 1 AS node, count(*) AS open_topics FROM c GROUP BY 1")
def ownership(spark, sf_dir):
    return segments.ownership(segments.segment_table(events_log(spark, sf_dir), SEGMENT), NODES)


@query(
    "tla_invariants",
    f"""WITH {_segments(_E, SEGMENT)}, told AS (SELECT topic, segment, n + CASE WHEN segment % 3 = 1 THEN 1 ELSE 0 END AS n FROM s),
        st AS (SELECT topic, total // {SEGMENT} + 1 - CASE WHEN total % 3 = 0 THEN 1 ELSE 0 END AS current, total // {SEGMENT} * {SEGMENT} AS last_sealed, ({_init('topic')} + total // {SEGMENT}) % {NODES} + 1 + CASE WHEN total % 2 = 0 THEN 1 ELSE 0 END AS leader FROM t),
        lp AS (SELECT topic, seq, seq // {SEGMENT} + 1 AS segment FROM l WHERE event_id % 500 <> 3),
        k AS (SELECT topic, segment, count(*) AS held, min(seq) AS low, max(seq) AS high FROM lp GROUP BY ALL),
        sums AS (SELECT topic, sum(n) AS sealed FROM told JOIN st USING (topic) WHERE segment < st.current GROUP BY topic)
        SELECT 'no_rows_after_open' AS invariant, (SELECT count(*) FROM lp JOIN st USING (topic) WHERE segment > st.current) AS violations
        UNION ALL SELECT 'sealed_count_matches', (SELECT count(*) FROM told JOIN st USING (topic) LEFT JOIN k USING (topic, segment) WHERE segment < st.current AND coalesce(held, 0) <> n)
        UNION ALL SELECT 'last_sealed_is_sum', (SELECT count(*) FROM st LEFT JOIN sums USING (topic) WHERE coalesce(sealed, 0) <> last_sealed)
        UNION ALL SELECT 'contiguous_order', (SELECT count(*) FROM k WHERE high - low + 1 <> held)
        UNION ALL SELECT 'open_leader_valid', (SELECT count(*) FROM st WHERE leader NOT BETWEEN 1 AND {NODES} OR leader <> ({_init('topic')} + current - 1) % {NODES} + 1)""",
)
def tla_invariants(spark, sf_dir):
    log = events_log(spark, sf_dir)
    table_ = segments.segment_table(log, SEGMENT)
    totals = log.groupBy("topic").agg(F.count("*").alias("total"))
    current = segments.segment_of(F.col("total"), SEGMENT)
    leader = segments.leader_of(F.col("topic"), current, NODES)
    # violations of every kind are planted: lost entries, wrong counts, a segment too few, a wrong leader
    states = totals.select("topic", (current - F.when(F.col("total") % 3 == 0, 1).otherwise(0)).alias("current_segment"), ((current - 1) * SEGMENT).alias("last_sealed"), (leader + F.when(F.col("total") % 2 == 0, 1).otherwise(0)).alias("leader"))
    told = table_.withColumn("n", F.col("n") + F.when(F.col("segment") % 3 == 1, 1).otherwise(0))
    return segments.invariants(log.where(F.col("event_id") % 500 != 3), told, states, SEGMENT, NODES)


@query("wal_key_roundtrip", f"WITH {_segments(_E, SEGMENT)} SELECT topic, segment, 't_' || topic || '_s_' || segment AS key, topic AS p_topic, segment AS p_segment FROM s")
def wal_key_roundtrip(spark, sf_dir):
    keyed = segments.segment_table(events_log(spark, sf_dir), SEGMENT).withColumn("key", S.wal_key(F.col("topic"), F.col("segment")))
    topic, segment = S.parse_wal_key(F.col("key"))
    return keyed.select("topic", "segment", "key", topic.alias("p_topic"), segment.alias("p_segment"))


# -- integrity and delivery --------------------------------------------------


@query("checksum", f"SELECT event_id, {_fnv('payload')} AS checksum FROM ({_E})")
def checksum(spark, sf_dir):
    return events_log(spark, sf_dir).select("event_id", S.fnv1a_vector(F.col("payload")).alias("checksum"))


@query("verified_entries", f"SELECT topic, min(seq) FILTER (WHERE event_id % 1009 = 500) AS visible FROM ({_E}) GROUP BY topic HAVING count(*) FILTER (WHERE event_id % 1009 = 500) > 0")
def verified_entries(spark, sf_dir):
    log = events_log(spark, sf_dir)
    stored = log.withColumn("checksum", S.fnv1a_vector(F.col("payload")) + F.when(F.col("event_id") % 1009 == 500, 1).otherwise(0))
    good = delivery.verify(stored, S.fnv1a_vector(F.col("payload")))
    hit = log.where(F.col("event_id") % 1009 == 500).select("topic").distinct()
    return good.join(hit, "topic", "left_semi").groupBy("topic").agg(F.count("*").alias("visible"))


@query("namespace_sanitize", f"WITH u AS (SELECT DISTINCT url AS key FROM pages), c AS (SELECT key, regexp_replace(key, '[^A-Za-z0-9._-]', '_', 'g') AS dir FROM u) SELECT key, CASE WHEN regexp_matches(dir, '^_*$') THEN 'ns_' || printf('%016x', {_fnv('key')}) ELSE dir END AS dir FROM c")
def namespace_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("key")).distinct().withColumn("dir", S.sanitize_namespace(F.col("key")))


_K = (0, 1, 3, 5, 1000)
_READS = f"r AS (SELECT event_type AS topic, count(*) // 3 AS reads FROM events GROUP BY 1), k AS (SELECT unnest([{', '.join(map(str, _K))}])::BIGINT AS k)"


def _reads(spark, sf_dir):
    return _half(events_log(spark, sf_dir), "reads", 3).withColumn("k", F.explode(F.array(*(F.lit(k).cast("bigint") for k in _K))))


@query("durable_point", f"WITH {_READS} SELECT topic, k, reads, reads // greatest(k, 1) * greatest(k, 1) AS durable FROM r, k")
def durable_point(spark, sf_dir):
    return _reads(spark, sf_dir).select("topic", "k", "reads", delivery.durable_point(F.col("reads"), F.col("k")).alias("durable"))


@query("replay_set", f"WITH {_READS} SELECT topic, k, reads % greatest(k, 1) AS duplicates FROM r, k")
def replay_set(spark, sf_dir):
    return _reads(spark, sf_dir).select("topic", "k", delivery.replayed(F.col("reads"), F.col("k")).alias("duplicates"))


@query("dirty_generation", "WITH f AS (SELECT user_id, event_id, event_type <> 'view' AS is_clean, lag(event_type <> 'view', 1, true) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id AS topic, count(*) FILTER (WHERE before <> is_clean) AS generation, arg_max(is_clean, event_id) AS is_clean FROM f GROUP BY user_id")
def dirty_generation(spark, sf_dir):
    flags = table(spark, sf_dir, "events").select(F.col("user_id").alias("topic"), "event_id", (F.col("event_type") != "view").alias("is_clean"))
    return delivery.generations(flags, "topic", "event_id", "is_clean")


@query("monotone_clock", "WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, epoch_ms(ts) // 600000 * 600000 AS ms FROM events) SELECT event_id, greatest(max(ms - i) OVER (ORDER BY i), 1) + i AS clock FROM t")
def monotone_clock(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select("event_id", (F.call_function("div", S.millis(F.col("ts")), F.lit(600000)) * 600000).alias("ms"))
    return delivery.monotone_clock(ticks, "event_id", "ms").select("event_id", "clock")


@query("flush_coalesce", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(DISTINCT event_type) AS paths FROM events GROUP BY 1")
def flush_coalesce(spark, sf_dir):
    return delivery.coalesced_flushes(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


# -- replication -------------------------------------------------------------


@query("kv_lww", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS id FROM events GROUP BY user_id) SELECT user_id::VARCHAR AS key, id::VARCHAR AS value FROM l WHERE kind <> 'error'")
def kv_lww(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("DELETE "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("SET "), F.col("user_id").cast("string"), F.lit("  "), F.col("event_id").cast("string")))
    return replication.materialize(replication.parse_kv(e.select(F.col("event_id").alias("seq"), line.alias("line"))))


_RAFT = "r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 997 = 5 THEN 'purge' WHEN o_orderkey % 499 = 7 THEN 'truncate' ELSE 'entry' END AS kind, CASE WHEN o_orderkey % 997 = 5 THEN o_orderkey // 8 WHEN o_orderkey % 499 = 7 THEN o_orderkey // 2 - 60 ELSE o_orderkey // 2 END AS i FROM orders), a AS (SELECT * FROM r WHERE kind = 'entry'), k AS (SELECT i, max(pos) AS pos FROM a GROUP BY i), s AS (SELECT i, pos FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.kind = 'purge' AND r.pos > k.pos AND r.i >= k.i) AND NOT EXISTS (SELECT 1 FROM r WHERE r.kind = 'truncate' AND r.pos > k.pos AND r.i <= k.i))"


def _raft_records(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.when(key % 997 == 5, "purge").when(key % 499 == 7, "truncate").otherwise("entry")
    index = F.when(kind == "purge", F.floor(key / 8)).when(kind == "truncate", F.floor(key / 2) - 60).otherwise(F.floor(key / 2)).cast("bigint")
    return table(spark, sf_dir, "orders").select(key.alias("pos"), kind.alias("kind"), index.alias("log_index"))


@query("raft_replay", f"WITH {_RAFT} SELECT i AS idx, pos FROM s")
def raft_replay(spark, sf_dir):
    return replication.replay(_raft_records(spark, sf_dir))


@query("log_state", f"WITH {_RAFT} SELECT (SELECT max(i) FROM r WHERE kind = 'purge') AS last_purged, coalesce((SELECT max(i) FROM s), (SELECT max(i) FROM r WHERE kind = 'purge')) AS last_log")
def log_state(spark, sf_dir):
    return replication.log_state(_raft_records(spark, sf_dir))


@query("metadata_apply", f"WITH t AS (SELECT o_orderpriority AS topic, count(*) AS total FROM orders GROUP BY 1) SELECT topic, total // {ORDER_SEGMENT} + 1 AS current_segment, total // {ORDER_SEGMENT} * {ORDER_SEGMENT} AS last_sealed, ({_init('topic')} + total // {ORDER_SEGMENT}) % {NODES} + 1 AS leader FROM t")
def metadata_apply(spark, sf_dir):
    return replication.topic_states(_metadata_commands(spark, sf_dir), NODES)


def _metadata_commands(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    kind = F.when(F.col("seq") == 0, F.array(F.lit("create"))).otherwise(F.array())
    rolled = F.when((F.col("seq") + 1) % ORDER_SEGMENT == 0, F.array(F.lit("rollover"))).otherwise(F.array())
    commands = log.select("topic", (2 * F.col("o_orderkey")).alias("at"), F.explode(F.concat(kind.cast("array<string>"), rolled.cast("array<string>"))).alias("kind"))
    return commands.select("topic", (F.col("at") + F.when(F.col("kind") == "rollover", 1).otherwise(0)).alias("log_index"), "kind", F.when(F.col("kind") == "rollover", ORDER_SEGMENT).alias("sealed_count"))


_PROGRESS = "p AS (SELECT o_orderkey % 50 AS grp, o_orderkey // 50 % 5 AS node, max(o_orderkey) AS matched FROM orders GROUP BY ALL)"


def _progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % 50).alias("grp"), F.pmod(F.floor(F.col("o_orderkey") / 50), F.lit(5)).cast("bigint").alias("node")).agg(F.max("o_orderkey").alias("matched"))


@query("quorum_commit", f"WITH {_PROGRESS}, l AS (SELECT grp, list_sort(list(matched), 'DESC') AS v FROM p GROUP BY grp) SELECT grp, v[len(v) // 2 + 1] AS committed FROM l")
def quorum_commit(spark, sf_dir):
    return replication.quorum(_progress(spark, sf_dir), "grp")


@query("joint_commit", f"WITH {_PROGRESS}, c AS (SELECT grp, 'a' AS config, matched FROM p WHERE node <= 2 UNION ALL SELECT grp, 'b', matched FROM p WHERE node >= 2), l AS (SELECT grp, config, list_sort(list(matched), 'DESC') AS v FROM c GROUP BY ALL) SELECT grp, min(v[len(v) // 2 + 1]) AS committed FROM l GROUP BY grp")
def joint_commit(spark, sf_dir):
    p = _progress(spark, sf_dir)
    both = p.where("node <= 2").withColumn("config", F.lit("a")).unionAll(p.where("node >= 2").withColumn("config", F.lit("b")))
    return replication.joint_quorum(both, "grp", "config")


@query("catch_up", f"WITH {_PROGRESS}, m AS (SELECT max(o_orderkey) AS last FROM orders) SELECT grp, node, last - matched <= 100 AS ready FROM p, m")
def catch_up(spark, sf_dir):
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last"))
    return _progress(spark, sf_dir).crossJoin(F.broadcast(last)).select("grp", "node", replication.caught_up(F.col("last"), F.col("matched"), 100).alias("ready"))


@query("logid_runs", "WITH x AS (SELECT o_orderkey AS idx, o_orderkey // 37 % 3 AS leader FROM orders), y AS (SELECT *, lag(leader) OVER (ORDER BY idx) AS before, max(idx) OVER () AS last FROM x) SELECT leader, idx FROM y WHERE before IS NULL OR before <> leader OR idx = last")
def logid_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.pmod(F.floor(F.col("o_orderkey") / 37), F.lit(3)).cast("bigint").alias("by"))
    return replication.leader_runs(o, "i", "by")


@query("log_conflict", "SELECT o_orderstatus AS follower, min(o_orderkey) AS conflict FROM orders WHERE o_orderkey % 700 > 690 GROUP BY 1")
def log_conflict(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("follower"), F.col("o_orderkey").alias("log_index"))
    term = F.floor(F.col("log_index") / 100).cast("bigint")
    theirs = o.withColumn("term", term + F.when(F.col("log_index") % 700 > 690, 1).otherwise(0))
    return replication.conflicts(o.withColumn("term", term), theirs, "follower")


@query("commit_rule", f"WITH {_PROGRESS} SELECT grp, node, CASE WHEN matched % 3 = 1 AND matched > 5000 THEN matched ELSE 5000 END AS committed FROM p")
def commit_rule(spark, sf_dir):
    return _progress(spark, sf_dir).select("grp", "node", replication.committed_by_leader(F.col("matched"), F.col("matched") % 3, F.lit(1), F.lit(5000).cast("bigint")).alias("committed"))


@query("purge_bound", f"WITH {_PROGRESS} SELECT grp, node, CASE WHEN matched + 1 - 1000 >= 4000 + 2 THEN matched + 1 - 1000 - 1 END AS upto FROM p")
def purge_bound(spark, sf_dir):
    return _progress(spark, sf_dir).select("grp", "node", replication.purge_upto(F.col("matched"), F.lit(4000).cast("bigint"), 1000, 2 - 1).alias("upto"))


_CHANGED = "CASE k WHEN 0 THEN list_sort(list_distinct(list_append([1, 2, 3], id))) WHEN 1 THEN list_filter([1, 2, 3], lambda x: x <> id) WHEN 2 THEN [id] ELSE [1, 2, 3] END"


@query("membership_change", f"WITH r AS (SELECT DISTINCT user_id % 6 AS id, event_id % 4 AS k FROM events), t AS (SELECT id, k, {_CHANGED} AS target FROM r) SELECT id, k, CASE WHEN target = [1, 2, 3] THEN '1,2,3' ELSE '1,2,3|' || array_to_string(target, ',') END AS config FROM t")
def membership_change(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("id"), (F.col("event_id") % 4).alias("k")).distinct()
    kind = F.element_at(F.array(*map(F.lit, ("add", "remove", "replace", "keep"))), (F.col("k") + 1).cast("int"))
    now = F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))
    step = replication.joint_step(F.array(now), replication.change_members(now, kind, F.array("id")))
    return rows.select("id", "k", F.array_join(F.transform(step, lambda c: F.array_join(c.cast("array<string>"), ",")), "|").alias("config"))


# -- routing -----------------------------------------------------------------


@query("lease_fence", "SELECT count(*) FILTER (WHERE user_id % 3 = 0) AS accepted, count(*) FILTER (WHERE user_id % 3 <> 0) AS rejected FROM events")
def lease_fence(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    yes, no = routing.fenced(writes, writes.where(F.col("key") % 3 == 0))
    return yes.agg(F.count("*").alias("accepted")).crossJoin(no.agg(F.count("*").alias("rejected")))


@query("lease_diff", "WITH a AS (SELECT DISTINCT user_id AS key FROM events WHERE user_id % 3 = 0), b AS (SELECT DISTINCT user_id AS key FROM events WHERE user_id % 2 = 0) SELECT key, 'granted' AS change FROM (SELECT key FROM b EXCEPT SELECT key FROM a) UNION ALL SELECT key, 'revoked' FROM (SELECT key FROM a EXCEPT SELECT key FROM b)")
def lease_diff(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    return routing.lease_changes(keys.where("key % 3 = 0"), keys.where("key % 2 = 0"))


@query("leader_asof", f"WITH l AS ({_E}), g AS (SELECT topic, ts, ({_init('topic')} + seq // {SEGMENT}) % {NODES} + 1 AS leader FROM l WHERE seq % {SEGMENT} = 0) SELECT l.event_id, g.leader FROM l ASOF LEFT JOIN g ON l.topic = g.topic AND l.ts >= g.ts")
def leader_asof(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("at", S.micros(F.col("ts")))
    changes = log.where(F.col("seq") % SEGMENT == 0).select("topic", "at", segments.leader_of(F.col("topic"), segments.segment_of(F.col("seq"), SEGMENT), NODES).alias("leader"))
    width = routing.range_width(table(spark, sf_dir, "events").select(S.micros(F.col("ts")).alias("at")), "at")
    return routing.as_of(log.select("topic", "at", "event_id"), changes, "topic", "at", "leader", width).select("event_id", "leader")


@query("rpc_pairs", "SELECT a.conv_id, a.turn, min(b.turn) AS reply_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND a.role = 'user' AND b.role = 'assistant' GROUP BY ALL")
def rpc_pairs(spark, sf_dir):
    return routing.reply_pairs(conversations_log(spark, sf_dir), "conv_id", "turn", "role")


@query("consecutive_dedup", "WITH x AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id AS topic, count(*) AS kept FROM x WHERE before IS DISTINCT FROM event_type GROUP BY user_id")
def consecutive_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("topic"), "event_id", "event_type")
    return routing.consecutive_distinct(rows, ["topic"], "event_id", F.col("event_type")).groupBy("topic").agg(F.count("*").alias("kept"))


@query("protocol_parse", "SELECT CASE event_id % 4 WHEN 0 THEN 'PUT' WHEN 1 THEN 'GET' WHEN 2 THEN 'STATE' ELSE 'FETCH' END AS verb, CASE WHEN event_id % 8 = 1 THEN NULL ELSE event_type END AS topic, CASE WHEN event_id % 4 = 3 THEN 'unknown command' WHEN event_id % 8 = 1 THEN 'GET requires a topic' END AS error, count(*) AS n FROM events GROUP BY ALL")
def protocol_parse(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("PUT "), "event_type", F.lit(" a  b "), "props")).when(F.col("event_id") % 8 == 1, F.lit("GET  \n")).when(k == 1, F.concat(F.lit("GET "), "event_type", F.lit("\n"))).when(k == 2, F.concat(F.lit("STATE "), "event_type")).otherwise(F.concat(F.lit("FETCH "), "event_type"))
    return routing.parse_commands(e.select(line.alias("line"))).groupBy("verb", "topic", "error").agg(F.count("*").alias("n"))


@query("frame_codec", "SELECT url AS line, strlen(url) AS n, true AS ok FROM pages GROUP BY url")
def frame_codec(spark, sf_dir):
    framed = table(spark, sf_dir, "pages").select(F.col("url").alias("line")).distinct().withColumn("f", S.frame(F.col("line")))
    return framed.select("line", S.frame_length(F.col("f")).alias("n"), S.frame_ok(F.col("f")).alias("ok"))


@query("response_codec", "WITH m AS (SELECT DISTINCT event_type AS message, event_id % 4 AS k FROM events) SELECT message, k, CASE k WHEN 0 THEN 'OK' WHEN 1 THEN 'OK ' || message WHEN 2 THEN 'EMPTY' ELSE 'ERR ' || message END AS line, CASE k WHEN 2 THEN 'empty' WHEN 3 THEN 'err' ELSE 'ok' END AS kind, CASE WHEN k IN (1, 3) THEN message END AS parsed FROM m")
def response_codec(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("message"), (F.col("event_id") % 4).alias("k")).distinct()
    kind = F.when(F.col("k") == 2, "empty").when(F.col("k") == 3, "err").otherwise("ok")
    m = m.withColumn("line", S.response(kind, F.when(F.col("k") > 0, F.col("message"))))
    p = S.parse_response(F.col("line"))
    return m.select("message", "k", "line", p["kind"].alias("kind"), p["message"].alias("parsed"))


_TEXTS = "CASE k WHEN 0 THEN n || 's' WHEN 1 THEN ' ' || n || 'm' WHEN 2 THEN n || 'h' WHEN 3 THEN n::VARCHAR WHEN 4 THEN n || 'ms' WHEN 5 THEN 'Async' WHEN 6 THEN 'sync-each' WHEN 7 THEN 'no-fsync' ELSE 'x' || n END"


@query("text_parsers", f"WITH r AS (SELECT DISTINCT event_id % 9 AS k, user_id % 90 AS n FROM events) SELECT {_TEXTS} AS text, CASE k WHEN 0 THEN n WHEN 1 THEN n * 60 WHEN 2 THEN n * 3600 WHEN 3 THEN n END AS seconds, CASE k WHEN 3 THEN n WHEN 4 THEN n WHEN 5 THEN 1000 WHEN 6 THEN 0 WHEN 7 THEN -1 END AS flush_ms FROM r")
def text_parsers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 9).alias("k"), (F.col("user_id") % 90).cast("string").alias("n")).distinct()
    k, n = F.col("k"), F.col("n")
    text = F.when(k == 0, F.concat(n, F.lit("s"))).when(k == 1, F.concat(F.lit(" "), n, F.lit("m"))).when(k == 2, F.concat(n, F.lit("h"))).when(k == 3, n).when(k == 4, F.concat(n, F.lit("ms"))).when(k == 5, "Async").when(k == 6, "sync-each").when(k == 7, "no-fsync").otherwise(F.concat(F.lit("x"), n))
    return rows.select(text.alias("text")).select("text", S.duration_seconds(F.col("text")).alias("seconds"), S.fsync_mode(F.col("text")).alias("flush_ms"))


@query("initial_leader", f"SELECT DISTINCT event_type AS topic, {_init('event_type')}::BIGINT AS leader, event_type || '_' || printf('%016x', {_fnv('event_type')}) AS instance FROM events")
def initial_leader(spark, sf_dir):
    topics = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    return topics.select("topic", S.initial_leader(F.col("topic"), NODES).alias("leader"), S.instance_key(F.col("topic")).alias("instance"))


_CONTENT = "CASE WHEN doc_id % 10 = 3 THEN '~' || substr(text, 2) WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END"


@query("sha_verify", f"SELECT doc_id, CASE WHEN doc_id % 10 <> 4 AND strlen({_CONTENT}) = strlen(text) THEN CASE WHEN sha256({_CONTENT}) = sha256(text) THEN 0 ELSE 1 END ELSE 2 END::INTEGER AS ack FROM documents")
def sha_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sent = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))
    # on the way some chunks are damaged, some grow and some are lost
    k = F.col("doc_id") % 10
    arrived = docs.where(k != 4).select("doc_id", F.when(k == 3, F.concat(F.lit("~"), F.expr("substring(text, 2)"))).when(k == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return delivery.chunk_acks(sent, arrived, "doc_id")


# -- metrics -----------------------------------------------------------------


@query("rate_series", "WITH c AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, n, n - lag(n) OVER (ORDER BY bucket) AS delta FROM c")
def rate_series(spark, sf_dir):
    return metrics.rate_series(table(spark, sf_dir, "events"), "ts", "hour")


_HIST = "h AS (SELECT CASE WHEN n_chars < 4 THEN n_chars ELSE 4 + 4 * (length(bin(n_chars)) - 3) + ((n_chars >> (length(bin(n_chars)) - 3)::BIGINT) & 3) END AS bucket, count(*) AS n FROM documents GROUP BY 1)"


@query("loghist", f"WITH {_HIST} SELECT bucket, n FROM h")
def loghist(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"))


@query("loghist_pct", f"WITH {_HIST}, u AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h), p AS (SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS p), b AS (SELECT p, min(bucket) AS bucket FROM u, p WHERE upto >= greatest(1, ceil(total * p)) GROUP BY p) SELECT p, CASE WHEN bucket < 4 THEN bucket ELSE (4 + bucket % 4) << ((bucket - 4) // 4) END AS value FROM b")
def loghist_pct(spark, sf_dir):
    return metrics.percentiles(metrics.histogram(table(spark, sf_dir, "documents"), F.col("n_chars")))


@query("stored_state", f"WITH {_segments(_E, SEGMENT)} SELECT topic, '{{\"current_segment\":' || current || ',\"sealed\":' || (current - 1) * {SEGMENT} || '}}' AS state FROM c")
def stored_state(spark, sf_dir):
    current = segments.segment_table(events_log(spark, sf_dir), SEGMENT).groupBy("topic").agg(F.max("segment").alias("current_segment"))
    return current.select("topic", F.to_json(F.struct("current_segment", ((F.col("current_segment") - 1) * SEGMENT).alias("sealed"))).alias("state"))


# -- further analytics over recorded events ----------------------------------


@query("metadata_replies", "WITH c AS (SELECT o_orderkey AS i, o_orderpriority AS topic, CASE o_orderkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'upsert_node' ELSE 'rollover' END AS kind FROM orders), f AS (SELECT topic, min(i) AS since FROM c WHERE kind = 'create' GROUP BY topic) SELECT topic, CASE kind WHEN 'upsert_node' THEN 'NODE' WHEN 'create' THEN CASE WHEN i = since THEN 'CREATED' ELSE 'EXISTS' END ELSE CASE WHEN i > since THEN 'ROLLED' ELSE 'ERR' END END AS reply, count(*) AS n FROM c LEFT JOIN f USING (topic) GROUP BY ALL")
def metadata_replies(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    kind = F.when(k == 0, "create").when(k == 1, "upsert_node").otherwise("rollover")
    commands = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("log_index"), kind.alias("kind"), F.col("o_orderpriority").alias("topic"), F.lit(10).alias("sealed_count"))
    return replication.command_results(commands).groupBy("topic", "reply").agg(F.count("*").alias("n"))


@query("rpc_timeouts", "SELECT event_id AS id, CASE WHEN event_id % 7 <= 4 THEN ts + to_seconds(event_id % 7) END AS answered FROM events")
def rpc_timeouts(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    replies = calls.select("id", (F.col("ts") + F.make_dt_interval(secs=F.col("id") % 7)).alias("ts"))
    return routing.matched_calls(calls, replies, 4).select("id", "answered")


@query("fault_filter", "SELECT count(*) FILTER (WHERE NOT ((a = 0 AND b = 1) OR (a = 2 AND b = 3))) AS delivered, count(*) FILTER (WHERE (a = 0 AND b = 1) OR (a = 2 AND b = 3)) AS dropped FROM (SELECT least(user_id % 5, event_id % 5) AS a, greatest(user_id % 5, event_id % 5) AS b FROM events)")
def fault_filter(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("src"), (F.col("event_id") % 5).alias("dst"))
    cut = spark.createDataFrame([(1, 0), (2, 3)], "src bigint, dst bigint")
    kept, gone = routing.dropped(messages, cut)
    return kept.agg(F.count("*").alias("delivered")).crossJoin(gone.agg(F.count("*").alias("dropped")))


@query("vote_grants", "SELECT user_id AS node, count(*) FILTER (WHERE event_id % 3 <> 0 AND event_id % 11 >= 5 AND event_id % 13 >= 6) AS granted FROM events GROUP BY user_id")
def vote_grants(spark, sf_dir):
    i = F.col("event_id")
    ok = replication.vote_granted(i % 3 == 0, i % 11, F.lit(5), i % 13, F.lit(6))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.count_if(ok).alias("granted"))


@query("first_true", "SELECT user_id AS node, min(ts) AS first_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_true(spark, sf_dir):
    samples = table(spark, sf_dir, "events").withColumnRenamed("user_id", "node")
    return replication.first_time(samples, ["node"], "ts", F.col("event_type") == "purchase")


@query("kv_snapshot", ORACLES["kv_lww"])
def kv_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("SET")
    commands = e.select(op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    upto = 4000
    return replication.with_snapshot(replication.materialize(commands.where(F.col("seq") <= upto)), commands, upto)


_SAMPLED = "s AS (SELECT event_type AS system, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT system, bucket, CAST(sum(n) OVER (PARTITION BY system ORDER BY bucket) AS BIGINT) AS total, row_number() OVER (PARTITION BY system ORDER BY bucket) * 0.5::DOUBLE AS elapsed FROM s), r AS (SELECT *, (total - lag(total) OVER (PARTITION BY system ORDER BY bucket)) / 0.5::DOUBLE AS rate FROM c)"


def _sampled(spark, sf_dir):
    from pyspark.sql import Window

    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system"), F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("system").orderBy("bucket")
    return metrics.rates(hours.select("system", "bucket", F.sum("n").over(w).alias("total"), (F.row_number().over(w) * 0.5).cast("double").alias("elapsed")), ["system"], "bucket", "total")


@query("sample_rates", f"WITH {_SAMPLED} SELECT system, bucket, total, rate FROM r")
def sample_rates(spark, sf_dir):
    return _sampled(spark, sf_dir).select("system", "bucket", "total", "rate")


@query("bench_totals", f"WITH {_SAMPLED} SELECT system, max(total) AS total, max(total) / max(elapsed) AS avg_rate, max(rate) AS max_rate FROM r GROUP BY system")
def bench_totals(spark, sf_dir):
    return metrics.totals(_sampled(spark, sf_dir), ["system"], "total", "elapsed", "rate")


@query("read_from_offset", f"WITH {_OFFSETS}, q AS (SELECT topic, max(end_off) // 2 AS req FROM m GROUP BY topic) SELECT q.topic, req, count(*) AS n, CAST(sum(len - greatest(least(req - start_off - 256, len), 0)) AS BIGINT) AS bytes FROM q JOIN m ON m.topic = q.topic AND end_off > req GROUP BY ALL")
def read_from_offset(spark, sf_dir):
    offsets = events_log(spark, sf_dir, offsets=True)
    asked = offsets.groupBy("topic").agg(F.floor(F.max("end_off") / 2).cast("bigint").alias("req"))
    return logs.read_from(offsets, asked).groupBy("topic", "req").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))


@query("entry_limits", "SELECT source AS topic, count(*) FILTER (WHERE strlen(text) + 256 <= 1073741824) AS ok, CAST(sum(((strlen(text) + 256 + 1023) // 1024) * 1024) AS BIGINT) AS allocated FROM documents GROUP BY source")
def entry_limits(spark, sf_dir):
    size = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("topic")).agg(F.count_if(logs.entry_ok(size)).alias("ok"), F.sum(S.allocation(S.footprint(size), 1024)).alias("allocated"))


@query("voter_sets", "WITH v AS (SELECT DISTINCT user_id % 9 AS node, event_id % 2 AS config FROM events WHERE user_id % 9 < 6), n AS (SELECT DISTINCT user_id % 9 AS node FROM events) SELECT n.node, n.node IN (SELECT node FROM v) AS voter FROM n")
def voter_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("node"), (F.col("event_id") % 2).alias("config")).distinct()
    voters = e.where("node < 6 AND config = 0").select("node").union(e.where("node < 6 AND config = 1").select("node")).distinct()
    return e.select("node").distinct().join(voters.withColumn("voter", F.lit(True)), "node", "left").fillna(False, ["voter"])


@query("cursor_index", "SELECT user_id AS topic, arg_max(event_id % 1000, event_id) AS cursor FROM events GROUP BY user_id")
def cursor_index(spark, sf_dir):
    updates = table(spark, sf_dir, "events")
    return updates.groupBy(F.col("user_id").alias("topic")).agg(F.max_by(F.col("event_id") % 1000, "event_id").alias("cursor"))


@query("peer_ids", "SELECT DISTINCT user_id AS port, CASE WHEN user_id % 10 <> 0 THEN user_id % 10 END AS peer FROM events")
def peer_ids(spark, sf_dir):
    ports = table(spark, sf_dir, "events").select(F.col("user_id").alias("port")).distinct()
    return ports.select("port", S.peer_id(F.col("port")).alias("peer"))


@query("monitor_rollover", "WITH RECURSIVE h AS (SELECT event_type AS topic, date_trunc('hour', ts) AS tick, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT topic, n, row_number() OVER (PARTITION BY topic ORDER BY tick) AS rn FROM h), f AS (SELECT DISTINCT topic, 0::BIGINT AS rn, 1::BIGINT AS segment, 0::BIGINT AS held, 0::BIGINT AS n FROM t UNION ALL SELECT t.topic, t.rn, CASE WHEN f.held >= 20 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.held >= 20 THEN t.n ELSE f.held + t.n END, t.n FROM f JOIN t ON t.topic = f.topic AND t.rn = f.rn + 1) SELECT topic, segment, CAST(sum(n) AS BIGINT) AS n FROM f WHERE rn > 0 GROUP BY topic, segment")
def monitor_rollover(spark, sf_dir):
    return segments.tick_rollover(events_log(spark, sf_dir), "ts", "1 hour", 20)


@query("raft_arithmetic", f"WITH {_PROGRESS} SELECT grp, node, least(matched, 9000) AS purge_to, matched // 5000 AS snapshots, greatest(100, matched - 40) AS read_at FROM p")
def raft_arithmetic(spark, sf_dir):
    m = F.col("matched")
    return _progress(spark, sf_dir).select("grp", "node", replication.purge_requested(m, F.lit(9000).cast("bigint")).alias("purge_to"), replication.snapshots_taken(m).alias("snapshots"), replication.read_index(F.lit(100).cast("bigint"), m - 40).alias("read_at"))


@query("membership_valid", "SELECT DISTINCT user_id % 9 AS node, event_id % 2 AS config FROM events WHERE user_id % 9 > 6")
def membership_valid(spark, sf_dir):
    voters = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("node"), (F.col("event_id") % 2).alias("config")).distinct()
    return replication.invalid_voters(voters, spark.range(7).withColumnRenamed("id", "node"))


@query("node_metrics", "SELECT user_id AS id, max(event_id) AS last_log_index, max(event_id) % 7 AS vote_term, max(event_id) - 1 AS applied, user_id % 3 = 0 AS leads, user_id || ',' || (user_id + 1) AS voters, max(event_id) - 5 AS matched FROM events GROUP BY user_id")
def node_metrics(spark, sf_dir):
    u, m = F.col("user_id"), F.col("m")
    at = lambda x: F.struct((m % 7).alias("term"), x.alias("index"))
    said = F.struct(
        u.alias("id"),
        (m % 7).alias("current_term"),
        F.struct((m % 7).alias("term"), u.alias("node_id"), F.lit(True).alias("committed")).alias("vote"),
        m.alias("last_log_index"),
        at(m - 1).alias("last_applied"),
        F.when(u % 3 == 0, "Leader").otherwise("Follower").alias("state"),
        F.struct(F.array(F.array(u, u + 1)).alias("configs")).alias("membership"),
        F.create_map(F.lit("1"), at(m - 5)).alias("replication"),
    )
    lines = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("m")).select(F.to_json(said).alias("line"))
    r = lines.select(replication.metrics_record(F.col("line")).alias("r"))
    return r.select("r.id", "r.last_log_index", F.col("r.vote.term").alias("vote_term"), F.col("r.last_applied.index").alias("applied"), (F.col("r.state") == "Leader").alias("leads"), F.array_join(F.element_at("r.membership.configs", 1).cast("array<string>"), ",").alias("voters"), F.element_at("r.replication", F.lit("1"))["index"].alias("matched"))


_VALUE = "((o_orderkey * 100 + 1) * CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 1 END)"


@query("value_formats", f"SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1e6) WHEN v >= 1000 THEN printf('%.1fK', v / 1e3) ELSE v::VARCHAR END AS short, CASE WHEN v >= 1000000000 THEN printf('%.1fGB/s', v / 1e9) WHEN v >= 1000000 THEN printf('%.1fMB/s', v / 1e6) WHEN v >= 1000 THEN printf('%.1fKB/s', v / 1e3) ELSE v || 'B/s' END AS rate FROM (SELECT o_orderkey, {_VALUE} AS v FROM orders)")
def value_formats(spark, sf_dir):
    k = F.col("o_orderkey")
    v = (k * 100 + 1) * F.when(k % 3 == 0, 1000).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.short_number(v).alias("short"), S.bandwidth(v).alias("rate"))


@query("payload_heads", "SELECT event_id, event_id % 200 AS topic_index, event_id // 200 AS chunk_index, 'a' || chr(65533) || 'b' AS text FROM events")
def payload_heads(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    head = F.concat(F.lpad(F.hex(F.col("event_id") % 200), 2, "0"), F.lpad(F.hex(F.floor(F.col("event_id") / 200)), 16, "0"), F.lit("61FF62"))
    ids = S.payload_ids(F.col("p"))
    return e.withColumn("p", F.unhex(head)).select("event_id", ids["topic_index"].alias("topic_index"), ids["chunk_index"].cast("bigint").alias("chunk_index"), S.lossy_text(F.expr("substring(p, 10, 3)")).alias("text"))


# -- further operators -------------------------------------------------------


@query("batch_pack", f"WITH RECURSIVE {_next_fit(_D, SMALL_BLOCK, False)} SELECT topic, block, min(seq) AS first_seq, count(*) AS n, CAST(sum(need) AS BIGINT) AS used FROM b GROUP BY topic, block")
def batch_pack(spark, sf_dir):
    return blocks.block_stats(blocks.pack_blocks(documents_log(spark, sf_dir), SMALL_BLOCK, batched=True))


FILE_BYTES = 50_000


@query(
    "file_place_sized",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS opened, row_number() OVER (ORDER BY o_orderkey) AS rn, 1000 + o_orderkey % 7777 AS size, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS first FROM orders),
        f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS opened, 0::BIGINT AS size, 0::BIGINT AS file_no, 0::BIGINT AS used
              UNION ALL
              SELECT o.rn, o.opened, o.size, CASE WHEN CASE WHEN o.first THEN f.used < {FILE_BYTES} ELSE f.used + o.size <= {FILE_BYTES} END THEN f.file_no ELSE f.file_no + 1 END,
                     CASE WHEN CASE WHEN o.first THEN f.used < {FILE_BYTES} ELSE f.used + o.size <= {FILE_BYTES} END THEN f.used + o.size ELSE o.size END
              FROM f JOIN o ON o.rn = f.rn + 1)
        SELECT opened, size, file_no, used - size AS file_off FROM f WHERE rn > 0""",
)
def file_place_sized(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    firsts = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("opened")).select("opened", F.lit(True).alias("first"))
    sized = o.select(F.col("o_orderkey").alias("opened"), (1000 + F.col("o_orderkey") % 7777).alias("size")).join(firsts, "opened", "left").fillna(False, ["first"])
    return blocks.place_sized(sized, "opened", file_bytes=FILE_BYTES)


@query("leader_join", f"WITH {_segments(_E, SEGMENT)}, r AS (SELECT topic, segment, ({_init('topic')} + segment - 1) % {NODES} + 1 AS leader FROM s WHERE segment % 2 = 1), now AS (SELECT topic, ({_init('topic')} + current - 1) % {NODES} + 1 AS leader FROM c) SELECT l.topic, coalesce(r.leader, now.leader) AS leader, count(*) AS n FROM l JOIN now ON now.topic = l.topic LEFT JOIN r ON r.topic = l.topic AND r.segment = l.seq // {SEGMENT} + 1 GROUP BY ALL")
def leader_join(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("segment", segments.segment_of(F.col("seq"), SEGMENT))
    table_ = segments.with_open(segments.segment_table(log, SEGMENT))
    leader = segments.leader_of(F.col("topic"), F.col("segment"), NODES).alias("leader")
    # only odd segments are on record
    known = table_.where("segment % 2 = 1").select("topic", "segment", leader)
    now = table_.where("segment = current").select("topic", leader)
    return segments.with_leader(log, known, now).groupBy("topic", "leader").agg(F.count("*").alias("n"))


@query("node_address", f"WITH {_segments(_E, SEGMENT)} SELECT topic, segment, leader, n_name AS address FROM (SELECT topic, segment, ({_init('topic')} + segment - 1) % {NODES} + 1 AS leader FROM s) LEFT JOIN nation ON n_nationkey = leader AND n_nationkey <> 3")
def node_address(spark, sf_dir):
    table_ = segments.segment_table(events_log(spark, sf_dir), SEGMENT).select("topic", "segment", segments.leader_of(F.col("topic"), F.col("segment"), NODES).alias("leader"))
    nodes = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_name").alias("address"))
    return segments.with_address(table_, nodes).select("topic", "segment", "leader", "address")


@query("tail_fold", f"WITH RECURSIVE {_next_fit(_E, SMALL_BLOCK)}, m AS (SELECT topic, max(block) AS open FROM b GROUP BY topic), k AS (SELECT unnest([0, 1, 3, 1000000])::BIGINT AS k) SELECT topic, k * 10 + 7 AS block_id, CASE WHEN k < open THEN k ELSE 0 END AS place, CASE WHEN k < open THEN 5 * k ELSE 0 END AS \"offset\" FROM m, k")
def tail_fold(spark, sf_dir):
    made = blocks.block_stats(blocks.pack_blocks(events_log(spark, sf_dir), SMALL_BLOCK))
    open_ = made.groupBy("topic").agg(F.max("block").alias("open"))
    chain = made.join(open_, "topic").where("block < open").select("topic", (F.col("block") * 10 + 7).alias("block_id"), F.col("block").alias("place"))
    at = open_.select("topic", F.explode(F.array(*(F.lit(k).cast("bigint") for k in (0, 1, 3, 1_000_000)))).alias("k"))
    return logs.at_tail(at.select("topic", (F.col("k") * 10 + 7).alias("block_id"), (5 * F.col("k")).alias("offset")), chain)


@query(
    "consecutive_check",
    """WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS follower, CASE WHEN event_id % 50 > 0 THEN event_id % 5000 END AS i, event_id % 5000 // 100 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS term FROM events),
        j AS (SELECT a.event_id, a.i, a.term, o_orderkey // 100 AS mine FROM a LEFT JOIN orders ON o_orderstatus = follower AND o_orderkey = i),
        v AS (SELECT *, i IS NULL OR coalesce(mine = term, false) AS accepted FROM j)
        SELECT event_id, mine AS local_term, accepted, CASE WHEN NOT accepted THEN i END AS truncate_from FROM v""",
)
def consecutive_check(spark, sf_dir):
    i = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, "FOP")), (i % 3 + 1).cast("int"))
    asked = table(spark, sf_dir, "events").select("event_id", name.alias("follower"), F.when(i % 50 > 0, i % 5000).alias("prev_index"), (F.floor(i % 5000 / 100) + F.when(i % 5 == 0, 1).otherwise(0)).alias("prev_term"))
    mine = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("follower"), F.col("o_orderkey").alias("log_index"), F.floor(F.col("o_orderkey") / 100).alias("term"))
    return replication.consecutive(asked, mine, "follower").select("event_id", "local_term", "accepted", "truncate_from")


@query("writer_conflicts", "WITH b AS (SELECT event_type AS topic, event_id AS batch, ts AS start_ts, ts + to_minutes((event_id % 90)::BIGINT) AS end_ts FROM events), w AS (SELECT *, max(end_ts) OVER (PARTITION BY topic ORDER BY start_ts, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM b) SELECT topic, batch FROM w WHERE start_ts < busy")
def writer_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    batches = e.select(F.col("event_type").alias("topic"), F.col("event_id").alias("batch"), F.col("ts").alias("start_ts"), (F.col("ts") + F.make_dt_interval(mins=F.col("event_id") % 90)).alias("end_ts"))
    return delivery.overlapping(batches).select("topic", "batch")


_APPLIED = "a AS (SELECT o_orderkey AS i, CASE o_orderkey % 10 WHEN 0 THEN 'blank' WHEN 1 THEN 'membership' ELSE 'normal' END AS kind, o_custkey % 50 AS k FROM orders)"


def _committed(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    kind = F.when(k == 0, "blank").when(k == 1, "membership").otherwise("normal")
    key = (F.col("o_custkey") % 50).cast("string")
    line = F.when(k == 1, F.concat(key, F.lit(",1"))).when(k == 2, F.concat(F.lit("DELETE "), key)).when(k > 2, F.concat(F.lit("SET "), key, F.lit(" "), F.col("o_orderkey").cast("string")))
    entries = o.select(F.col("o_orderkey").alias("log_index"), kind.alias("kind"), line.alias("data"))
    # some entries are delivered again after a restart
    return entries.unionAll(entries.where(F.col("log_index") % 7 == 0))


@query("applied_kv", f"WITH {_APPLIED} SELECT k::VARCHAR AS key, max(i)::VARCHAR AS value FROM a WHERE kind = 'normal' GROUP BY k HAVING max(i) % 10 > 2")
def applied_kv(spark, sf_dir):
    return replication.apply_entries(_committed(spark, sf_dir))[0]


@query("applied_state", f"WITH {_APPLIED} SELECT (SELECT max(i) FROM a) AS last_applied, max(i) AS membership_index, array_to_string(list_sort([arg_max(k, i), 1]), ',') AS membership FROM a WHERE kind = 'membership'")
def applied_state(spark, sf_dir):
    state = replication.apply_entries(_committed(spark, sf_dir))[1]
    return state.withColumn("membership", F.array_join(F.col("membership").cast("array<string>"), ","))


@query("metadata_restore", ORACLES["metadata_apply"])
def metadata_restore(spark, sf_dir):
    commands = _metadata_commands(spark, sf_dir)
    cut = 20_001  # commands up to here are in the snapshot
    saved = replication.snapshot_states(replication.topic_states(commands.where(F.col("log_index") <= cut), NODES))
    return replication.topic_states(commands.where(F.col("log_index") > cut), NODES, replication.restore_states(saved))


@query(
    "sample_files",
    """WITH h AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS at, count(*) AS n FROM events GROUP BY 1)
        SELECT 'writes' AS kind, count(*) AS samples, sum(n) * 1.0::DOUBLE AS total FROM h
        UNION ALL SELECT 'batch', count(*), sum(n) * 2.0::DOUBLE FROM h
        UNION ALL SELECT 'reads', count(*), sum(n) * 0.5::DOUBLE FROM h
        UNION ALL SELECT 'scaling', count(*), sum(n) * 3.0::DOUBLE FROM h""",
)
def sample_files(spark, sf_dir):
    hours = table(spark, sf_dir, "events").groupBy(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("timestamp")).agg(F.count("*").alias("n"))
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    wide = hours.select("timestamp", F.lit(0.5).alias("elapsed_seconds"), *(F.lit(1.0).alias(c) for c in ("writes_per_second", "bytes_per_second", "batches_per_second", "entries_per_second", "write_mb_per_sec", "read_mb_per_sec", "dirty_ratio_percent", "total_read_mb")), F.lit("write").alias("phase"), n.alias("total_writes"), (n * 100).alias("total_bytes"), (n * 2).alias("total_batches"), n.alias("total_entries"), (n * 0.5).cast("double").alias("total_write_mb"), zero.alias("dirty_pages_kb"), F.lit(4).alias("threads"), (n * 3.0).cast("double").alias("throughput"))
    base, out = shared_folder(spark, "samples"), None
    for kind, total in (("writes", "total_writes"), ("batch", "total_batches"), ("reads", "total_write_mb"), ("scaling", "throughput")):
        metrics.write_samples(wide, f"{base}/{kind}", kind)
        row = metrics.read_samples(spark, f"{base}/{kind}", kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("samples"), F.sum(total).cast("double").alias("total"))
        out = row if out is None else out.unionAll(row)
    return out


@query("unknown_topics", "SELECT user_id AS topic, count(*) AS n FROM events WHERE user_id % 4 = 1 GROUP BY user_id")
def unknown_topics(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("topic"))
    return routing.unknown_topics(asked, asked.where("topic % 4 <> 1")).groupBy("topic").agg(F.count("*").alias("n"))


@query("delayed_messages", "SELECT event_id, ts + to_milliseconds(CASE WHEN least(user_id % 5, event_id % 5) = 0 AND greatest(user_id % 5, event_id % 5) = 1 THEN 1500 ELSE 0 END) AS arrives FROM events")
def delayed_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("src"), (F.col("event_id") % 5).alias("dst"))
    slow = spark.createDataFrame([(1, 0, 700), (0, 1, 1500)], "src bigint, dst bigint, millis bigint")
    return routing.delayed(messages, slow).select("event_id", "arrives")


@query("verified_skip", "SELECT event_type AS topic, count(*) FILTER (WHERE event_id % 1009 <> 500) AS visible FROM events GROUP BY event_type")
def verified_skip(spark, sf_dir):
    log = events_log(spark, sf_dir)
    sums = S.fnv1a_vector(F.col("payload"))
    stored = log.withColumn("checksum", sums + F.when(F.col("event_id") % 1009 == 500, 1).otherwise(0))
    return delivery.verify(stored, sums, "skip").groupBy("topic").agg(F.count("*").alias("visible"))


@query("rpc_envelopes", "SELECT CASE event_id % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'response' WHEN 2 THEN 'one_way' END AS type, event_id % 4 < 2 AS has_id, CASE WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'late' END AS error, count(*) AS n, CAST(sum(CASE WHEN event_id % 4 < 3 THEN user_id END) AS BIGINT) AS nodes FROM events GROUP BY ALL")
def rpc_envelopes(spark, sf_dir):
    i, k = F.col("event_id"), F.col("event_id") % 4
    payload = F.struct(F.lit("append").alias("kind"), F.col("user_id").alias("node"))
    said = F.struct(F.element_at(F.array(*map(F.lit, ("Request", "Response", "one_way", "Gossip"))), (k + 1).cast("int")).alias("type"), i.alias("id"), payload.alias("payload"), F.when(i % 3 == 0, "late").alias("error"))
    e = table(spark, sf_dir, "events").select(replication.envelope(F.to_json(said)).alias("e"))
    has_id = F.col("e.id").isNotNull()
    return e.groupBy(F.col("e.type").alias("type"), has_id.alias("has_id"), F.col("e.error").alias("error")).agg(F.count("*").alias("n"), F.sum("e.payload.node").alias("nodes"))


@query("membership_sets", "WITH r AS (SELECT DISTINCT user_id % 7 AS a, event_id % 7 AS b FROM events) SELECT a, b, array_to_string(list_sort(list_distinct([1, 2, a, b])), ',') AS voters, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: x NOT IN (1, 2, a, b))), ',') AS learners FROM r")
def membership_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("a"), (F.col("event_id") % 7).alias("b")).distinct()
    configs = F.array(F.array(F.lit(1).cast("bigint"), F.col("a")), F.array(F.lit(2).cast("bigint"), F.col("b")))
    nodes = F.map_from_arrays(F.array(*(F.lit(x).cast("bigint") for x in range(1, 8))), F.array(*map(F.lit, "abcdefg")))
    text = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    return rows.select("a", "b", text(replication.voter_ids(configs)).alias("voters"), text(replication.learner_ids(configs, nodes)).alias("learners"))


@query("membership_errors", "WITH r AS (SELECT DISTINCT user_id % 6 AS a, event_id % 4 AS k FROM events) SELECT a, k, CASE WHEN k = 0 THEN 'no config' WHEN k = 1 THEN 'empty config' WHEN a NOT IN (1, 2, 3) THEN 'voter without a node' END AS error FROM r")
def membership_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("a"), (F.col("event_id") % 4).alias("k")).distinct()
    none, one = F.array().cast("array<array<bigint>>"), F.array(F.lit(1).cast("bigint"), F.col("a"))
    configs = F.when(F.col("k") == 0, none).when(F.col("k") == 1, F.array(one, F.array().cast("array<bigint>"))).otherwise(F.array(one))
    nodes = F.map_from_arrays(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3))), F.array(*map(F.lit, "xyz")))
    return replication.membership_errors(rows.withColumns({"configs": configs, "nodes": nodes})).select("a", "k", "error")


_KINDS = ("add_voter_ids", "add_voters", "remove_voters", "replace_voters", "add_nodes", "set_nodes", "remove_nodes", "replace_nodes", "other")


@query(
    "membership_batch",
    """WITH r AS (SELECT DISTINCT user_id % 7 AS n, event_id % 9 AS k FROM events), x AS (SELECT *, lpad(n::VARCHAR, 2, '0') AS t FROM r),
        v AS (SELECT *, CASE WHEN k = 8 THEN 'unknown change' WHEN k IN (0, 3) AND n NOT IN (1, 2, 3) OR k = 6 AND n IN (1, 2) THEN 'voter without a node' END AS error,
              CASE WHEN k IN (0, 1) THEN list_sort(list_distinct([1, 2, n])) WHEN k = 2 THEN list_filter([1, 2], lambda i: i <> n) WHEN k = 3 THEN [n] ELSE [1, 2] END AS v,
              CASE WHEN k IN (1, 4) AND n NOT IN (1, 2, 3) THEN ['01:a', '02:b', '03:c', t || ':x']
                   WHEN k = 5 THEN list_append(list_filter(['01:a', '02:b', '03:c'], lambda s: NOT starts_with(s, t || ':')), t || ':x')
                   WHEN k = 6 THEN list_filter(['01:a', '02:b', '03:c'], lambda s: NOT starts_with(s, t || ':'))
                   WHEN k = 7 THEN ['01:p', '02:q', (n + 10) || ':x'] ELSE ['01:a', '02:b', '03:c'] END AS w FROM x)
        SELECT n, k, array_to_string(CASE WHEN error IS NULL THEN v ELSE [1, 2] END, ',') AS voters, array_to_string(list_sort(CASE WHEN error IS NULL THEN list_append(w, '09:i') ELSE ['01:a', '02:b', '03:c'] END), ',') AS nodes, error FROM v""",
)
def membership_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("n"), (F.col("event_id") % 9).alias("k")).distinct()
    number = lambda x: F.lit(x).cast("bigint")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("k") + 1).cast("int"))
    given = F.when(F.col("k") == 7, F.create_map(number(1), F.lit("p"), number(2), F.lit("q"), F.col("n") + 10, F.lit("x"))).otherwise(F.create_map(F.col("n"), F.lit("x")))
    one = F.struct(kind.alias("kind"), F.array("n").alias("ids"), given.alias("nodes"))
    two = F.struct(F.lit("add_nodes").alias("kind"), F.array("n").alias("ids"), F.create_map(number(9), F.lit("i")).alias("nodes"))
    now = F.map_from_arrays(F.array(number(1), number(2), number(3)), F.array(*map(F.lit, "abc")))
    m = rows.withColumn("m", replication.changed_membership(F.array(number(1), number(2)), now, F.array(one, two)))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("m.nodes"), lambda e: F.concat(F.lpad(e["key"].cast("string"), 2, "0"), F.lit(":"), e["value"]))), ",")
    return m.select("n", "k", F.array_join(F.col("m.voters").cast("array<string>"), ",").alias("voters"), text.alias("nodes"), F.col("m.error").alias("error"))


@query("engine_drain", "SELECT event_type AS topic, count(*) AS entries, count(*) AS delivered, max(event_id)::VARCHAR AS last FROM events GROUP BY event_type")
def engine_drain(spark, sf_dir):
    """Two engines write one folder, and two read it to the end: each entry comes once, in order."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("position"), F.col("event_id").cast("string").cast("binary").alias("payload"))
    root = shared_folder(spark, "engine")
    one, two = LogEngine(spark, root), LogEngine(spark, root)
    middle = rows.agg(F.expr("percentile_approx(position, 0.5)")).first()[0] or 0
    one.append_frame(rows.where(F.col("position") <= middle))
    two.append_frame(rows.where(F.col("position") > middle))
    out = one.log().limit(0)
    for topic in sorted(one.topics()):
        some = two.read_page(topic, 200)
        out = out.unionByName(one.log().where((F.col("topic") == topic) & (F.col("seq") < len(some)))).unionByName(one.drain(topic)).unionByName(two.drain(topic))
    ends = one.log().groupBy("topic").agg(F.count("*").alias("entries"))
    got = out.groupBy("topic").agg(F.countDistinct("seq", "payload").alias("delivered"), F.count("*").alias("__all"), F.max_by(F.col("payload").cast("string"), "seq").alias("last"))
    return ends.join(got.where("delivered = __all"), "topic").select("topic", "entries", "delivered", "last")


# -- streaming ---------------------------------------------------------------


def _events_stream(spark, sf_dir):
    stream = follow(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return stream.withColumn("ts", S.as_instant(F.col("ts")))


@query("stream_tail", "SELECT event_type AS topic, count(*) AS n FROM events GROUP BY event_type")
def stream_tail(spark, sf_dir):
    return tail_counts(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, "event_type")


@query("window_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, sf_dir):
    out = finished(windowed_counts(_events_stream(spark, sf_dir), "ts", "event_type", "1 hour", "10 minutes"))
    return out.select(S.as_written(F.col("window.start")).alias("start"), "event_type", "n")


@query("sliding_counts", "WITH w AS (SELECT event_type, ts, unnest([0, 1]) AS k FROM events) SELECT time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    out = finished(windowed_counts(_events_stream(spark, sf_dir), "ts", "event_type", "1 hour", "10 minutes", "30 minutes"))
    return out.select(S.as_written(F.col("window.start")).alias("start"), "event_type", "n")


_SESSIONS = "x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)"


@query("session_counts", f"WITH {_SESSIONS} SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM y GROUP BY user_id")
def session_counts(spark, sf_dir):
    out = finished(sessions(_events_stream(spark, sf_dir), "ts", "user_id", "30 minutes", "1 hour"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


_DELIVERY = "event_id % 10"


@query(
    "late_counts",
    f"""WITH p AS (SELECT ts, time_bucket(INTERVAL '1 hour', ts) AS start, CASE WHEN {_DELIVERY} < 8 THEN 1 WHEN {_DELIVERY} = 8 THEN 2 ELSE 3 END AS part FROM events),
        m AS (SELECT max(ts) FILTER (WHERE part = 1) - INTERVAL '1 hour' AS one, max(ts) - INTERVAL '1 hour' AS last FROM p)
        SELECT start, count(*) AS n FROM p, m WHERE NOT (part = 3 AND start + INTERVAL '1 hour' <= one) AND start + INTERVAL '1 hour' <= last GROUP BY start""",
)
def late_counts(spark, sf_dir):
    """Hourly counts of a stream whose last file is late: its rows of windows that the watermark has closed do not count."""
    events, source = table(spark, sf_dir, "events"), shared_folder(spark, "late")
    k = F.col("event_id") % 10
    for part in (events.where(k < 8), events.where(k == 8), events.where(k > 8)):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = follow(spark, source, events.schema, max_files=1).withColumns({"all": F.lit(0), "ts": S.as_instant(F.col("ts"))})
    out = finished(windowed_counts(stream, "ts", "all", "1 hour", "1 hour"), "append")
    return out.select(S.as_written(F.col("window.start")).alias("start"), "n")


@query("progress_watch", "SELECT user_id % 5 AS node, event_type AS kind, max(event_id) AS log_index FROM events GROUP BY ALL")
def progress_watch(spark, sf_dir):
    records = _events_stream(spark, sf_dir).select((F.col("user_id") % 5).alias("node"), F.col("event_type").alias("kind"), F.col("event_id").alias("log_index"))
    return finished(progress(records))
