"""State from logs: key-value tables, replicated-log replay, cluster metadata, quorums and memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import initial_leader, kv_tokens
from ..plans.prefix import previous, running


def parse_kv(lines: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """Add op, key and value of `SET k v`, `GET k` and `DELETE k`; op is null for anything else.

    Further tokens are ignored, or make the line invalid if `strict`.
    """
    t = kv_tokens(F.col(line))
    op = F.upper(F.get(t, F.lit(0)))
    need = F.when(op == "SET", 3).when(op.isin("GET", "DELETE"), 2)
    ok = (F.size(t) == need) if strict else (F.size(t) >= need)
    return lines.withColumns({"op": F.when(ok, op), "key": F.when(ok, F.get(t, F.lit(1))), "value": F.when(ok & (op == "SET"), F.get(t, F.lit(2)))})


def materialize(commands: DataFrame, order: str = "seq") -> DataFrame:
    """Last write of each key; keys whose last command is DELETE, or sets an empty value, are gone."""
    writes = commands.where(F.col("op").isin("SET", "DELETE"))
    last = writes.groupBy("key").agg(F.max_by(F.struct("op", "value"), order).alias("last"))
    return last.where((F.col("last.op") == "SET") & (F.coalesce("last.value", F.lit("")) != "")).select("key", F.col("last.value").alias("value"))


def with_snapshot(snapshot: DataFrame, commands: DataFrame, upto: int, order: str = "seq") -> DataFrame:
    """Table from a snapshot (key, value) taken at position `upto` and the commands after it."""
    base = snapshot.select(F.lit("SET").alias("op"), "key", "value", F.lit(upto).cast("bigint").alias(order))
    return materialize(base.unionByName(commands.where(F.col(order) > upto).select("op", "key", "value", order)), order)


def replay(records: DataFrame) -> DataFrame:
    """Log entries that survive a replay of (pos, kind, log_index): kinds entry, purge, truncate, others ignored.

    Purge removes entries up to its index, truncate those from its index on, and
    a later entry replaces an earlier one of its index.  One running pass from
    the end of the log gives each entry the strongest later purge and truncate.
    """
    turned = records.withColumn("__back", -F.col("pos")).withColumn("__all", F.lit(0))
    i = F.col("log_index")
    later = running(turned, ["__all"], "__back", {"__purge": ("max", F.when(F.col("kind") == "purge", i)), "__cut": ("min", F.when(F.col("kind") == "truncate", i))}, exclusive=True)
    last = later.where("kind = 'entry'").groupBy("log_index").agg(F.max_by(F.struct("__purge", "__cut", "pos"), "pos").alias("e"))
    alive = (F.col("e.__purge").isNull() | (F.col("e.__purge") < i)) & (F.col("e.__cut").isNull() | (F.col("e.__cut") > i))
    return last.where(alive).select(F.col("log_index").alias("idx"), F.col("e.pos").alias("pos"))


def log_state(records: DataFrame) -> DataFrame:
    """Last purged and last log index; an emptied log ends where it was purged."""
    purged = records.where("kind = 'purge'").agg(F.max("log_index").alias("last_purged"))
    last = replay(records).agg(F.max("idx").alias("last"))
    return purged.crossJoin(last).select("last_purged", F.coalesce("last", "last_purged").alias("last_log"))


def topic_states(commands: DataFrame, nodes: int, base: DataFrame | None = None) -> DataFrame:
    """State of each topic after its commands (log_index, kind, topic, sealed_count) create and rollover.

    Only the first create counts, and rollovers before it fail.  Leaders take
    turns from the topic's first one.  `base` is an earlier state to go on from.
    """
    made = commands.where("kind = 'create'").groupBy("topic").agg(F.min("log_index").alias("__since"))
    if base is not None:
        # a topic of the base is known before any command
        made = made.unionByName(base.select("topic", F.lit(-(2**62)).cast("bigint").alias("__since"))).groupBy("topic").agg(F.min("__since").alias("__since"))
    rolled = commands.where("kind = 'rollover'").join(made, "topic").where("log_index > __since")
    sums = rolled.groupBy("topic").agg(F.count("*").alias("n"), F.sum("sealed_count").alias("sealed"))
    out = made.join(sums, "topic", "left")
    if base is None:
        out = out.withColumns({"b_segment": F.lit(1), "b_sealed": F.lit(0), "b_leader": F.lit(None).cast("bigint")})
    else:
        out = out.join(base.select("topic", F.col("current_segment").alias("b_segment"), F.col("last_sealed").alias("b_sealed"), F.col("leader").alias("b_leader")), "topic", "left")
    n = F.coalesce("n", F.lit(0))
    first = F.coalesce(F.col("b_leader") - 1, initial_leader(F.col("topic"), nodes))
    return out.select("topic", (n + F.coalesce("b_segment", F.lit(1))).cast("bigint").alias("current_segment"), (F.coalesce("sealed", F.lit(0)) + F.coalesce("b_sealed", F.lit(0))).cast("bigint").alias("last_sealed"), (F.pmod(first + n, F.lit(nodes)) + 1).cast("bigint").alias("leader"))


_STATE = "topic string, current_segment bigint, last_sealed bigint, leader bigint"


def snapshot_states(states: DataFrame) -> DataFrame:
    """The cluster's metadata as text, one row a topic: what a snapshot file holds."""
    return states.select(F.to_json(F.struct(*states.columns)).alias("state"))


def restore_states(snapshot: DataFrame) -> DataFrame:
    """The metadata that a snapshot says; rows that are no state are left out."""
    return snapshot.select(F.from_json("state", _STATE).alias("s")).where("s.topic IS NOT NULL").select("s.*")


def apply_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Committed entries (log_index, kind, data) applied in the order of their index.

    Kinds are blank, normal (a key-value command) and membership (node ids by
    comma); an index that comes again is applied once.  Returns the key-value
    table, and one row with last_applied, membership_index and membership; the
    later of two memberships counts.
    """
    once = entries.groupBy("log_index").agg(F.min(F.struct("kind", "data")).alias("e")).select("log_index", "e.kind", "e.data")
    commands = parse_kv(once.where("kind = 'normal'").select(F.col("log_index").alias("seq"), F.col("data").alias("line")))
    latest = F.max(F.when(F.col("kind") == "membership", F.struct("log_index", "data")))
    state = once.agg(F.max("log_index").alias("last_applied"), latest.alias("m")).select("last_applied", F.col("m.log_index").alias("membership_index"), F.array_sort(F.split("m.data", ",").cast("array<bigint>")).alias("membership"))
    return materialize(commands), state


def command_results(commands: DataFrame) -> DataFrame:
    """Reply to each metadata command: CREATED, EXISTS, ROLLED, NODE, or ERR for a rollover of an unknown topic."""
    first = commands.where("kind = 'create'").groupBy("topic").agg(F.min("log_index").alias("__since"))
    at = F.col("log_index")
    known = commands.join(first, "topic", "left")
    reply = (
        F.when(F.col("kind") == "upsert_node", "NODE")
        .when(F.col("kind") == "create", F.when(at == F.col("__since"), "CREATED").otherwise("EXISTS"))
        .when(F.col("__since").isNotNull() & (at > F.col("__since")), "ROLLED")
        .otherwise("ERR")
    )
    return known.withColumn("reply", reply).drop("__since")


def quorum(progress: DataFrame, group: str, matched: str = "matched") -> DataFrame:
    """Greatest position that a majority of each group's voters has reached.  A group is one set of voters, so small."""
    sorted_ = F.sort_array(F.collect_list(matched), asc=False)
    return progress.groupBy(group).agg(F.element_at(sorted_, (F.floor(F.count(matched) / 2) + 1).cast("int")).alias("committed"))


def joint_quorum(progress: DataFrame, group: str, config: str, matched: str = "matched") -> DataFrame:
    """The same under several voter sets at once: every one of them must agree."""
    each = progress.groupBy(group, config).agg(F.element_at(F.sort_array(F.collect_list(matched), asc=False), (F.floor(F.count(matched) / 2) + 1).cast("int")).alias("c"))
    return each.groupBy(group).agg(F.min("c").alias("committed"))


def committed_by_leader(accepted: Column, accepted_term: Column, current_term: Column, committed: Column) -> Column:
    """A leader only commits what it proposed itself; anything else waits."""
    return F.when((accepted_term == current_term) & (accepted > F.coalesce(committed, F.lit(-1))), accepted).otherwise(committed)


def leader_runs(entries: DataFrame, index: str, leader: str) -> DataFrame:
    """First entry of each leader's run, and the last entry of the log: what a compressed id list keeps."""
    rows = entries.select(F.col(index).alias("idx"), F.col(leader).alias("leader")).withColumn("__all", F.lit(0))
    before = previous(rows, ["__all"], "idx", {"__leader": "leader"})
    end = rows.agg(F.max("idx").alias("__end"))
    starts = F.col("__leader").isNull() | (F.col("__leader") != F.col("leader"))
    return before.crossJoin(F.broadcast(end)).where(starts | (F.col("idx") == F.col("__end"))).select("leader", "idx")


def conflicts(leader: DataFrame, follower: DataFrame, key: str) -> DataFrame:
    """First index of each follower whose term differs from the leader's: truncate there, then append."""
    joined = follower.alias("f").join(leader.alias("l"), [key, "log_index"])
    return joined.where("f.term <> l.term").groupBy(key).agg(F.min("log_index").alias("conflict"))


def consecutive(appends: DataFrame, follower: DataFrame, key: str) -> DataFrame:
    """Verdict on append requests (key, prev_index, prev_term) by the follower's log (key, log_index, term).

    A request goes on from the entry before it.  If the follower has no such
    entry, or one of another term, the request is rejected and the log cut from
    that index on; a request without a previous entry begins the log.  Adds
    accepted, local_term (null if missing) and truncate_from (null if accepted).
    """
    mine = follower.select(F.col(key).alias("__key"), F.col("log_index").alias("__index"), F.col("term").alias("local_term"))
    joined = appends.join(mine, (F.col(key) == F.col("__key")) & (F.col("prev_index") == F.col("__index")), "left").drop("__key", "__index")
    accepted = F.col("prev_index").isNull() | F.coalesce(F.col("local_term") == F.col("prev_term"), F.lit(False))
    return joined.withColumn("accepted", accepted).withColumn("truncate_from", F.when(~F.col("accepted"), F.col("prev_index")))


def vote_granted(lease_live: Column, candidate_last: Column, my_last: Column, vote: Column, my_vote: Column) -> Column:
    return ~lease_live & (candidate_last >= my_last) & (vote >= my_vote)


def caught_up(last_log: Column, matched: Column, lag: int = 5000) -> Column:
    return last_log - F.coalesce(matched, F.lit(0)) <= lag


def purge_upto(snapshot: Column, purged: Column, keep: int = 1000, batch: int = 1) -> Column:
    """Index to purge to after a snapshot, null if it is not worth it yet."""
    end = snapshot + 1 - keep
    return F.when(end >= F.coalesce(purged, F.lit(-1)) + 1 + batch, end - 1)


def purge_requested(index: Column, snapshot: Column) -> Column:
    """A manual purge goes no further than the snapshot, and does nothing without one."""
    return F.when(snapshot.isNotNull(), F.least(index, snapshot))


def snapshots_taken(applied: Column, every: int = 5000) -> Column:
    return F.floor(applied / every).cast("bigint")


def read_index(noop: Column, committed: Column) -> Column:
    """Position a linearizable read must wait for: the leader's own first entry or what is committed, if later."""
    return F.greatest(noop, F.coalesce(committed, noop))


def invalid_voters(voters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Voters (config, node) without an address; a membership is valid only if there are none."""
    return voters.join(nodes.select("node"), "node", "left_anti")


def membership_errors(memberships: DataFrame) -> DataFrame:
    """Add `error` to memberships (configs: arrays of node ids, nodes: map of node id to address); null if valid.

    No config may be empty, there must be one, and every voter needs a node.
    """
    lonely = F.array_except(F.flatten("configs"), F.map_keys("nodes"))
    error = F.when(F.size("configs") == 0, "no config").when(F.exists("configs", lambda c: F.size(c) == 0), "empty config").when(F.size(lonely) > 0, "voter without a node")
    return memberships.withColumn("error", error)


def voter_ids(configs: Column) -> Column:
    """Voters of a membership: all nodes of its configs, joint ones too."""
    return F.array_sort(F.array_distinct(F.flatten(configs)))


def learner_ids(configs: Column, nodes: Column) -> Column:
    """Nodes that are no voters."""
    return F.array_sort(F.array_except(F.map_keys(nodes), F.flatten(configs)))


_METRICS = (
    "id bigint, current_term bigint, vote struct<term:bigint,node_id:bigint,committed:boolean>, last_log_index bigint, last_applied struct<term:bigint,index:bigint>, snapshot struct<term:bigint,index:bigint>, purged struct<term:bigint,index:bigint>, "
    "state string, current_leader bigint, millis_since_quorum_ack bigint, membership struct<configs:array<array<bigint>>,nodes:map<string,string>>, heartbeat map<string,bigint>, replication map<string,struct<term:bigint,index:bigint>>"
)


def metrics_record(line: Column) -> Column:
    """A node's metrics from their JSON text; what a text does not say is null.  Maps are keyed by node id as text."""
    return F.from_json(line, _METRICS)


_ENVELOPE = "type string, id bigint, payload struct<kind:string,term:bigint,node:bigint,data:string>, error string"


def envelope(line: Column) -> Column:
    """A call between nodes from its JSON text: type (request, response, one_way), id, payload and error; null if it is none.

    Only requests and responses have an id, and only responses an error.
    """
    e = F.from_json(line, _ENVELOPE)
    kind = F.lower(e["type"])
    known = kind.isin("request", "response") & e["id"].isNotNull() | (kind == "one_way")
    fields = (kind.alias("type"), F.when(kind != "one_way", e["id"]).alias("id"), e["payload"].alias("payload"), F.when(kind == "response", e["error"]).alias("error"))
    return F.when(known, F.struct(*fields))


def joint_step(current: Column, target: Column) -> Column:
    """Configs of the next membership: straight to the target if it is one of the current ones, else both."""
    return F.when(F.array_contains(current, target), F.array(target)).otherwise(F.array(F.element_at(current, -1), target))


def change_members(voters: Column, kind: Column, ids: Column) -> Column:
    """Voters after add, remove or replace."""
    new = F.when(kind == "add", F.array_union(voters, ids)).when(kind == "remove", F.array_except(voters, ids)).when(kind == "replace", F.array_distinct(ids)).otherwise(voters)
    return F.array_sort(new)


_CHANGE = "struct<voters:array<bigint>,nodes:map<bigint,string>,error:string>"


def _merged(left: Column, right: Column) -> Column:
    """Entries of both maps; those of the right one win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def _only(nodes: Column, ids: Column, inside: bool) -> Column:
    return F.map_filter(nodes, lambda k, _: F.array_contains(ids, k) if inside else ~F.array_contains(ids, k))


def changed_membership(voters: Column, nodes: Column, changes: Column) -> Column:
    """Struct (voters, nodes, error) after an array of changes (kind, ids, nodes), made in their order.

    Kinds: add_voter_ids (of nodes that are there), add_voters (with their
    nodes, which do not replace known ones), remove_voters (they stay as
    learners), replace_voters, add_nodes (known ones stay), set_nodes (known ones
    are replaced), remove_nodes, replace_nodes.  The first change that leaves a
    voter without a node, or no voter, or is of another kind, stops with an error
    and the state before it.
    """
    empty = F.create_map().cast("map<bigint,string>")

    def step(state: Column, change: Column) -> Column:
        v, n, kind = state["voters"], state["nodes"], change["kind"]
        ids = F.coalesce(change["ids"].cast("array<bigint>"), F.array().cast("array<bigint>"))
        given = F.coalesce(change["nodes"], empty)
        names = F.map_keys(given)
        new_voters = (
            F.when(kind == "add_voter_ids", F.array_union(v, ids))
            .when(kind == "add_voters", F.array_union(v, names))
            .when(kind == "remove_voters", F.array_except(v, ids))
            .when(kind == "replace_voters", F.array_distinct(ids))
            .otherwise(v)
        )
        new_nodes = (
            F.when(kind.isin("add_voters", "add_nodes"), _merged(given, n))
            .when(kind == "set_nodes", _merged(n, given))
            .when(kind == "remove_nodes", _only(n, ids, False))
            .when(kind == "replace_nodes", given)
            .otherwise(n)
        )
        known = F.coalesce(kind.isin("add_voter_ids", "add_voters", "remove_voters", "replace_voters", "add_nodes", "set_nodes", "remove_nodes", "replace_nodes"), F.lit(False))
        error = F.when(~known, "unknown change").when(F.size(new_voters) == 0, "no voter left").when(F.size(F.array_except(new_voters, F.map_keys(new_nodes))) > 0, "voter without a node")
        ok = F.struct(F.array_sort(new_voters).alias("voters"), new_nodes.alias("nodes"), F.lit(None).cast("string").alias("error")).cast(_CHANGE)
        bad = F.struct(v.alias("voters"), n.alias("nodes"), error.alias("error")).cast(_CHANGE)
        return F.when(state["error"].isNotNull(), state).when(error.isNotNull(), bad).otherwise(ok)

    start = F.struct(F.array_sort(voters.cast("array<bigint>")).alias("voters"), F.coalesce(nodes, empty).alias("nodes"), F.lit(None).cast("string").alias("error")).cast(_CHANGE)
    return F.aggregate(changes, start, step)


def first_time(samples: DataFrame, keys: list[str], ts: str, predicate: Column) -> DataFrame:
    """When a metric predicate first held for each key."""
    return samples.where(predicate).groupBy(*keys).agg(F.min(ts).alias("first_ts"))
