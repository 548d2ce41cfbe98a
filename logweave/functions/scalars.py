"""Scalar functions of the log engine as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BLOCK_BYTES, HEADER_BYTES, MAX_FRAME_BYTES

# Fixed values of FNV-1a, 64 bits: offset basis and prime.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fnv_step(h: Column, byte: Column) -> Column:
    """One round on signed 64-bit integers without overflow: the prime is 2**40 + 435."""
    x = h.bitwiseXOR(byte)
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    product = low * F.lit(435)
    upper = high * F.lit(435) + F.shiftrightunsigned(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
    return F.shiftleft(upper, 32).bitwiseOR(product.bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a(data: Column) -> Column:
    """Signed FNV-1a 64 of a string's or binary's bytes, inside the JVM; meant for short values such as names."""
    code = F.hex(data.cast("binary"))
    count = F.octet_length(data.cast("binary"))
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(data.isNotNull(), F.aggregate(octets, F.lit(_signed(FNV_BASIS)), _fnv_step))


def _fnv_batch(values: pd.Series) -> pd.Series:
    raw = [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint8)
    begin = np.cumsum(sizes[order]) - sizes[order]
    h = np.full(len(raw), FNV_BASIS, dtype=np.uint64)
    longest = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    for k in range(longest):
        n = alive[k]
        h[:n] = (h[:n] ^ data[begin[:n] + k]) * np.uint64(FNV_PRIME)
    out = np.empty(len(raw), dtype=np.int64)
    out[order] = h.view(np.int64)
    return pd.Series(out, index=values.index)


def fnv1a_vector(data: Column) -> Column:
    """The same for payloads of any length: one numpy step for each byte place of an Arrow batch; null counts as empty."""

    def run(values: pd.Series) -> pd.Series:
        return _fnv_batch(values)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.LongType())(data)


def unsigned_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, as written."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp as written; halves are rounded away from zero, as in SQL's epoch_ms."""
    us = micros(ts)
    return F.call_function("div", us + F.when(us < 0, F.lit(-500)).otherwise(F.lit(500)), F.lit(1000))


def as_instant(ts: Column) -> Column:
    """A timestamp as written, read as UTC: watermarks need one with a zone."""
    return F.timestamp_micros(micros(ts))


def as_written(ts: Column) -> Column:
    """The other way round."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def footprint(payload_len: Column) -> Column:
    return payload_len + F.lit(HEADER_BYTES)


def allocation(need: Column, unit: int = BLOCK_BYTES) -> Column:
    """Bytes of the block that an entry of `need` bytes gets when a new one is opened."""
    return F.expr("bigint(0)") + F.ceil(need / F.lit(unit)).cast("bigint") * F.lit(unit)


def sanitize_namespace(key: Column) -> Column:
    """Directory of a namespace key: every character but ASCII letters, digits, - _ . becomes _; keys with nothing left are hashed."""
    cleaned = F.regexp_replace(key, "[^A-Za-z0-9._-]", "_")
    return F.when(cleaned.rlike("^_*$"), F.concat(F.lit("ns_"), unsigned_hex(fnv1a(key)))).otherwise(cleaned)


def wal_key(topic: Column, segment: Column) -> Column:
    return F.concat(F.lit("t_"), topic, F.lit("_s_"), segment.cast("string"))


def parse_wal_key(key: Column) -> tuple[Column, Column]:
    """Topic and segment of a log key, split at its last `_s_`; nulls if it is none."""
    pattern = r"(?s)^t_(.*)_s_\+?(\d+)$"
    ok = key.rlike(pattern)
    return F.when(ok, F.regexp_extract(key, pattern, 1)), F.when(ok, F.try_to_number(F.regexp_extract(key, pattern, 2), F.lit("9" * 19)).cast("bigint"))


def frame(text: Column) -> Column:
    """A line as a frame: its byte length as little-endian 32 bits, then the bytes."""
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0")
    turned = F.concat(*(F.substring(size, 7 - 2 * k, 2) for k in range(4)))
    return F.concat(F.unhex(turned), text.cast("binary"))


def frame_length(data: Column) -> Column:
    code = F.hex(F.substring(data, 1, 4))
    return F.conv(F.concat(*(F.substring(code, 7 - 2 * k, 2) for k in range(4))), 16, 10).cast("bigint")


def frame_ok(data: Column) -> Column:
    """Whether a frame's length is allowed and its body complete."""
    n = frame_length(data)
    return (n > 0) & (n <= MAX_FRAME_BYTES) & (F.octet_length(data) - 4 >= n)


def split_command(line: Column) -> Column:
    """Verb, topic and payload of a protocol line: at most three parts, inner spaces of the payload kept."""
    return F.split(F.regexp_replace(line, r"\s+$", ""), " ", 3)


def response(kind: Column, message: Column) -> Column:
    """Response line: OK, OK message, EMPTY, ERR message."""
    return F.when(kind == "empty", F.lit("EMPTY")).when(kind == "err", F.concat(F.lit("ERR "), message)).when(message.isNull() | (message == ""), F.lit("OK")).otherwise(F.concat(F.lit("OK "), message))


def parse_response(line: Column) -> Column:
    """Struct kind (ok, empty, err, unknown) and message of a response line."""
    kind = F.when(line == "EMPTY", "empty").when((line == "OK") | line.startswith("OK "), "ok").when(line.startswith("ERR "), "err").otherwise("unknown")
    message = F.when(line.startswith("OK "), F.expr("1")).when(line.startswith("ERR "), F.expr("2"))
    body = F.when(message == 1, F.substring(line, 4, 1 << 30)).when(message == 2, F.substring(line, 5, 1 << 30))
    return F.struct(kind.alias("kind"), body.alias("message"))


def lossy_text(data: Column) -> Column:
    """UTF-8 text of bytes, each invalid part replaced by U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def initial_leader(topic: Column, nodes: int) -> Column:
    """0-based index of the first leader among the sorted nodes.

    The hash is FNV-1a, a stable public function, in place of a hash whose
    values are no documented contract.
    """
    return F.pmod(fnv1a(topic), F.lit(nodes)).cast("bigint")


def instance_key(base: Column) -> Column:
    return F.concat(base, F.lit("_"), unsigned_hex(fnv1a(base)))


def duration_seconds(text: Column) -> Column:
    """Seconds of `30s`, `2m`, `1h` or a bare number; null otherwise."""
    pattern = r"^\s*(\d{1,15})([smh]?)\s*$"
    n = F.try_to_number(F.regexp_extract(text, pattern, 1), F.lit("9" * 18)).cast("bigint")
    unit = F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), n * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1))


def fsync_mode(text: Column) -> Column:
    """Milliseconds of a flush schedule: 0 for every write, -1 for never, 1000 for `async`; null if unknown."""
    low = F.lower(F.trim(text))
    number = F.try_to_number(F.regexp_extract(low, r"^(\d{1,15})(?:ms)?$", 1), F.lit("9" * 18)).cast("bigint")
    return F.when(low == "sync-each", 0).when(low.isin("no-fsync", "none"), -1).when(low == "async", 1000).when(low.rlike(r"^\d{1,15}(ms)?$"), number).cast("bigint")


def short_number(value: Column) -> Column:
    """1234567 as 1.2M, 3400 as 3.4K, 12 as 12."""
    return F.when(value >= 1e6, F.format_string("%.1fM", value / 1e6)).when(value >= 1e3, F.format_string("%.1fK", value / 1e3)).otherwise(F.format_string("%.0f", value.cast("double")))


def bandwidth(value: Column) -> Column:
    return F.when(value >= 1e9, F.format_string("%.1fGB/s", value / 1e9)).when(value >= 1e6, F.format_string("%.1fMB/s", value / 1e6)).when(value >= 1e3, F.format_string("%.1fKB/s", value / 1e3)).otherwise(F.format_string("%.0fB/s", value.cast("double")))


def peer_id(port: Column) -> Column:
    """Last digit of a peer's port; null for 0, which names no peer."""
    return F.nullif(F.pmod(port, F.lit(10)), F.lit(0))


def kv_tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda t: t != "")


def payload_ids(data: Column) -> Column:
    """Topic index (first byte) and chunk index (next eight bytes, big-endian) at the head of a payload."""
    whole = F.octet_length(data) >= 9
    return F.struct(F.when(whole, F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("bigint")).alias("topic_index"), F.when(whole, F.conv(F.hex(F.substring(data, 2, 8)), 16, 10).cast("decimal(20,0)")).alias("chunk_index"))


def histogram_bucket(value: Column) -> Column:
    """Bucket of a non-negative integer in a histogram with four buckets an octave, exact below 8."""
    v = value.cast("bigint")
    bits = F.length(F.bin(v))
    octave = bits - 3
    return F.when(v < 4, v).otherwise(4 + 4 * octave + F.call_function("shiftright", v, octave).bitwiseAND(F.lit(3))).cast("bigint")


def bucket_minimum(bucket: Column) -> Column:
    """Smallest value of a histogram bucket."""
    octave = F.floor((bucket - 4) / 4).cast("int")
    return F.when(bucket < 4, bucket).otherwise(F.call_function("shiftleft", (4 + F.pmod(bucket, F.lit(4))).cast("bigint"), octave)).cast("bigint")
