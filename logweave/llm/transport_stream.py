"""MPEG transport streams as a column.

`encode` wraps bytes into a transport stream with one program: program tables
(PAT, PMT), then packetised elementary stream (PES) packets with presentation
timestamps, clock references and random-access marks.  `decode` parses any such
stream: it reads the program tables, checks continuity counters, reassembles
the elementary packets and returns timestamps with the random-access points.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cluster import releasing, small_batches

PACKET, BODY = 188, 184
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA = 0x06  # stream type of PES packets with private data
PRIVATE_STREAM = 0xBD
PES_HEAD = 14
PES_DATA = 32 * 1024
TICKS = 3600  # of the 90 kHz clock, between two PES packets


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        r = n << 24
        for _ in range(8):
            r = (r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1
        table.append(r & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = (r << 8) & 0xFFFFFFFF ^ _CRC[(r >> 24) ^ b]
    return r


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return data + b"\xff" * (PACKET - len(data))


_TABLES = np.frombuffer(
    _table_packet(PAT_PID, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
    + _table_packet(PMT_PID, _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")),
    dtype=np.uint8,
).reshape(2, PACKET)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1])


def _clock(pts: int) -> bytes:
    return ((pts & 0x1FFFFFFFF) << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream of the payload, which may be empty; every PES packet begins at a random-access point."""
    parts, tables, data_count = [], 0, 0
    body = np.frombuffer(payload, dtype=np.uint8)
    for k in range(max(1, -(-len(payload) // PES_DATA))):
        pts = k * TICKS
        piece = body[k * PES_DATA : (k + 1) * PES_DATA]
        head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(piece) + PES_HEAD - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts)
        total = len(piece) + PES_HEAD
        first = min(total, BODY - 8)
        full, rest = divmod(total - first, BODY)
        n = 1 + full + (rest > 0)
        out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        out[:, 0] = SYNC
        out[:, 1] = DATA_PID >> 8
        out[0, 1] |= 0x40
        out[:, 2] = DATA_PID & 255
        out[:, 3] = 0x10 | (np.arange(data_count, data_count + n) & 15)
        data_count += n
        # the first packet carries the clock and the random-access mark, and stuffing if it is also the last
        out[0, 3] |= 0x20
        out[0, 4] = BODY - 1 - first
        out[0, 5] = 0x50
        out[0, 6:12] = np.frombuffer(_clock(pts), dtype=np.uint8)
        at = PACKET - first
        out[0, at : at + min(PES_HEAD, first)] = np.frombuffer(head, dtype=np.uint8)
        out[0, at + PES_HEAD :] = piece[: first - PES_HEAD]
        done = first - PES_HEAD
        if full:
            out[1 : 1 + full, 4:] = piece[done : done + full * BODY].reshape(full, BODY)
        if rest:
            out[-1, 3] |= 0x20
            out[-1, 4] = BODY - 1 - rest
            if rest < BODY - 1:
                out[-1, 5] = 0
            out[-1, PACKET - rest :] = piece[done + full * BODY :]
        head_packets = _TABLES.copy()
        head_packets[:, 3] |= tables & 15
        tables += 1
        parts += [head_packets, out]
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    stream_type: int
    packets: int = 0
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)  # byte offsets in payload
    access_pts: list[int] = field(default_factory=list)


@dataclass
class Demuxed:
    packets: int = 0
    sync_errors: int = 0
    continuity_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number -> PMT pid
    streams: dict[int, Stream] = field(default_factory=dict)  # elementary pid -> stream


def _sections(rows: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Whole, valid sections of one table pid that begin and end in one packet."""
    found = []
    for packet, at in zip(rows, start, strict=True):
        if not packet[1] & 0x40 or at >= PACKET:
            continue
        raw = packet[at + 1 + packet[at] :].tobytes()
        if len(raw) >= 3:
            size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
            if size <= len(raw) and crc32_mpeg(raw[:size]) == 0:
                found.append(raw[:size])
    return list(dict.fromkeys(found))


def demux(media: bytes) -> Demuxed:
    """Parse a transport stream; damaged packets are counted and skipped, never fatal."""
    out = Demuxed()
    rows = np.frombuffer(media, dtype=np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    out.packets, out.sync_errors = len(rows), int((~good).sum()) + (len(media) % PACKET > 0)
    rows = rows[good]
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    field_there, body_there = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    start = np.minimum(np.where(field_there, 5 + rows[:, 4].astype(np.int32), 4), PACKET)
    for p in np.unique(pid):
        mine = (pid == p) & body_there
        count = rows[mine, 3] & 15
        marked = field_there & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)
        out.continuity_errors += int(((np.diff(count.astype(np.int32)) % 16 != 1) & ~marked[mine][1:]).sum()) if p != 0x1FFF else 0
    for section in _sections(rows[pid == PAT_PID], start[pid == PAT_PID]):
        for at in range(8, len(section) - 4, 4):
            number = int.from_bytes(section[at : at + 2], "big")
            if section[0] == 0 and number:
                out.programs[number] = int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
    for table in dict.fromkeys(out.programs.values()):
        for section in _sections(rows[pid == table], start[pid == table]):
            at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while section[0] == 2 and at + 5 <= len(section) - 4:
                out.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = Stream(section[at])
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)
    column = np.arange(PACKET)
    for p, stream in out.streams.items():
        mine = (pid == p) & body_there
        own, begin = rows[mine], start[mine]
        stream.packets = len(own)
        opens = np.flatnonzero(own[:, 1] & 0x40)
        if not len(opens):
            continue
        access = field_there[mine] & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        joined = own[column >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        edges = [*(ends[opens] - (PACKET - begin[opens])).tolist(), int(ends[-1])]
        pieces, size = [], 0
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            pes = joined[a:b]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out.sync_errors += 1
                continue
            length = int.from_bytes(pes[4:6], "big")
            data = pes[9 + pes[8] : 6 + length if length else None]
            stamp = -1
            if pes[7] & 0x80 and len(pes) >= 14:
                stamp = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
            stream.pts.append(stamp)
            if access[opens[k]]:
                stream.access_points.append(size)
                stream.access_pts.append(stamp)
            pieces.append(data)
            size += len(data)
        stream.payload = b"".join(pieces)
    return out


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of a text with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))


def encode(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add a binary column with the transport stream of each row's zero-padded text.

    Null and empty texts become 64 zero bytes.  Other columns pass through; one
    named like `media` is replaced.  Equal texts give equal streams, a row's
    stream depends on its text alone, and each text is stored whole.
    """
    keep = [f for f in df.schema if f.name != media]
    at = df.columns.index(text)
    places = [df.columns.index(f.name) for f in keep]
    schema = T.StructType([*keep, T.StructField(media, T.BinaryType())])

    def run(batches):
        for batch in batches:
            made = pa.array([mux(padded(t)) for t in batch.column(at).to_pylist()], pa.binary())
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays([*columns, made], [*(f.name for f in keep), media])

    small_batches(df.sparkSession)
    return df.mapInArrow(releasing(run), schema)


DECODED = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("packets", T.IntegerType()),
        T.StructField("sync_errors", T.IntegerType()),
        T.StructField("continuity_errors", T.IntegerType()),
        T.StructField("program", T.IntegerType()),
        T.StructField("program_pid", T.IntegerType()),
        T.StructField("stream_pid", T.IntegerType()),
        T.StructField("stream_type", T.IntegerType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField("access_points", T.ArrayType(T.LongType())),
        T.StructField("access_pts", T.ArrayType(T.LongType())),
    ]
)


def _first_stream(media: bytes | None) -> tuple:
    d = demux(media or b"")
    pid, s = next(iter(sorted(d.streams.items())), (None, Stream(-1)))
    program = min(d.programs, default=None)
    return (s.payload, d.packets, d.sync_errors, d.continuity_errors, program, d.programs.get(program), pid, s.stream_type if pid is not None else None, s.pts, s.access_points, s.access_pts)


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """Parse each stored stream: adds the columns of DECODED for its first elementary stream.

    A null or foreign value gives an empty payload and counted errors instead
    of a failure.  Columns named like those of DECODED are replaced.
    """
    keep = [f for f in df.schema if f.name not in DECODED.fieldNames()]
    at = df.columns.index(media)
    places = [df.columns.index(f.name) for f in keep]
    schema = T.StructType([*keep, *DECODED.fields])
    kinds = [pa.binary(), *[pa.int32()] * 7, *[pa.list_(pa.int64())] * 3]

    def run(batches):
        for batch in batches:
            made = list(zip(*map(_first_stream, batch.column(at).to_pylist()), strict=True)) or [()] * len(kinds)
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(list(v), k) for v, k in zip(made, kinds, strict=True))], schema.fieldNames())

    small_batches(df.sparkSession)
    return df.mapInArrow(releasing(run), schema)
