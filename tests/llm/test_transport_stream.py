import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import transport_stream as ts


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=1200) | st.integers(32_000, 33_500).map(bytes) | st.integers(65_300, 66_000).map(lambda n: b"\x47" * n))
def test_round_trip(payload):
    media = ts.mux(payload)
    got = ts.demux(media)
    stream = got.streams[ts.DATA_PID]
    assert len(media) % ts.PACKET == 0 and all(media[i] == ts.SYNC for i in range(0, len(media), ts.PACKET))
    assert stream.payload == payload and (got.sync_errors, got.continuity_errors) == (0, 0)
    assert got.programs == {1: ts.PMT_PID} and stream.stream_type == ts.PRIVATE_DATA
    n = max(1, -(-len(payload) // ts.PES_DATA))
    assert stream.pts == [k * ts.TICKS for k in range(n)] == stream.access_pts and stream.access_points == [k * ts.PES_DATA for k in range(n)]


class Bits:
    """Fields of a byte string, most significant bit first."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at // 8] >> (7 - self.at % 8) & 1
            self.at += 1
        return value

    def rest(self):
        assert self.at % 8 == 0
        return self.data[self.at // 8 :]


def plain_parse(media):
    """A transport stream read field by field in the order that the standard lists them, one packet after another."""
    programs, kinds, units, last, broken = {}, {}, {}, {}, 0
    for at in range(0, len(media), 188):
        packet = Bits(media[at : at + 188])
        assert packet.take(8) == 0x47
        _, unit_start, _, pid, _, control, counter = (packet.take(n) for n in (1, 1, 1, 13, 2, 2, 4))
        access = False
        if control & 2:
            length = packet.take(8)
            flags = [packet.take(1) for _ in range(8)] if length else [0] * 8
            access = bool(flags[1])
            packet.at += 8 * max(0, length - 1)
        if not control & 1:
            continue
        if pid in last and (last[pid] + 1) % 16 != counter:
            broken += 1
        last[pid] = counter
        body = packet.rest()
        if pid == 0 or pid in programs.values():
            section = Bits(body[1 + body[0] :])
            table, _, length = section.take(8), section.take(4), section.take(12)
            section.at += 5 * 8
            end = (3 + length - 4) * 8
            if pid == 0:
                while section.at < end:
                    number, _, value = section.take(16), section.take(3), section.take(13)
                    programs[number] = value
            else:
                assert table == 2
                section.at += 16 + 4
                info = section.take(12)
                section.at += 8 * info
                while section.at < end:
                    kind, _, value, _, info = section.take(8), section.take(3), section.take(13), section.take(4), section.take(12)
                    kinds[value] = kind
                    section.at += 8 * info
        elif unit_start:
            units.setdefault(pid, []).append([access, bytearray(body)])
        elif pid in units:
            units[pid][-1][1] += body
    streams = {}
    for pid, kind in kinds.items():
        payload, stamps, points = b"", [], []
        for access, pes in units.get(pid, []):
            head = Bits(bytes(pes))
            assert head.take(24) == 1
            head.take(8)
            length = head.take(16)
            head.at += 8
            has_stamp = head.take(1)
            head.at += 7
            size = head.take(8)
            stamp = -1
            if has_stamp:
                head.at += 4
                stamp = head.take(3)
                head.at += 1
                stamp = stamp << 15 | head.take(15)
                head.at += 1
                stamp = stamp << 15 | head.take(15)
            if access:
                points.append(len(payload))
            stamps.append(stamp)
            payload += bytes(pes[9 + size : 6 + length] if length else pes[9 + size :])
        streams[pid] = (kind, payload, stamps, points)
    return programs, streams, broken


@pytest.mark.parametrize("size", [0, 1, 160, 161, 162, 163, 164, 5000, 32_768, 32_769, 100_001])
def test_streams_read_the_same_field_by_field(size):
    payload = random.Random(size).randbytes(size)
    programs, streams, broken = plain_parse(ts.mux(payload))
    got = ts.demux(ts.mux(payload))
    assert programs == got.programs and broken == 0
    for pid, (kind, body, stamps, points) in streams.items():
        s = got.streams[pid]
        assert (s.stream_type, s.payload, s.pts, s.access_points) == (kind, body, stamps, points)
    assert streams[ts.DATA_PID][1] == payload


def foreign_stream():
    """A stream as another multiplexer writes it: two programs, two elementary streams with descriptors, null packets, an adaptation field alone."""

    def packet(pid, start, counter, body, field=None):
        head = bytes([0x47, start << 6 | pid >> 8, pid & 255])
        if field is None and len(body) == 184:
            return head + bytes([0x10 | counter]) + body
        room = 183 - len(body)
        field = (field or b"") + b"\xff" * (room - len(field or b"")) if field else (b"" if room == 0 else b"\x00" + b"\xff" * (room - 1))
        return head + bytes([0x30 | counter, room]) + field + body

    def table(pid, table_id, number, body):
        section = bytes([table_id, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + b"\xc1\0\0" + body
        section += ts.crc32_mpeg(section).to_bytes(4, "big")
        return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section + b"\xff" * (183 - len(section))

    def unit(kind, stamp, data, known):
        flags = b"\x80\x80\x05" + ts._stamp(stamp) if stamp is not None else b"\x80\0\0"
        return b"\0\0\1" + bytes([kind]) + ((len(flags) + len(data)) if known else 0).to_bytes(2, "big") + flags + data

    rng = random.Random(5)
    video, sound = rng.randbytes(700), rng.randbytes(300)
    out = [table(0, 0, 9, b"\0\0\xe0\x10" + b"\0\x07\xe1\x00" + b"\0\x08\xe1\x20"), table(0x100, 2, 7, b"\xe2\x01\xf0\x03\x0e\x01\x00" + b"\x1b\xe2\x01\xf0\x02\x0a\x00" + b"\x0f\xe2\x02\xf0\x00"), table(0x120, 2, 8, b"\xff\xff\xf0\x00")]
    out.append(packet(0x1FFF, 0, 0, b"\xff" * 184))
    counters = {0x201: 14, 0x202: 3}
    for pid, pes in ((0x201, unit(0xE0, 2**32 + 77, video[:400], False)), (0x202, unit(0xC0, 90_000, sound, True)), (0x201, unit(0xE0, None, video[400:], False))):
        first = True
        while pes:
            body, pes = pes[:170], pes[170:]
            out.append(packet(pid, first, counters[pid], body, b"\x40" if first else None))
            counters[pid] = (counters[pid] + 1) % 16
            first = False
        out.append(bytes([0x47, pid >> 8, pid & 255, 0x20 | (counters[pid] - 1) % 16, 183, 0]) + b"\xff" * 182)
    return b"".join(out), video, sound


def test_a_stream_of_another_multiplexer():
    media, video, sound = foreign_stream()
    assert len(media) % 188 == 0
    programs, streams, broken = plain_parse(media)
    got = ts.demux(media)
    assert broken == got.continuity_errors == 0 and got.sync_errors == 0
    assert got.programs == {7: 0x100, 8: 0x120} and set(got.streams) == {0x201, 0x202} == set(streams)
    for pid, (kind, body, stamps, points) in streams.items():
        s = got.streams[pid]
        assert (s.stream_type, s.payload, s.pts, s.access_points) == (kind, body, stamps, points)
    assert got.streams[0x201].payload == video and got.streams[0x201].pts == [2**32 + 77, -1] and got.streams[0x201].access_points == [0, 400]
    assert got.streams[0x202].payload == sound and got.streams[0x202].stream_type == 0x0F


def test_lost_and_damaged_packets_are_counted():
    media = ts.mux(bytes(5000))
    packets = [bytearray(media[i : i + ts.PACKET]) for i in range(0, len(media), ts.PACKET)]
    lost = b"".join(bytes(p) for k, p in enumerate(packets) if k != 10)
    assert ts.demux(lost).continuity_errors == 1
    packets[10][0] = 0
    got = ts.demux(b"".join(map(bytes, packets)))
    assert got.sync_errors == 1 and got.continuity_errors == 1 and len(got.streams[ts.DATA_PID].payload) == 5000 - 184
    for junk in (b"", b"x", bytes(376), random.Random(0).randbytes(188 * 7)):
        assert ts.demux(junk).streams == {}


def test_large_time_stamps():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7
    for pts in (0, 1, 2**15, 2**30 + 5, 2**33 - 1):
        b = ts._stamp(pts)
        assert (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1 == pts and b[0] & b[2] & b[4] & 1


def test_columns_and_query(spark, tmp_path):
    from logweave.llm.queries import QUERIES

    texts = {1: "abc", 2: None, 3: "", 4: "é" * 40_000, 5: "abc", 6: "x" * 64, 7: "\0\0", None: "n"}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id bigint, text string, media string").repartition(3)
    read = ts.decode(ts.encode(df)).collect()
    assert {r.doc_id: bytes(r.payload) for r in read} == {i: ts.padded(t) for i, t in texts.items()}
    assert ts.decode(spark.createDataFrame([(None,), (bytearray(b"junk"),)], "media binary")).count() == 2
    assert ts.encode(df.limit(0)).collect() == []
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_transport_stream"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        payload, media, r = ts.padded(t), ts.mux(ts.padded(t)), got[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len((t or "").encode()), len(payload), len(media))
        assert (r.payload_sha256, r.media_sha256, r.tail_crc32) == (sha256(payload).hexdigest(), sha256(media).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1].feature == got[5].feature and "errors=0" in got[4].feature and "pes=3" in got[4].feature
