import hashlib
import os
import time
import zlib

import numpy as np
import pytest
from cases import TEXTS, docs, empty

from tessera.llm.transport import PACKET, PMT_PID, STREAM_PID, mpeg_crc, op1, parsed, read_stream, section, stored, table_packets, tables, write_stream


@pytest.mark.parametrize("size", [64, 128, 176, 184, 192, 4096, 16_384, 16_448, 150_016])
@pytest.mark.parametrize("unit", [64, 192, 16_384, 65_408])
def test_round_trip(size, unit):
    payload = os.urandom(size)
    s = read_stream(write_stream(payload, unit))
    assert s.payloads[STREAM_PID] == payload and s.programs == [1] and s.streams == [(1, STREAM_PID, 6)]
    assert not (s.sync_errors or s.continuity_errors or s.table_errors or s.repeated)
    units = -(-size // unit)
    assert s.stamps[STREAM_PID] == [(k * unit, k * 3600) for k in range(units)] and s.access[STREAM_PID] == [k * unit for k in range(0, units, 4)]


def test_crc_of_the_standard():
    assert mpeg_crc(b"123456789") == 0x0376E6E7


def test_damage_is_counted():
    media = bytearray(write_stream(os.urandom(64_000), 4096))
    lost = media[: PACKET * 40] + media[PACKET * 41 :]
    assert read_stream(bytes(lost)).continuity_errors == 1
    twice = media[: PACKET * 40] + media[PACKET * 39 : PACKET * 40] + media[PACKET * 40 :]
    s = read_stream(bytes(twice))
    assert s.repeated == 1 and s.continuity_errors == 0 and s.payloads == read_stream(bytes(media)).payloads
    media[10] ^= 1  # inside the first table
    assert read_stream(bytes(media)).table_errors == 1
    assert read_stream(b"").packets == 0 and read_stream(b"x" * 300).sync_errors == 2


def test_lost_and_added_bytes():
    """Reading goes on after them: all but the packets that they touch come through."""
    payload = os.urandom(102_400)
    media = write_stream(payload, 4096)
    for at in (PACKET * 50 + 70, PACKET * 50, PACKET * 50 + 187, 3, len(media) - 5):
        for broken in (media[:at] + media[at + 1 :], media[:at] + b"Z" + media[at:], media[:at] + os.urandom(500).replace(b"G", b"g") + media[at:]):
            s = read_stream(broken)
            assert s.sync_errors and len(s.payloads[STREAM_PID]) >= len(payload) - 2 * 4096 - 4 * PACKET
    one = bytearray(media)
    one[PACKET * 50] = 0
    s = read_stream(bytes(one))
    assert s.sync_errors == 1 and len(s.payloads[STREAM_PID]) == len(payload) - (PACKET - 4)


def test_many_breaks_take_time_in_proportion():
    packet = b"\x47\x00\x21" + bytes([0x10]) + b"y" * 184
    media = (packet * 3 + b"lost") * 40_000
    begin = time.monotonic()
    s = read_stream(media)
    assert time.monotonic() - begin < 5 and s.sync_errors >= 39_000


def test_entering_at_a_random_access_point():
    payload = os.urandom(64_000)
    media = write_stream(payload, 4096)
    points = [k for k in range(0, len(media), PACKET) if media[k + 1 : k + 3] == b"\x40\x00"]
    assert len(points) == 4
    for k, at in enumerate(points):
        s = read_stream(media[at:])
        assert s.payloads[STREAM_PID] == payload[k * 4 * 4096 :] and s.access[STREAM_PID][0] == 0 and not (s.table_errors or s.continuity_errors)


def streams_table(number, extra=b""):
    streams = b"".join(bytes([6]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + (0xF000 | len(extra)).to_bytes(2, "big") + extra for k in range(number))
    return section(2, 1, (0xE200).to_bytes(2, "big") + (0xF000).to_bytes(2, "big") + streams)


def test_sections_over_packets_and_streams_without_units():
    pat = table_packets(0, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")), 0)
    long = table_packets(PMT_PID, streams_table(100, b"\x05\x02ab"), 14)
    assert len(long) == 5 * PACKET
    s = read_stream(pat + long)
    assert [x[1] for x in s.streams] == list(range(0x200, 0x200 + 100)) and not s.table_errors and set(s.payloads.values()) == {b""}
    s = read_stream(pat + long[: 2 * PACKET] + long[3 * PACKET :])
    assert s.table_errors == 1 and not s.streams
    repeated = read_stream(pat + long[: 2 * PACKET] + long[PACKET : 2 * PACKET] + long[2 * PACKET :])
    assert len(repeated.streams) == 100 and not repeated.table_errors
    # Two sections, the second from the middle of a packet on, whose pointer says where.
    a, b = streams_table(40), streams_table(60)
    data = a + b
    first = 183
    rest = data[first : first + 183]
    ahead = len(a) - first
    packets = b"\x47" + (0x4000 | PMT_PID).to_bytes(2, "big") + b"\x10\x00" + data[:first] + b"\x47" + (0x4000 | PMT_PID).to_bytes(2, "big") + b"\x11" + bytes([ahead]) + rest
    packets += (b"\x47" + PMT_PID.to_bytes(2, "big") + b"\x12" + data[first + 183 :]).ljust(PACKET, b"\xff")
    s = read_stream(pat + packets)
    assert len(s.streams) == 60 and not s.table_errors
    # Packets of a stream, none of which starts a unit.
    tail = b"".join(b"\x47\x02\x00" + bytes([0x10 | k]) + b"x" * 184 for k in range(5))
    s = read_stream(pat + table_packets(PMT_PID, streams_table(1), 0) + tail)
    assert s.payloads == {0x200: b""} and s.access == {0x200: []}


@pytest.mark.parametrize("seed", range(40))
def test_no_bytes_raise(seed):
    random = np.random.RandomState(seed)
    media = bytearray(write_stream(random.bytes(20_000), 1024))
    for _ in range(random.randint(1, 200)):
        media[random.randint(len(media))] = random.choice([0, 0x47, 255, random.randint(256)])
    if seed % 3 == 0:
        media = media[: random.randint(len(media))]
    read_stream(bytes(media))
    read_stream(random.bytes(5000))
    packets = np.frombuffer(random.bytes(PACKET * 200), np.uint8).reshape(-1, PACKET).copy()
    packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, packets[:, 1] & 0x40, random.choice([0, 1], 200)
    read_stream(tables() + packets.tobytes())


def test_any_damage_of_unit_headers():
    """3,000 streams with flipped bits and bytes in the headers of their units: none raises, all say what is wrong or are whole."""
    random = np.random.RandomState(17)
    whole = read_stream(write_stream(b"\x5a" * 6000, 512))
    clean = np.frombuffer(write_stream(b"\x5a" * 6000, 512), np.uint8).reshape(-1, PACKET)
    heads = [(k, 4 + (row[4] + 1 if row[3] & 0x20 else 0)) for k, row in enumerate(clean) if row[1] & 0x40 and (int(row[1]) & 0x1F) << 8 | int(row[2]) == STREAM_PID]
    assert len(heads) == 12
    short = 0
    for _ in range(3000):
        media = clean.copy()
        for _ in range(random.randint(1, 6)):
            k, at = heads[random.randint(len(heads))]
            spot = at + random.randint(14)
            media[k, spot] = random.choice([int(media[k, spot]) ^ 1 << random.randint(8), 0, random.randint(16), 255])
        s = read_stream(media.tobytes())
        short += s.table_errors > 0
        assert len(s.payloads[STREAM_PID]) <= 6000 + 12 * PACKET and all(0 <= o <= len(s.payloads[STREAM_PID]) for o, _ in s.stamps[STREAM_PID])
    assert short > 1000 and whole.table_errors == 0


def test_declared_length_within_the_header():
    """A unit that declares less than its header needs is counted, whatever the header says."""
    clean = np.frombuffer(write_stream(b"x" * 64), np.uint8).reshape(-1, PACKET)
    k = next(k for k, row in enumerate(clean) if row[1] & 0x40 and (int(row[1]) & 0x1F) << 8 | int(row[2]) == STREAM_PID)
    at = 4 + (clean[k, 4] + 1 if clean[k, 3] & 0x20 else 0)
    for size in range(1, 8):
        media = clean.copy()
        media[k, at + 4 : at + 6] = 0, size
        s = read_stream(media.tobytes())
        assert s.table_errors == 1 and s.payloads[STREAM_PID] == b"" and s.stamps[STREAM_PID] == []


def test_many_programs_take_time_in_proportion():
    """Thousands of program maps, each named once, over a long stream."""
    entries = b"".join((i + 1).to_bytes(2, "big") + (0xE000 | 32 + i).to_bytes(2, "big") for i in range(250))
    pats = b"".join(table_packets(0, section(0, 1, entries[j:] + entries[:j]), 0) for j in range(0, 1000, 4))
    start = time.process_time()
    read_stream(pats + write_stream(b"z" * 3_000_000))
    assert time.process_time() - start < 8


def test_streams_of_any_damage_in_a_table(spark):
    pat = table_packets(0, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")), 0)
    rows = [(1, pat + table_packets(PMT_PID, streams_table(3), 0)), (2, tables()), (3, os.urandom(1000)), (4, write_stream(b"a" * 64)[5:])]
    found = parsed(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r["payload_bytes"] for r in found][:3] == [0, 0, 0] and len(found[0]["streams"]) == 3


def test_awkward_rows(spark):
    found = parsed(stored(docs(spark))).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        data = (r["text"] or "").encode()
        data = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert r["payload_bytes"] == len(data) and r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])
    assert parsed(stored(empty(spark))).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"\x47" * 188)], "doc_id long, media binary")
    assert [r["payload_bytes"] for r in parsed(broken, keep_payload=True).orderBy("doc_id").collect()] == [0, 0, 0]


def test_op1(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for r in op1(spark, sf).collect():
        data = texts[r["doc_id"]].encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest()) and r["media_bytes"] % PACKET == 0
        media = write_stream(padded)
        units = -(-len(padded) // 16_384)
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        stamps = ",".join(f"{k * 3600}@{k * 16_384}" for k in range(units))
        access = ",".join(str(k * 16_384) for k in range(0, units, 4))
        assert r["feature"] == f"packets={len(media) // PACKET};streams=1:256:6;errors=0,0,0,0;pts={stamps};access={access}"
        assert seen.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
