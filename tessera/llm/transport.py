"""MPEG transport streams in a binary column: a writer, and a reader that checks and reassembles them.

The writer stores a byte string losslessly as one private elementary stream: packetised units of UNIT bytes with a
timestamp each, every KEY-th a random-access point with a clock reference and the program tables before it, so that a
reader can start there. The reader takes any stream of 188-byte packets: it finds the packets again after lost or added
bytes, joins the sections of the program association and map tables over packets and checks them by their CRC, follows the
continuity counter of every stream, drops repeated packets, joins elementary packets, and lists timestamps and random
access points by byte offset of the payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, map_batches

#: Format constants: packet size, first byte, table and stream identifiers.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x0000, 0x1000, 0x0100, 1, 0x06, 0xBD
#: Stream identifiers of units without an optional header, and of those that hold padding alone.
PLAIN_IDS, PADDING_ID = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE
#: Packet identifiers have 13 bits.
PIDS = 1 << 13
#: Production parameters of op1: payload padding, bytes of a unit, units between random-access points, ticks of a unit.
PAD, UNIT, KEY, TICKS = 64, 16_384, 4, 3600


def mpeg_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + mpeg_crc(head + body).to_bytes(4, "big")


def table_packets(pid: int, data: bytes, counter: int) -> bytes:
    """A section from a packet's start on, over as many packets as it takes."""
    data, room, out = b"\x00" + data, PACKET - 4, []
    for k in range(0, len(data), room):
        head = bytes([SYNC]) + ((0x4000 if k == 0 else 0) | pid).to_bytes(2, "big") + bytes([0x10 | (counter + k // room) % 16])
        out.append((head + data[k : k + room]).ljust(PACKET, b"\xff"))
    return b"".join(out)


def tables(counter: int = 0) -> bytes:
    """The association and the map table; a packet each."""
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    streams = bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big")
    pmt = section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big") + streams)
    return table_packets(PAT_PID, pat, counter) + table_packets(PMT_PID, pmt, counter)


def stamp(prefix: int, ticks: int) -> bytes:
    """A 33-bit timestamp in five bytes."""
    return bytes([prefix << 4 | (ticks >> 30 & 7) << 1 | 1]) + (ticks >> 15 << 1 & 0xFFFE | 1).to_bytes(2, "big") + (ticks << 1 & 0xFFFE | 1).to_bytes(2, "big")


def unit_packets(body: bytes, counter: int, ticks: int, key: bool) -> np.ndarray:
    """One elementary packet as transport packets; the first has the clock reference, a short one is filled up."""
    extra = (bytes([0x50 if key else 0x10]) + (ticks >> 1 & 0xFFFFFFFF).to_bytes(4, "big") + bytes([(ticks & 1) << 7 | 0x7E, 0])) if key else b""
    first = PACKET - 4 - (1 + len(extra) if extra else 0)
    number = 1 + max(0, -(-(len(body) - first) // (PACKET - 4)))
    out = np.full((number, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(number)) % 16
    data = np.frombuffer(body, np.uint8)
    if extra:
        out[0, 3] |= 0x20
        out[0, 4] = len(extra)
        out[0, 5 : 5 + len(extra)] = np.frombuffer(extra, np.uint8)
    whole = min(len(data), first)
    if number > 2:
        out[1:-1, 4:] = data[first : first + (number - 2) * (PACKET - 4)].reshape(-1, PACKET - 4)
    if number > 1:
        out[0, PACKET - first :] = data[:first]
        whole = len(data) - first - (number - 2) * (PACKET - 4)
    spare = (first if number == 1 else PACKET - 4) - whole
    if spare:
        row = out[-1]
        if number == 1 and extra:
            row[4] += spare
        else:
            row[3] |= 0x20
            row[4] = spare - 1
            if spare > 1:
                row[5] = 0
    out[-1, PACKET - whole :] = data[len(data) - whole :]
    return out


def write_stream(payload: bytes, unit: int = UNIT, key: int = KEY, ticks: int = TICKS) -> bytes:
    parts, counter = [], 0
    for k, start in enumerate(range(0, len(payload), unit)):
        body = payload[start : start + unit]
        head = b"\x00\x00\x01" + bytes([STREAM_ID]) + ((8 + len(body)) if len(body) < 65_528 else 0).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(2, k * ticks % 2**33)
        packets = unit_packets(head + body, counter, k * ticks % 2**33, k % key == 0)
        counter += len(packets)
        if k % key == 0:
            parts.append(tables(k // key))
        parts.append(packets.tobytes())
    return b"".join(parts) or tables()


@dataclass
class Stream:
    """What the reader finds: programs and their streams, errors, units of the stored stream."""

    packets: int = 0
    programs: list[int] = field(default_factory=list)
    streams: list[tuple[int, int, int]] = field(default_factory=list)  # program, pid, type
    sync_errors: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    table_errors: int = 0
    payloads: dict[int, bytes] = field(default_factory=dict)
    stamps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # pid: (byte offset, timestamp)
    access: dict[int, list[int]] = field(default_factory=dict)  # pid: byte offsets of random-access points


def sections(rows: np.ndarray, body: np.ndarray, first: np.ndarray, counter: np.ndarray, seen: Stream) -> Iterator[tuple[int, bytes]]:
    """The intact sections of one stream's packets, joined over packets: table and body. Broken ones are counted.

    A packet in which a section starts has the length of what belongs to the section before it. What follows a gap in the
    continuity counter is left out up to the next start; a repeated packet counts once.
    """
    open_, last = b"", None
    for k in range(len(rows)):
        data = rows[k, body[k] :].tobytes()
        if last is not None and counter[k] == last[0] and data == last[1]:
            continue
        whole = last is None or (int(counter[k]) - last[0]) % 16 == 1
        last = int(counter[k]), data
        if not whole and open_:
            seen.table_errors += 1
            open_ = b""
        if first[k]:
            ahead, data = (data[0], data[1:]) if data else (0, b"")
            if ahead > len(data):
                seen.table_errors += 1
                open_ = b""
                continue
            if open_:
                yield from closed(open_ + data[:ahead], seen)
            open_ = data[ahead:]
        elif open_:
            open_ += data
        while len(open_) > 2 and open_[0] != 0xFF and len(open_) >= (size := 3 + (int.from_bytes(open_[1:3], "big") & 0xFFF)):
            yield from closed(open_[:size], seen)
            open_ = open_[size:]
        if open_[:1] == b"\xff":
            open_ = b""
    if open_:
        seen.table_errors += 1


def closed(data: bytes, seen: Stream) -> Iterator[tuple[int, bytes]]:
    """A section's table and body, if it is whole and its CRC holds."""
    size = int.from_bytes(data[1:3], "big") & 0xFFF if len(data) > 2 else 0
    if size < 9 or len(data) != 3 + size or CRC(data):
        seen.table_errors += 1
        return
    yield data[0], data[8 : 3 + size - 4]


def packets_of(media: bytes, seen: Stream) -> np.ndarray:
    """The packets of a stream, a row each; `sync_errors` counts the places where one is not where the last one ends.

    A packet whose successor does not follow, while the one after that does, keeps its place and the successor is left
    out; otherwise bytes were lost or added, the packet itself is left out, and reading goes on at the next place from
    which three packets in a row (or all up to the end) start with the sync byte. A rest without one counts once more.
    """
    data = np.frombuffer(media, np.uint8)
    if not len(data) % PACKET and (data[::PACKET] == SYNC).all():
        return data.reshape(-1, PACKET)
    sync = np.append(data == SYNC, np.ones(3 * PACKET, bool))
    steady = np.flatnonzero(sync[: len(data)] & sync[PACKET : PACKET + len(data)] & sync[2 * PACKET : 2 * PACKET + len(data)])
    parts, at = [], 0
    while at < len(data):
        number, step, whole = 0, 64, False  # packets in a row from here on, looked for in growing steps
        while not whole:
            run = sync[at + number * PACKET : min(len(data), at + (number + step) * PACKET) : PACKET]
            if not run.all():
                number += int(run.argmin())
                break
            number, step, whole = number + len(run), 2 * step, at + (number + len(run)) * PACKET >= len(data)
        cut = at + number * PACKET > len(data)
        if whole and not cut:
            parts.append(data[at:].reshape(-1, PACKET))
            break
        seen.sync_errors += 1
        after = at + number * PACKET
        if cut:  # the last one lacks its end
            parts.append(data[at : after - PACKET].reshape(-1, PACKET))
            break
        if sync[after + PACKET] and after + PACKET < len(data):
            parts.append(data[at:after].reshape(-1, PACKET))
            at = after + PACKET
            continue
        sound = max(0, number - 1) if after < len(data) else number
        parts.append(data[at : at + sound * PACKET].reshape(-1, PACKET))
        begin = at + sound * PACKET + 1
        spot = np.searchsorted(steady, begin)
        if spot == len(steady):
            seen.sync_errors += 1
            break
        at = int(steady[spot])
    return np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8)


_CRC_CACHE: dict[bytes, int] = {}


def CRC(data: bytes) -> int:  # noqa: N802
    """Zero for an intact section. Tables repeat, so that a few results serve a whole batch."""
    if data not in _CRC_CACHE:
        if len(_CRC_CACHE) > 1000:
            _CRC_CACHE.clear()
        _CRC_CACHE[data] = mpeg_crc(data)
    return _CRC_CACHE[data]


def read_stream(media: bytes) -> Stream:
    seen = Stream(packets=len(media) // PACKET)
    rows = packets_of(media, seen)
    good = rows[:, 1] & 0x80 == 0
    seen.sync_errors += int((~good).sum())
    rows = rows[good]
    if not len(rows):
        return seen
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control, counter = rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    extra = np.where(control & 2, rows[:, 4].astype(np.int32) + 1, 0)
    flags = np.where((control & 2 > 0) & (rows[:, 4] > 0), rows[:, 5], 0)
    body = np.minimum(4 + extra, PACKET)
    unit_start, loaded = rows[:, 1] & 0x40 > 0, control & 1 > 0
    maps: dict[int, int] = {}
    kinds: dict[int, int] = {}
    listed: set[tuple[int, int, int]] = set()
    by_pid = np.flatnonzero(loaded)[np.argsort(pid[loaded], kind="stable")]  # in their order within each
    bounds = np.searchsorted(pid[by_pid], np.arange(PIDS + 1))

    def told(own: int, table: int) -> Iterator[bytes]:
        at = by_pid[bounds[own] : bounds[own + 1]]
        return (data for kind, data in sections(rows[at], body[at], unit_start[at], counter[at], seen) if kind == table)

    for data in told(PAT_PID, 0):
        for j in range(0, len(data) - 3, 4):
            if program := int.from_bytes(data[j : j + 2], "big"):
                maps[int.from_bytes(data[j + 2 : j + 4], "big") & 0x1FFF] = program
    for own, program in maps.items():
        for data in told(own, 2):
            j = 4 + (int.from_bytes(data[2:4], "big") & 0xFFF)
            while j + 5 <= len(data):
                kinds[int.from_bytes(data[j + 1 : j + 3], "big") & 0x1FFF] = data[j]
                stream = (program, int.from_bytes(data[j + 1 : j + 3], "big") & 0x1FFF, data[j])
                if stream not in listed:
                    listed.add(stream)
                    seen.streams.append(stream)
                j += 5 + (int.from_bytes(data[j + 3 : j + 5], "big") & 0xFFF)
    seen.programs = sorted(set(maps.values()))
    for own in sorted(kinds):
        at = by_pid[bounds[own] : bounds[own + 1]]
        if len(at) > 1:
            step = (counter[at[1:]].astype(np.int32) - counter[at[:-1]]) % 16
            same = (step == 0) & (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(axis=1)
            jump = (step != 1) & ~same & (flags[at[1:]] & 0x80 == 0)
            seen.repeated += int(same.sum())
            seen.continuity_errors += int(jump.sum())
            at = at[np.concatenate(([True], ~same))]
        join_units(seen, own, rows[at], body[at], unit_start[at], flags[at])
    return seen


def join_units(seen: Stream, own: int, rows: np.ndarray, body: np.ndarray, first: np.ndarray, flags: np.ndarray) -> None:
    """Elementary packets of one stream, joined; what precedes the first whole one is left out.

    A stream without packets, or without the start of a unit, has an empty payload. A unit that does not start as one, or
    whose header reaches beyond it or beyond the length that it declares, is counted and left out.
    """
    inside = np.arange(PACKET)[None, :] >= body[:, None]
    data = rows[inside].tobytes()
    ends = np.concatenate(([0], np.cumsum(PACKET - body)))
    begins = np.flatnonzero(first).tolist()
    parts, stamps, access, offset = [], [], [], 0
    for k, stop in zip(begins, [*begins[1:], len(rows)], strict=False):
        unit = data[ends[k] : ends[stop]]
        plain = len(unit) > 3 and unit[3] in PLAIN_IDS
        head = 6 if plain else 9 + (unit[8] if len(unit) > 8 else 0)
        size = int.from_bytes(unit[4:6], "big")
        unit = unit[: 6 + size] if size else unit
        if unit[:3] != b"\x00\x00\x01" or len(unit) < head:
            seen.table_errors += 1
            continue
        if unit[3] == PADDING_ID:
            continue
        if not plain and unit[7] & 0x80 and head >= 14:
            t = unit[9:14]
            stamps.append((offset, (t[0] >> 1 & 7) << 30 | (t[1] << 8 | t[2]) >> 1 << 15 | (t[3] << 8 | t[4]) >> 1))
        if flags[k] & 0x40:
            access.append(offset)
        parts.append(unit[head:])
        offset += len(parts[-1])
    seen.payloads[own], seen.stamps[own], seen.access[own] = b"".join(parts), stamps, access


def stored(docs: DataFrame, text_col: str = "text", name: str = "media", unit: int = UNIT, pad: int = PAD) -> DataFrame:
    """`docs` with each text's UTF-8 bytes, filled with zeros up to a positive multiple of `pad`, as a transport stream.

    A null text is empty; all other columns stay, and one of the new column's name is replaced.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for part in in_chunks(batches, text_col):
            media = []
            for text in part.column(text_col).to_pylist():
                data = (text or "").encode()
                media.append(write_stream(data.ljust(max(pad, -(-len(data) // pad) * pad), b"\0"), unit))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=schema.names)

    return map_batches(docs, run, schema)


READ = [
    T.StructField("packets", T.LongType()), T.StructField("programs", T.ArrayType(T.IntegerType())),
    T.StructField("streams", T.ArrayType(T.StructType([T.StructField("program", T.IntegerType()), T.StructField("pid", T.IntegerType()), T.StructField("type", T.IntegerType())]))),
    T.StructField("sync_errors", T.LongType()), T.StructField("continuity_errors", T.LongType()), T.StructField("repeated", T.LongType()), T.StructField("table_errors", T.LongType()),
    T.StructField("stamps", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("pts", T.LongType())]))),
    T.StructField("random_access", T.ArrayType(T.LongType())),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
]


def parsed(df: DataFrame, media_col: str = "media", keep_payload: bool = False, tail: int = PAD) -> DataFrame:
    """`df` with what the reader finds in a column of transport streams instead of that column; see READ.

    The payload, timestamps and random-access points are those of the first elementary stream. A null or empty stream has
    zero packets and an empty payload; damage is counted, never raised. Columns of the names in READ are replaced.
    """
    extra = [*READ, *([T.StructField("payload", T.BinaryType())] if keep_payload else [])]
    df = df.drop(*[f.name for f in extra])
    kept = [f for f in df.schema.fields if f.name != media_col]
    schema = T.StructType([*kept, *extra])

    def run(batches):
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("type", pa.int32())])), *[pa.int64()] * 4, pa.list_(pa.struct([("offset", pa.int64()), ("pts", pa.int64())])), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for part in in_chunks(batches, media_col):
            rows = []
            for media in part.column(media_col).to_pylist():
                media = media or b""
                s = read_stream(media)
                own = min(s.payloads, default=None)
                payload = s.payloads.get(own, b"")
                rows.append((
                    s.packets, s.programs, [dict(zip(("program", "pid", "type"), x, strict=True)) for x in s.streams], s.sync_errors, s.continuity_errors, s.repeated, s.table_errors,
                    [{"offset": a, "pts": b} for a, b in s.stamps.get(own, [])], s.access.get(own, []),
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(media), hashlib.sha256(media).hexdigest(), payload,
                ))
            columns = list(zip(*rows, strict=True))[: len(extra)]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=schema.names)

    return map_batches(df, run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = parsed(stored(docs).drop("text"))
    streams = F.array_join(F.transform("streams", lambda s: F.concat_ws(":", s["program"].cast("string"), s["pid"].cast("string"), s["type"].cast("string"))), ",")
    points = F.array_join(F.transform("random_access", lambda o: o.cast("string")), ",")
    stamps = F.array_join(F.transform("stamps", lambda s: F.concat_ws("@", s["pts"].cast("string"), s["offset"].cast("string"))), ",")
    errors = [F.col(c).cast("string") for c in ("sync_errors", "continuity_errors", "repeated", "table_errors")]
    feature = F.concat_ws(";", F.concat(F.lit("packets="), F.col("packets").cast("string")), F.concat(F.lit("streams="), streams), F.concat(F.lit("errors="), F.concat_ws(",", *errors)), F.concat(F.lit("pts="), stamps), F.concat(F.lit("access="), points))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
