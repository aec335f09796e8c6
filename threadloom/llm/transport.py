"""Operator 8: media columns as MPEG transport streams.

A payload is stored in a stream of 188-byte packets: elementary packets (PES) with presentation
timestamps, one elementary stream, random access points at a fixed distance. A program association
table and a program map table stand before each random access point, whose first packet carries
the clock reference, so that a reader can join there. Reading parses the tables (with their
checksums), follows each packet identifier's continuity counter, reassembles the elementary
packets, and returns payload, timestamps, clock references and random-access points. Transport
format: ISO/IEC 13818-1.

Cases: null or empty text is a payload of 64 zero bytes; equal texts give equal streams; a stream
with lost, damaged or repeated packets is read as far as it goes and counted in ``errors``; bytes
without a program have an empty payload; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.packing import spark_schema
from threadloom.llm.work import Scratch, column, slices, table, texts

# Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, PROGRAM, STREAM_ID, PRIVATE_DATA, CLOCK = 0, 1, 0xBD, 0x06, 90_000
# Choices of this writer.
PMT_PID, DATA_PID = 0x100, 0x101
UNIT, PER_SECOND, KEY_EVERY, PAD = 8192, 25, 8, 64


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The tables' checksum; 0 over a section together with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | 9 + len(body)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


_PAT, _PMT = (_table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))), _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")))


def _tables(times: int) -> bytes:
    """Both tables' packets with their continuity counter after so many times."""
    return b"".join(x[:3] + bytes([0x10 | times & 15]) + x[4:] for x in (_PAT, _PMT))


def write_stream(payload: bytes) -> bytes:
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], k * CLOCK // PER_SECOND & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        if k % KEY_EVERY == 0:
            out.append(_tables(k // KEY_EVERY))
        done = 0
        while done < len(pes):
            field = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if done == 0 and k % KEY_EVERY == 0 else b""  # random access and clock reference
            room = PACKET - 4 - (1 + len(field) if field else 0)
            chunk = pes[done : done + room]
            stuffing = room - len(chunk)
            if stuffing and not field:
                stuffing -= 1  # the field's length is a byte itself
                field = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            elif field:
                field = bytes([len(field) + stuffing]) + field + b"\xff" * stuffing
            out.append(bytes([SYNC]) + ((0x4000 if done == 0 else 0) | DATA_PID).to_bytes(2, "big") + bytes([(0x30 if field else 0x10) | counter]) + field + chunk)
            done += len(chunk)
            counter = counter + 1 & 15
    return b"".join(out) or _tables(0)


class Media(NamedTuple):
    payload: bytes
    pts: list[int]
    random_access: list[int]  # places in the payload
    packets: int
    errors: int
    pcr: list[int]  # clock references, in units of the timestamps


def _sections(body: bytes) -> Iterator[bytes]:
    """The whole sections after a pointer field whose checksum holds."""
    at = 1 + body[0] if body else 0
    while at + 3 <= len(body) and body[at] != 0xFF:
        n = 3 + (int.from_bytes(body[at + 1 : at + 3], "big") & 0xFFF)
        if at + n <= len(body) and n >= 12 and not section_crc(body[at : at + n]):
            yield body[at : at + n]
        at += n


def read_stream(data: bytes) -> Media:
    maps: set[int] = set()
    wanted: int | None = None
    clock: int | None = None
    pcr: list[int] = []
    counters: dict[int, int] = {}
    previous: dict[int, bytes] = {}
    units: list[tuple[bool, list[bytes]]] = []
    errors, packets = len(data) % PACKET > 0, 0
    for at in range(0, len(data) - PACKET + 1, PACKET):
        packet = data[at : at + PACKET]
        packets += 1
        if packet[0] != SYNC or packet[1] & 0x80:
            errors += 1
            continue
        pid, control, counter = (packet[1] & 0x1F) << 8 | packet[2], packet[3] >> 4 & 3, packet[3] & 15
        if control & 1:
            if pid in counters and counter != counters[pid] + 1 & 15:
                if packet == previous[pid]:  # a packet may be sent twice
                    continue
                errors += 1
            counters[pid], previous[pid] = counter, packet
        begin, key = 4, False
        if control & 2:
            begin, key = 5 + packet[4], packet[4] > 0 and bool(packet[5] & 0x40)
            if packet[4] >= 7 and packet[5] & 0x10 and pid == clock:
                pcr.append(int.from_bytes(packet[6:12], "big") >> 15)
        if not control & 1 or begin >= PACKET:
            continue
        if pid == wanted:
            if packet[1] & 0x40:
                units.append((key, []))
            if units:
                units[-1][1].append(packet[begin:])
        elif pid == PAT_PID or pid in maps:
            if packet[1] & 0x40:
                found = list(_sections(packet[begin:]))
                errors += not found
                for s in found:
                    if pid == PAT_PID and s[0] == 0:
                        maps |= {int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF for k in range(8, len(s) - 4, 4) if s[k : k + 2] != b"\0\0"}
                    elif pid in maps and s[0] == 2:
                        clock = int.from_bytes(s[8:10], "big") & 0x1FFF
                        k = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                        while k + 5 <= len(s) - 4 and wanted is None:
                            if s[k] == PRIVATE_DATA:
                                wanted = int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF
                            k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)
    payload, pts, access, held = [], [], [], 0
    for key, parts in units:
        pes = b"".join(parts)
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            errors += 1
            continue
        n, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        errors += bool(n) and len(pes) != 6 + n
        body = pes[head : 6 + n if n else None]
        if pes[7] & 0x80 and head >= 14:
            pts.append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1)
        if key:
            access.append(held)
        payload.append(body)
        held += len(body)
    return Media(b"".join(payload), pts, access, packets, int(errors), pcr)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def padded(data: bytes) -> bytes:
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")


def to_media(docs: DataFrame) -> DataFrame:
    """Per document its text's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [x.encode() for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([write_stream(padded(x)) for x in raw], pa.binary())], schema=STORED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, spark_schema(STORED))


def features(media: DataFrame, times: bool = False) -> DataFrame:
    """Per stored stream what its packets hold; ``times`` adds timestamps, random-access places and clock references."""
    schema = READ
    for name in ("pts", "random_access", "pcr") if times else ():
        schema = schema.append(pa.field(name, pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, n, data in zip(*(column(batch, x).to_pylist() for x in STORED.names), strict=True):
                m = read_stream(data)
                said = f"packets={m.packets};units={len(m.pts)};pts={m.pts[0] if m.pts else -1}-{m.pts[-1] if m.pts else -1};random_access={len(m.random_access)};errors={m.errors}"
                rows.append((doc, n, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), said, *([m.pts, m.random_access, m.pcr] if times else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.mapInArrow(run, spark_schema(READ) + (", pts array<bigint>, random_access array<bigint>, pcr array<bigint>" if times else ""))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark).save(to_media(table(spark, sf_dir, "documents")), "media")
    return features(stored, times=True)
