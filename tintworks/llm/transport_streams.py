"""Media columns: payloads in MPEG transport streams, written and read back.

`mux` wraps a payload into packetised elementary units with presentation times,
cut into 188-byte packets, with program tables and a random-access mark before
every `RAP_EVERY`th unit.  `demux` parses any such stream: program association and
map tables (with their checksums), continuity counters, elementary units with
their times and random-access points.

Edge cases: a null or empty text is the empty payload, padded to one block; equal
texts give equal streams; packets without the sync byte are counted and skipped;
a damaged section or unit is reported in `errors`, and the rest is still read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, given
from .textkernel import utf8_views

PACKET, BODY, SYNC = 188, 184, 0x47
BLOCK = 64
UNIT = 32768
RAP_EVERY = 4
TICKS = 3600  # of the 90 kHz clock for each unit
PMT_PID, MEDIA_PID, PROGRAM = 0x100, 0x101, 1
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program sections (not reflected, all ones at the start)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _time(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | (ticks >> 30 & 7) << 1 | 1, ticks >> 22 & 0xFF, (ticks >> 15 & 0x7F) << 1 | 1, ticks >> 7 & 0xFF, (ticks & 0x7F) << 1 | 1])


def _adaptation(size: int, random_access: bool, clock: int) -> bytes:
    """An adaptation field of exactly `size` bytes, its length byte included."""
    if size == 1:
        return b"\x00"
    flags, rest = 0, b""
    if random_access:
        flags, rest = 0x50, ((clock & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")
    return (bytes([size - 1, flags]) + rest).ljust(size, b"\xff")


def pad(payload: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return payload.ljust(max(BLOCK, -(-len(payload) // BLOCK) * BLOCK), b"\x00")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds `payload` as one private-data elementary stream."""
    out, counter, tables = [], 0, 0
    for number, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        piece = payload[at : at + UNIT]
        rap, ticks = number % RAP_EVERY == 0, number * TICKS % (1 << 33)
        if rap:
            out += [_table_packet(0, tables, PAT), _table_packet(PMT_PID, tables, PMT)]
            tables += 1
        unit = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(piece) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(2, ticks) + piece
        room = BODY - 8 * rap
        field_ = _adaptation(8 * rap + max(0, room - len(unit)), rap, ticks) if rap or len(unit) < room else b""
        head = bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, (0x30 if field_ else 0x10) | counter & 15])
        out.append(head + field_ + unit[:room])
        counter += 1
        rest = unit[room:]
        full = len(rest) // BODY
        if full:
            block = np.empty((full, PACKET), dtype=np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
            block[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
            block[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=full * BODY).reshape(full, BODY)
            out.append(block.tobytes())
            counter += full
        if last := rest[full * BODY :]:
            out.append(bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0x30 | counter & 15]) + _adaptation(BODY - len(last), False, 0) + last)
            counter += 1
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    packet: int
    data: bytes


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    continuity_errors: int = 0
    errors: list[str] = field(default_factory=list)


def _sections(payload: np.ndarray, first: np.ndarray, sizes: np.ndarray):
    """Program sections from the payloads of a table's packets."""
    ends = np.cumsum(sizes)
    data = payload.tobytes()
    for k, (end, size) in enumerate(zip(ends, sizes)):
        if first[k]:
            at = int(end - size)
            at += 1 + data[at]
            while at + 3 <= len(data) and data[at] != 0xFF:
                length = 3 + ((data[at + 1] & 15) << 8 | data[at + 2])
                yield data[at : at + length]
                at += length
                if at >= end:
                    break


def _read_time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(stream: bytes) -> Stream:
    out = Stream()
    if len(stream) % PACKET:
        out.errors.append(f"{len(stream) % PACKET} bytes after the last whole packet")
    rows = np.frombuffer(stream, dtype=np.uint8, count=len(stream) // PACKET * PACKET).reshape(-1, PACKET)
    good = rows[:, 0] == SYNC
    if not good.all():
        out.errors.append(f"{int((~good).sum())} packets without sync")
        rows = rows[good]
    out.packets = len(rows)
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts_unit, has_field, has_body = rows[:, 1] & 0x40 > 0, rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    begin = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    begin = np.minimum(np.where(has_body, begin, PACKET), PACKET)
    flagged = has_field & (rows[:, 4] > 0)
    random_access, jump = flagged & (rows[:, 5] & 0x40 > 0), flagged & (rows[:, 5] & 0x80 > 0)
    bodies: dict[int, tuple] = {}

    def body(pid: int):
        at = np.flatnonzero((pids == pid) & has_body)
        if len(at) > 1:
            step = np.diff(rows[at, 3].astype(np.int16) & 15) & 15
            out.continuity_errors += int(((step != 1) & ~jump[at[1:]]).sum())
            if (step == 0).any():  # a repeated packet carries nothing new
                at = at[np.concatenate([[True], step != 0])]
        mask = np.arange(PACKET)[None, :] >= begin[at][:, None]
        return at, rows[at][mask], PACKET - begin[at]

    at, payload, sizes = body(0)
    for s in _sections(payload, starts_unit[at], sizes):
        if section_crc(s):
            out.errors.append("program association checksum")
            continue
        for k in range(8, len(s) - 4, 4):
            if number := s[k] << 8 | s[k + 1]:
                out.programs[number] = (s[k + 2] & 0x1F) << 8 | s[k + 3]
    for pid in sorted(set(out.programs.values())):
        at, payload, sizes = body(pid)
        for s in _sections(payload, starts_unit[at], sizes):
            if section_crc(s):
                out.errors.append("program map checksum")
                continue
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                out.streams[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for pid in sorted(out.streams):
        at, payload, sizes = body(pid)
        ends = np.cumsum(sizes)
        opens = np.flatnonzero(starts_unit[at])
        data = payload.tobytes()
        for k, first in enumerate(opens):
            lo = int(ends[first] - sizes[first])
            hi = int(ends[opens[k + 1] - 1]) if k + 1 < len(opens) else len(data)
            unit = data[lo:hi]
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                out.errors.append(f"unit {k} of {pid} has no start code")
                continue
            length = unit[4] << 8 | unit[5]
            if length and length + 6 > len(unit):
                out.errors.append(f"unit {k} of {pid} is short of {length + 6 - len(unit)} bytes")
            flags = unit[7] >> 6
            if len(unit) < 9 + 5 * (flags >> 1) + 5 * (flags == 3):
                out.errors.append(f"unit {k} of {pid} ends within its times")
                continue
            pts = _read_time(unit[9:14]) if flags & 2 else None
            dts = _read_time(unit[14:19]) if flags == 3 else pts
            out.units.append(Unit(pid, unit[3], pts, dts, bool(random_access[at[first]]), int(at[first]), unit[9 + unit[8] : length + 6 if length else len(unit)]))
    return out


def to_media(text: Column) -> Column:
    """The transport stream of each whole text's padded bytes."""

    @F.arrow_udf("binary")
    def kernel(column: pa.Array) -> pa.Array:
        return pa.array([mux(pad(v.tobytes())) for v in utf8_views(column)], pa.binary())

    return kernel.asNondeterministic()(text)


_READ = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string,pts:array<bigint>,access_points:array<bigint>,continuity_errors:bigint>"


def read_media(media: Column) -> Column:
    """What stored streams hold: payload digests, unit times, the byte offsets of random-access packets."""

    @F.arrow_udf(_READ)
    def kernel(column: pa.Array) -> pa.Array:
        rows = []
        for v in utf8_views(column):
            s = demux(v.tobytes())
            payload = b"".join(u.data for u in s.units)
            pts = [u.pts for u in s.units if u.pts is not None]
            points = [u.packet * PACKET for u in s.units if u.random_access]
            feature = f"programs={len(s.programs)};streams={len(s.streams)};packets={s.packets};units={len(s.units)};pts={min(pts, default='')}-{max(pts, default='')};access={len(points)};continuity={s.continuity_errors};errors={len(s.errors)}"
            rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "feature": feature, "pts": pts, "access_points": points, "continuity_errors": s.continuity_errors})
        fields = [pa.field(n, t) for n, t in (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("access_points", pa.list_(pa.int64())), ("continuity_errors", pa.int64()))]
        return pa.array(rows, pa.struct(fields))

    return kernel.asNondeterministic()(media)


def store_media(docs: DataFrame, *, text: str = "text", media: str = "media") -> DataFrame:
    """`docs` with a binary column `media` (a column of that name is replaced)."""
    return docs.select(given(docs, media).alias("given"), to_media(column(text)).alias(media)).select("given.*", column(media))
