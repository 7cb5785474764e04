"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` writes a payload as 188-byte packets: a program association table, a
program map table (both with CRC-32/MPEG), then one elementary stream of
private data (stream type 0x06) in PES packets of at most ``PES_BYTES``,
each with a presentation timestamp; the first packet of every
``RAP_EVERY``-th PES packet sets the random access flag and carries a clock
reference; the last packet of a PES packet is stuffed by an adaptation
field. ``demux`` finds the program by its tables, checks sync bytes,
continuity counters, table CRCs and PES lengths, reassembles the elementary
stream and lists timestamps and random-access points.

The query stores the streams in a table in the shared folder and computes
everything from the bytes it reads back.

Cases: null counts as an empty text; the payload is padded with zero bytes
to a positive multiple of 64; equal texts give equal streams; repeated rows
and null doc_ids keep their rows; extra columns are ignored; an empty table
stays empty. Lost, repeated or damaged packets are counted, not fatal; what
a gap leaves incomplete is dropped and counted.
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

from . import kernels as K
from .staging import Staged, bounded

PACKET, ROOM = 188, 184
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
PES_BYTES = 32 * 1024
PES_HEAD = 14
RAP_EVERY = 8
TICKS = 3600  # of the 90 kHz clock between PES packets
PAD = 64
OUT_BYTES = 16 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + b"\x06" + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
)


def _pts(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def _pcr(t: int) -> bytes:
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def _pes(part: bytes, number: int, counter: int) -> tuple[bytes, int]:
    """The packets of one PES packet and the next continuity counter."""
    t = number * TICKS & (1 << 33) - 1
    data = b"\0\0\1\xbd" + (len(part) + PES_HEAD - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(t) + part
    first = b"\x50" + _pcr(t) if number % RAP_EVERY == 0 else b""
    room = ROOM - len(first) - bool(first)
    n = 1 + max(0, -(-(len(data) - room) // ROOM))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = 0x47
    out[:, 1], out[:, 2] = ES_PID >> 8, ES_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    raw = np.frombuffer(data, np.uint8)
    whole = max(0, n - 2)
    if whole:
        out[1 : n - 1, 4:] = raw[room : room + whole * ROOM].reshape(whole, ROOM)
    ends = [(0, 0, min(room, len(data)), first)] + ([(n - 1, room + whole * ROOM, len(data), b"")] if n > 1 else [])
    for at, lo, hi, extra in ends:
        have = hi - lo
        if extra or have < ROOM:
            out[at, 3] |= 0x20
            out[at, 4] = ROOM - 1 - have
            if ROOM - 1 - have:
                fields = extra or b"\0"
                out[at, 5 : 5 + len(fields)] = np.frombuffer(fields, np.uint8)
        out[at, PACKET - have :] = raw[lo:hi]
    return out.tobytes(), counter + n & 15


def mux(payload: bytes) -> bytes:
    out, counter = [_TABLES], 0
    for i in range(0, max(1, len(payload)), PES_BYTES):
        packets, counter = _pes(payload[i : i + PES_BYTES], i // PES_BYTES, counter)
        out.append(packets)
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    pes: int = 0
    pts: list[int] = field(default_factory=list)
    access: list[tuple[int, int]] = field(default_factory=list)  # (packet, timestamp)
    lost: int = 0  # breaks of a continuity counter
    bad: int = 0  # packets or tables that do not parse
    dropped: int = 0  # PES packets left incomplete


def _read_section(body: bytes, table: int) -> bytes | None:
    """What a section holds between its header and CRC."""
    at = 1 + body[0]
    if len(body) < at + 3 or body[at] != table:
        return None
    end = at + 3 + ((body[at + 1] & 0x0F) << 8 | body[at + 2])
    if end > len(body) or end < at + 12 or crc_mpeg(body[at:end]) != 0:
        return None
    return body[at + 8 : end - 4]


def demux(media: bytes) -> Stream:
    """Reassembles the first elementary stream of the first program."""
    s, n = Stream(packets=len(media) // PACKET), len(media) // PACKET
    s.bad += len(media) % PACKET != 0
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (p[:, 0] == 0x47) & (p[:, 1] < 0x80)
    s.bad += int(n - good.sum())
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    skip = np.where(control & 2, p[:, 4].astype(np.int64) + 1, 0)
    good &= (control > 0) & (skip <= ROOM)
    lo = 4 + np.minimum(skip, ROOM)

    def table(wanted: int, number: int) -> bytes | None:
        for i in np.flatnonzero(good & (pid == wanted) & (p[:, 1] & 0x40 > 0)).tolist():
            if (body := _read_section(p[i, lo[i] :].tobytes(), number)) is not None:
                return body
            s.bad += 1
        return None

    pat = table(0, 0) or b""
    s.programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(pat) - 3, 4)}
    s.programs.pop(0, None)
    for x in sorted(s.programs):
        if (body := table(s.programs[x], 2)) is not None:
            i = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while i + 5 <= len(body):
                s.streams[int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF] = body[i]
                i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0x0FFF)
            break
    if not s.streams:
        return s
    mine = np.flatnonzero(good & (pid == next(iter(s.streams))) & (control & 1 > 0))
    count = p[mine, 3] & 15
    same = np.zeros(len(mine), bool)
    if len(mine) > 1:  # a packet may be sent twice
        same[1:] = (count[1:] == count[:-1]) & (p[mine[1:]] == p[mine[:-1]]).all(axis=1)
    mine, count = mine[~same], count[~same]
    gap = np.zeros(len(mine), bool)
    gap[1:] = (count[1:].astype(int) - count[:-1]) % 16 != 1
    s.lost = int(gap.sum())
    start = np.flatnonzero(p[mine, 1] & 0x40)
    out = []
    for k, i in enumerate(start.tolist()):
        j = int(start[k + 1]) if k + 1 < len(start) else len(mine)
        own = mine[i:j]
        parts = [p[x, lo[x] :] for x in (own[0], own[-1])[: len(own)]]
        if len(own) > 2 and (skip[own[1:-1]] == 0).all():
            parts.insert(1, p[own[1:-1], 4:].reshape(-1))
        elif len(own) > 2:
            parts[1:1] = [p[x, lo[x] :] for x in own[1:-1]]
        data = np.concatenate(parts).tobytes()
        if len(data) < 9 or data[:3] != b"\0\0\1":
            s.bad += 1
            continue
        size = int.from_bytes(data[4:6], "big")
        if gap[i + 1 : j].any() or size and len(data) < size + 6:
            s.dropped += 1
            continue
        s.pes += 1
        if data[7] & 0x80:
            t = data[9:14]
            s.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        if skip[own[0]] > 1 and p[own[0], 5] & 0x40:
            s.access.append((int(own[0]), s.pts[-1] if s.pts else -1))
        out.append(data[9 + data[8] : size + 6 if size else None])
    s.payload = b"".join(out)
    return s


def feature(s: Stream) -> str:
    return f"packets={s.packets};programs={len(s.programs)};types={','.join(f'{x:02x}' for x in s.streams.values())};pes={s.pes};rap={len(s.access)};first_pts={s.pts[0] if s.pts else ''};last_pts={s.pts[-1] if s.pts else ''};lost={s.lost};bad={s.bad};dropped={s.dropped}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD or (PAD if not raw else 0))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in K.slices(batch.column(1)):
            raw = [buf[s:e].tobytes() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, media in zip(*batch.columns):
            media = media.as_py()
            s = demux(media)
            times = sorted({t for _, t in s.access})
            rows.append((doc.as_py(), n.as_py(), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [x for x, _ in s.access], times))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)], [x.split()[0] for x in _COLUMNS.split(", ")])


_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_packets array<long>, access_pts array<long>"


def store_streams(docs: DataFrame) -> Staged:
    """doc_id, n_bytes and the transport stream of each text, as a table in the shared folder."""
    bounded(docs.sparkSession)
    return Staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "streams")


def read_streams(media: DataFrame) -> DataFrame:
    """What the stored streams hold, from their bytes; timestamps and random-access points as lists."""
    bounded(media.sparkSession)
    return media.mapInArrow(_read, _COLUMNS)


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_streams(store_streams(spark.read.parquet(f"{sf_dir}/documents.parquet")).df())


QUERIES = {"op7_transport_stream": op7_transport_stream}
ORACLE: dict[str, str] = {}  # byte formats are not SQL; tests/llm/test_op7.py has round trips
