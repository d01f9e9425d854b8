"""Media columns: MPEG transport streams as a column of bytes.

A payload is cut into elementary packets (PES) with time stamps; these go into 188-byte transport packets behind a program
association and a program map table. Reading parses the tables, checks every continuity counter, reassembles the
elementary packets, and lists time stamps and random-access points. Both directions work on whole arrays of packets.

Layout written: PID 0 association, PID 0x1000 map, PID 0x100 payload (private data, stream type 0x06); a PES packet
holds ``PES_BYTES`` of payload and starts with a transport packet that has the random-access flag; its PTS
is its first byte's position at ``RATE`` samples a second on the 90 kHz clock, modulo 2^33. The map table's entry of the payload has a private descriptor
with the payload's length, by which a stream that ends early at an elementary packet's start is told from a whole one.

Defined cases: null and empty texts are a payload of 64 zero bytes; equal payloads give equal streams; a stream with
a lost, repeated or foreign packet, a wrong table CRC or a cut end raises ``ValueError``; null packets (PID 0x1FFF) may stand anywhere and are passed over. Streams of other writers have
no length in their table and are read without that check.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm.common import bounded_batches, fresh

PACKET, SYNC = 188, 0x47
PID_PAT, PID_PMT, PID_DATA, PID_NULL, STREAM_TYPE, STREAM_ID = 0, 0x1000, 0x100, 0x1FFF, 0x06, 0xBD
LENGTH_TAG = 0xA0  # user private descriptor
PES_BYTES = 16 * 1024
RATE, CLOCK = 8000, 90000
ALIGN = 64


def _crc32_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc32_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, with which a section's last four bytes agree."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    p = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return p + b"\xff" * (PACKET - len(p))


_ASSOCIATION = _table_packet(PID_PAT, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PID_PMT)))


@lru_cache(maxsize=4096)
def _tables(size: int) -> bytes:
    """The two table packets of a stream with ``size`` bytes of payload."""
    length = struct.pack(">BBQ", LENGTH_TAG, 8, size)
    body = struct.pack(">HHBHH", 0xE000 | PID_DATA, 0xF000, STREAM_TYPE, 0xE000 | PID_DATA, 0xF000 | len(length)) + length
    return _ASSOCIATION + _table_packet(PID_PMT, _section(2, 1, body))


def _length_in(descriptors: bytes) -> int | None:
    at = 0
    while at + 2 <= len(descriptors):
        tag, size = descriptors[at], descriptors[at + 1]
        if tag == LENGTH_TAG and size == 8:
            return struct.unpack_from(">Q", descriptors, at + 2)[0]
        at += 2 + size
    return None


def _pts_bytes(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | (t >> 30 & 7) << 1, t >> 22 & 0xFF, 1 | (t >> 15 & 0x7F) << 1, t >> 7 & 0xFF, 1 | (t & 0x7F) << 1])


def _pts_of(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    packets = [np.frombuffer(_tables(len(payload)), np.uint8).reshape(-1, PACKET)]
    counter = 0
    for at in range(0, len(payload), PES_BYTES):
        part = payload[at : at + PES_BYTES]
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(part) + 8, 0x80, 0x80, 5) + _pts_bytes(at * CLOCK // RATE) + part
        # the first packet has an adaptation field for its flag; in a short PES it takes what is over
        first = min(len(pes), PACKET - 4 - 2)
        body = pes[first:]
        full, tail = divmod(len(body), PACKET - 4)
        n = 1 + full + bool(tail)
        rows = np.full((n, PACKET), 0xFF, np.uint8)
        rows[:, 0] = SYNC
        rows[:, 1], rows[:, 2] = PID_DATA >> 8, PID_DATA & 0xFF
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | ((counter + np.arange(n)) & 15).astype(np.uint8)
        counter += n
        field = PACKET - 4 - 1 - first  # bytes after the length byte
        rows[0, 3] |= 0x20
        rows[0, 4], rows[0, 5] = field, 0x40
        rows[0, PACKET - first :] = np.frombuffer(pes[:first], np.uint8)
        if full:
            rows[1 : 1 + full, 4:] = np.frombuffer(body[: full * (PACKET - 4)], np.uint8).reshape(full, -1)
        if tail:
            rows[-1, 3] |= 0x20
            rows[-1, 4] = PACKET - 4 - 1 - tail
            if rows[-1, 4]:
                rows[-1, 5] = 0
            rows[-1, PACKET - tail :] = np.frombuffer(body[full * (PACKET - 4) :], np.uint8)
        packets.append(rows)
    return np.concatenate(packets).tobytes()


@dataclass
class Stream:
    payload: bytes
    stamps: list[int]  # PTS of each elementary packet
    points: list[int]  # numbers of the transport packets with the random-access flag
    packets: int


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4]
    size = 3 + (struct.unpack_from(">H", raw, at + 1)[0] & 0xFFF)
    section = raw[at : at + size]
    if section[0] != table_id or section_crc(section):
        raise ValueError("broken program table")
    return section[8:-4]


def demux(stream: bytes) -> Stream:
    """Parse a stream; raises ``ValueError`` for anything that isn't whole."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    used = np.flatnonzero(pid != PID_NULL)
    whole, p, pid = len(p), p[used], pid[used]
    pats = np.flatnonzero(pid == PID_PAT)
    if not len(pats):
        raise ValueError("no association table")
    pmt_pid = struct.unpack(">HH", _read_section(p[pats[0]], 0)[:4])[1] & 0x1FFF
    maps = np.flatnonzero(pid == pmt_pid)
    if not len(maps):
        raise ValueError("no map table")
    body = _read_section(p[maps[0]], 2)
    skip = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
    data_pid, info = (x & 0x1FFF for x in struct.unpack_from(">HH", body, skip + 1))
    length = _length_in(body[skip + 5 : skip + 5 + (info & 0xFFF)])
    own = np.flatnonzero(pid == data_pid)
    if len(own) + len(pats) + len(maps) != len(p):
        raise ValueError("packets of an unknown stream")
    q = p[own]
    counters = q[:, 3] & 15
    if len(q) and ((np.diff(counters.astype(np.int16)) & 15) != 1).any():
        raise ValueError("continuity counter jumps")
    field = (q[:, 3] & 0x20) > 0
    begin = np.where(field, 5 + q[:, 4].astype(np.int32), 4)
    flags = np.where(field & (q[:, 4] > 0), q[:, 5], 0)
    starts = np.flatnonzero(q[:, 1] & 0x40)
    bytes_of = (np.arange(PACKET)[None, :] >= begin[:, None])
    flat, ends = q[bytes_of], np.cumsum(PACKET - begin)
    out, stamps = [], []
    for i, s in enumerate(starts):
        lo = ends[s - 1] if s else 0
        hi = ends[starts[i + 1] - 1] if i + 1 < len(starts) else (ends[-1] if len(ends) else 0)
        pes = flat[lo:hi].tobytes()
        if pes[:3] != b"\0\0\1" or struct.unpack_from(">H", pes, 4)[0] != len(pes) - 6:
            raise ValueError("broken elementary packet")
        stamps.append(_pts_of(pes[9:14]))
        out.append(pes[9 + pes[8] :])
    payload = b"".join(out)
    if length is not None and length != len(payload):
        raise ValueError("cut end")
    return Stream(payload, stamps, used[own[(flags & 0x40) > 0]].tolist(), whole)


def pad(text: str | None) -> tuple[bytes, int]:
    """(payload, unpadded length): UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw)), len(raw)


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a ``media`` column: the transport stream of each text's padded bytes, and ``n_bytes``, its unpadded length."""
    kind = T.StructType([T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())])

    def write(s: pa.Array) -> pa.Array:
        rows = [pad(x) for x in s.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([mux(r) for r, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["media", "n_bytes"])

    return _with(docs, F.arrow_udf(write, kind)(F.col(text)), ["media", "n_bytes"])


def read_media(media: DataFrame) -> DataFrame:
    """``media`` with what is read back from its streams: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    stamps and points (the arrays that seeking needs)."""
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("stamps", pa.list_(pa.int64())), ("points", pa.list_(pa.int64()))]
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, points array<long>"

    def one(m: bytes) -> tuple:
        s = demux(m)
        a = np.frombuffer(s.payload, np.uint8)
        feature = f"packets={s.packets};pes={len(s.stamps)};first_pts={s.stamps[0]};last_pts={s.stamps[-1]};random_access={len(s.points)};sum={int(a.sum(dtype=np.int64))};peak={int(a.max())}"
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(m), hashlib.sha256(m).hexdigest(), feature, s.stamps, s.points

    def read(column: pa.Array) -> pa.Array:
        rows = [one(m) for m in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return _with(media, F.arrow_udf(read, kind)(F.col("media")), [n for n, _ in fields])


def _with(df: DataFrame, value, names: list[str]) -> DataFrame:
    bounded_batches(df.sparkSession)
    (c,) = fresh(df, "v")
    return df.withColumn(c, value).withColumns({n: F.col(c)[n] for n in names}).drop(c)
