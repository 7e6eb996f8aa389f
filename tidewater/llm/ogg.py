"""Media columns: Ogg pages written and read.

Reading verifies every page's checksum, resumes at the next capture pattern after damage, sorts pages to
logical streams by serial number, joins packets from lacing values across pages, and derives times from granule positions.
Each file is one row and is handled alone; a task holds one batch of rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, real_id, texts

HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Samples are single bytes at this rate; a packet holds FRAME of them.
RATE, FRAME, UNIT = 8000, 4800, 192
SAMPLES, INDEX = 1, 2  # serial numbers of the two logical streams of a document
HEADER = b"samples\0"

_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, most significant bit first, no inversion), from zlib's by mirroring bits."""
    mirrored = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_FLIP), "little")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: (data, granule position at its end). A packet may run over many pages."""
    lacing, body, ends = bytearray(), bytearray(), []  # ends: (lacing values up to a packet's end, granule)
    for data, granule in packets:
        lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        body += data
        ends.append((len(lacing), granule))
    pages, at, byte, k = [], 0, 0, 0
    while at < len(lacing) or not pages:
        stop = min(len(lacing), at + 255)
        flags = (CONTINUED if at and lacing[at - 1] == 255 else 0) | (0 if pages else FIRST) | (LAST if stop == len(lacing) else 0)
        granule = -1
        while k < len(ends) and ends[k][0] <= stop:
            granule, k = ends[k][1], k + 1
        size = sum(lacing[at:stop])
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing[at:stop]), bytes(body[byte : byte + size])))
        at, byte = stop, byte + size
    return pages


def interleave(*streams: list[bytes]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    rest = [s[1:] for s in streams]
    return b"".join([s[0] for s in streams] + [s[i] for i in range(max(map(len, rest), default=0)) for s in rest if i < len(s)])


@dataclass
class Stream:
    serial: int
    pages: int = 0
    last: int = -1  # granule position
    ended: bool = False
    lost: int = 0
    packets: list[tuple[bytes, int]] = field(default_factory=list)
    _open: list[bytes] | None = None
    _next: int = 0


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """(streams by serial number, pages whose checksum or length is wrong). A packet has -1 for a granule position unless it is the last to end on its page.

    Damaged pages are left out; a packet that lost a part is dropped and counted in its stream's `lost`.
    """
    streams: dict[int, Stream] = {}
    bad, at = 0, data.find(b"OggS")
    while at >= 0:
        ok = at + 27 <= len(data)
        if ok:
            _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            ok = version == 0 and len(lacing) == n and end <= len(data) and checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
        if not ok:
            bad += 1
            at = data.find(b"OggS", at + 1)
            continue
        s = streams.setdefault(serial, Stream(serial))
        gap = number != s._next
        if s._open is not None and (gap or not flags & CONTINUED):
            s.lost, s._open = s.lost + 1, None
        skip = bool(flags & CONTINUED) and s._open is None  # the rest of a packet whose start is lost
        part, byte, done = s._open or [], at + 27 + n, []
        start = byte
        for i, size in enumerate(lacing):
            byte += size
            if size < 255:
                part.append(data[start:byte])
                if skip:
                    skip = False
                else:
                    done.append(b"".join(part))
                part, start = [], byte
        if lacing and lacing[-1] == 255:
            part.append(data[start:byte])
            s._open = None if skip else part
        else:
            s._open = None
        s.packets += [(p, granule if i == len(done) - 1 else -1) for i, p in enumerate(done)]
        s.pages, s.last, s.ended, s._next = s.pages + 1, granule if granule >= 0 else s.last, s.ended or bool(flags & LAST), number + 1
        at = data.find(b"OggS", end)
    for s in streams.values():
        if s._open is not None:
            s.lost, s._open = s.lost + 1, None
    return streams, bad


def store(payload: bytes) -> bytes:
    """A payload as 8-bit samples in the stream SAMPLES, with its length and checksum in the stream INDEX."""
    frames = [(payload[i : i + FRAME], min(len(payload), i + FRAME)) for i in range(0, len(payload), FRAME)]
    head = (HEADER + struct.pack("<IHH", RATE, 8, 1), 0)
    index = [(b"index\0\0\0", 0), (struct.pack("<QI", len(payload), zlib.crc32(payload)), len(payload))]
    return interleave(write_stream(SAMPLES, [head, *frames]), write_stream(INDEX, index))


def load(media: bytes) -> tuple[bytes, str]:
    """(payload, feature) read back from stored bytes; feature describes streams, time and samples."""
    streams, bad = read(media)
    main, index = streams.get(SAMPLES, Stream(SAMPLES)), streams.get(INDEX, Stream(INDEX))
    payload = b"".join(p for p, _ in main.packets[1:])
    size, crc = struct.unpack("<QI", index.packets[1][0]) if len(index.packets) > 1 else (-1, -1)
    whole = int(not bad and size == len(payload) and crc == zlib.crc32(payload))
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) * 1000 // max(1, len(x))
    turns = int(np.count_nonzero(np.diff(x > 96))) if len(x) else 0
    return payload, (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};bad={bad};whole={whole}"
        f";ms={max(0, main.last) * 1000 // RATE};mean_milli={mean};peak={int(x.max()) if len(x) else 0};turns={turns}"
    )


def media_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]) of every row.

    The text in UTF-8 (null: empty), filled with spaces to a positive multiple of 192, is stored as Ogg and read back.
    Equal texts give equal values; texts of any length are stored whole; rows keep their number, repeated ones too; a null id stays
    null; an empty table gives an empty one; other columns are not read.
    """
    kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    if keep_media:
        kinds["media"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for i, text in zip(ids, values):
                    raw = text.encode("utf-8", "surrogatepass")
                    media = store(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT))
                    back, feature = load(media)
                    digest = hashlib.sha256(back).hexdigest(), hashlib.sha256(media).hexdigest()
                    rows.append((i, len(raw), len(back), digest[0], zlib.crc32(back[-16:]), len(media), digest[1], feature, media)[: len(kinds)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    got = texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {names[k]}" for n, k in kinds.items()))
    return got.select(real_id("id").alias("doc_id"), *list(kinds)[1:])


def timed(s: Stream) -> list[int]:
    """The granule position at the end of every packet, -1 where it cannot be known.

    A page states that of the last packet that ends on it. In a stream of samples a packet lasts as many as it has bytes, so the others on the page are counted
    back from it, as far as packets follow one another without a loss.
    """
    out = [g for _, g in s.packets]
    if s.packets and s.packets[0][0].startswith(HEADER) and not s.lost:
        for k in range(len(out) - 2, -1, -1):
            if out[k] < 0 and out[k + 1] >= 0:
                out[k] = out[k + 1] - len(s.packets[k + 1][0])
    return out


def read_packets(files: DataFrame, id_col: str, media_col: str, rate: int = RATE) -> DataFrame:
    """(id, serial, packet_no, granule, seconds, data, bad_pages): one row per packet of every Ogg file.

    Null and foreign bytes give none, nor does an empty table; files of any length are read whole, and repeated files are read each. Times are those of timed().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                streams, bad = read(media.as_py() or b"")
                rows = [(i, s.serial, k, g if g >= 0 else None, g / rate if g >= 0 else None, p, bad) for s in streams.values() for k, ((p, _), g) in enumerate(zip(s.packets, timed(s)))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "serial", "packet_no", "granule", "seconds", "data", "bad_pages"])

    plain = files.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return plain.mapInArrow(run, "id long, serial long, packet_no long, granule long, seconds double, data binary, bad_pages long")
