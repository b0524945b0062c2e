"""Media columns: Ogg pages with checksums, lacing, logical streams and granule positions.

write_ogg stores 8-bit samples in `STREAMS` logical streams: the samples are cut
into packets of PACKET samples, which the streams take in turn; each stream
begins with a header packet on a page of its own (rate, its number, the number
of streams, the samples of a packet). A page's granule position is the stream's
time, in samples of the whole, at which its last complete packet ends; packets
that go on over pages are continued. read_ogg trusts nothing: it checks every
page's checksum, sequence number and flags, joins packets from lacing values,
separates the streams by serial number, and orders packets by the times that
follow from granule positions.

Defined results: null and empty texts are one packet of 192 spaces; repeated
rows give equal rows; a null doc_id stays null; other columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col_of, sliced, small_batches, string_buffers

RATE, PACKET, STREAMS, PAD = 8000, 960, 2, 192
#: Fixed values of the format: capture pattern and version.
CAPTURE, VERSION = b"OggS", 0
HEAD, HEAD_BYTES = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """The format's CRC (polynomial 04c11db7, most significant bit first, from 0): zlib's with all bits mirrored."""
    mirrored = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEAD, CAPTURE, VERSION, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def lace(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def write_ogg(samples: bytes, rate: int = RATE, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    packets = [samples[i : i + packet] for i in range(0, len(samples), packet)]
    pages = [page(FIRST, 0, k + 1, 0, lace(16), struct.pack("<4sIIHH", b"smp8", rate, packet, k, streams)) for k in range(streams)]
    todo: list[list[tuple[int, bytes]]] = []  # of each stream, pages by the time at which they end
    for k in range(streams):
        mine, lacing, body, goes_on, granule, number, begun = [], bytearray(), bytearray(), False, -1, 1, 0
        end = 0

        def close(last: bool) -> None:
            nonlocal lacing, body, granule, number, goes_on
            flags = (CONTINUED if goes_on else 0) | (LAST if last else 0)
            mine.append((end, page(flags, granule, k + 1, number, bytes(lacing), bytes(body))))
            goes_on = bool(lacing) and lacing[-1] == 255
            lacing, body, granule, number = bytearray(), bytearray(), -1, number + 1

        own = range(k, len(packets), streams)
        for i in own:
            data, end = packets[i], i * packet + len(packets[i])
            begun = 0
            for v in lace(len(data)):
                if len(lacing) == 255:
                    close(False)
                lacing.append(v)
                body += data[begun : begun + v]
                begun += v
            granule = end
        close(True)
        todo.append(mine)
    pages += [p for _, _, p in sorted((end, k, p) for k, mine in enumerate(todo) for end, p in mine)]
    return b"".join(pages)


@dataclass
class Ogg:
    rate: int
    samples: bytes
    pages: int
    packets: int
    #: Of each audio packet in order: stream, begin and end in seconds.
    times: list[tuple[int, float, float]]


def read_ogg(data: bytes) -> Ogg:
    at, n_pages = 0, 0
    state: dict[int, dict] = {}
    while at < len(data):
        capture, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, data, at)
        if capture != CAPTURE or version != VERSION:
            raise ValueError(f"no page at byte {at}")
        body_at = at + HEAD_BYTES + n
        lacing = data[at + HEAD_BYTES : body_at]
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError(f"the page at byte {at} is cut off")
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in state:
                raise ValueError(f"stream {serial} begins twice")
            state[serial] = {"number": 0, "open": None, "packets": [], "ended": False}
        s = state.get(serial)
        if s is None or s["ended"] or s["number"] != number or bool(flags & CONTINUED) != (s["open"] is not None):
            raise ValueError(f"page {number} of stream {serial} is out of place")
        s["number"], s["ended"] = number + 1, bool(flags & LAST)
        done, now = [], s["open"] or b""
        p = body_at
        for v in lacing:
            now += data[p : p + v]
            p += v
            if v < 255:
                done.append(now)
                now = b""
        s["open"] = now if lacing and lacing[-1] == 255 else None
        if (granule == -1) != (not done) and not (granule == -1 and flags & LAST and not done):
            raise ValueError(f"page {number} of stream {serial}: its granule position and packets disagree")
        # Only the last packet that ends on the page has the granule's time; those before follow from the interleaving.
        s["packets"] += [(granule if i == len(done) - 1 else None, x) for i, x in enumerate(done)]
        at, n_pages = end, n_pages + 1
    rate, timed = 0, []
    for serial, s in state.items():
        if not s["ended"] or s["open"] is not None:
            raise ValueError(f"stream {serial} does not end")
        magic, rate, packet, k, streams = struct.unpack("<4sIIHH", s["packets"][0][1])
        if magic != b"smp8":
            raise ValueError(f"stream {serial} is of another kind")
        step, following = packet * streams, None
        for granule, x in reversed(s["packets"][1:]):
            if granule is not None:
                begin = granule - len(x)
            else:
                begin = following - step
            following = begin
            timed.append((begin, k, x))
    timed.sort(key=lambda t: t[:2])
    expected = 0
    for begin, _, x in timed:
        if begin != expected:
            raise ValueError(f"samples {expected} to {begin} are missing or double")
        expected += len(x)
    return Ogg(rate, b"".join(x for _, _, x in timed), n_pages, len(timed), [(k, b / rate, (b + len(x)) / rate) for b, k, x in timed])


def feature(ogg: Ogg) -> str:
    """Duration, packets, pages, mean, root mean square about it, and changes of side, of the samples read."""
    x = np.frombuffer(ogg.samples, np.uint8).astype(np.float64)
    d = x - x.mean()
    changes = int(np.count_nonzero(np.signbit(d[1:]) != np.signbit(d[:-1])))
    return f"s={ogg.times[-1][2]:.3f};packets={ogg.packets};pages={ogg.pages};mean={x.mean():.4f};rms={np.sqrt((d * d).mean()):.4f};changes={changes}"


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8), media (an Ogg file of its bytes as 8-bit samples, padded with spaces to a positive multiple of 192)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            data, o = string_buffers(col_of(b, "text"))
            raw = data.tobytes()
            media = []
            for lo, hi in zip(o[:-1], o[1:]):
                media.append(write_ogg(raw[lo:hi] + b" " * (-(hi - lo) % PAD if hi > lo else PAD)))
            yield batch_of(_OUT, [col_of(b, "doc_id"), np.diff(o), media])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def from_media(media: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives: digests of the payload and of the stored form, and a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "media"):
            rows = []
            for doc, n, m in zip(*(col_of(b, c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                got = read_ogg(m)
                p = got.samples
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(got)))
            yield batch_of(_READ, [list(c) for c in zip(*rows)])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
