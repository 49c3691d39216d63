"""MPEG audio as a media column.

``encode`` writes a payload without loss into MPEG-1 Layer III frames: an ID3v2.4
tag with the length, a frame with the Xing table, then mono frames at 48 kHz
with checksums, silent, the payload in their main data area; the bit rate of
the last is the least that holds the rest.  ``parse`` reads any MPEG-1, 2 or
2.5 stream of layers I to III: it skips and reads ID3v2 and ID3v1 tags, finds
frame headers again after damage (two headers in a row must fit), reads Xing,
Info and VBRI tables and holds their number of frames against those found,
checks the checksums of layer III and notes samples, exact duration and the
offset of every ``stride``-th frame.  An ID3v1 tag is one only where a frame or
damage ends at it, so a payload may hold its mark.  Checksums of layers I and II
are read over, not checked; headers of free format are taken for damage.

Null payloads are null media, and null media have null results.  Streams
without a frame give zero frames and a duration of 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1 to 14, and Hz.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    kbits: int
    hertz: int
    crc: bool
    mono: bool
    size: int
    samples: int
    side: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.hertz


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """Of four bytes; None if they are none, or of free format."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    rate, tone = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or tone == 3 or raw[3] & 3 == 2:
        return None
    kbits, hertz = KBITS[1 if version == "1" else 2, layer][rate - 1], HERTZ[version][tone]
    mono, pad = raw[3] >> 6 == 3, raw[2] >> 1 & 1
    if layer == 1:
        size, samples = (12_000 * kbits // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != "1" else 1152
        size = samples // 8 * 1000 * kbits // hertz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
    return Header(version, layer, kbits, hertz, not raw[1] & 1, mono, size, samples, side)


@lru_cache(65_536)
def crc16(covered: bytes) -> int:
    """Polynomial 0x8005, start 0xFFFF."""
    value = 0xFFFF
    for byte in covered:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def text_frame(name: bytes, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name + syncsafe(len(body)) + b"\x00\x00" + body


@lru_cache(64)
def lead(index: int) -> bytes:
    """Header, checksum and empty side information of a frame that ``encode`` writes."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


SIZES = [3 * k for k in KBITS[1, 3]]  # bytes of a frame at 48 kHz
LEAD = 23


def encode(payload: bytes) -> bytes:
    most = SIZES[-1] - LEAD
    whole, rest = divmod(len(payload), most)
    frames = []
    full = lead(14)
    for i in range(whole):
        frames.append(full + payload[i * most : (i + 1) * most])
    if rest or not whole:
        index = next(i for i, s in enumerate(SIZES) if s - LEAD >= rest)
        frames.append((lead(index + 1) + payload[whole * most :]).ljust(SIZES[index], b"\0"))
    sizes = [len(f) for f in frames]
    first = SIZES[6]  # 288 bytes hold the table
    total, count = sum(sizes) + first, len(frames)
    place = lambda i: first + min(i, whole) * SIZES[-1] + (sizes[-1] if i > whole else 0)
    toc = bytes(min(255, place(count * i // 100) * 256 // total) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    table = (lead(7) + xing).ljust(first, b"\0")
    ms = str(1152 * count * 1000 // 48_000)
    tags = text_frame(b"TLEN", ms) + text_frame(b"TXXX", f"payload\0{len(payload)}")
    return b"".join((b"ID3\x04\x00\x00", syncsafe(len(tags)), tags, table, *frames))


@dataclass
class Stream:
    """What ``parse`` finds; payload is the main data of the frames, cut to the tag's length if there is one."""

    tags: dict[str, str] = field(default_factory=dict)
    table: str = "none"
    table_frames: int = -1
    table_bytes: int = -1
    toc: bytes = b""
    frames: int = 0
    samples: int = 0
    duration: Fraction = Fraction(0)
    rates: set = field(default_factory=set)
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    whole: bool = True  # as many frames as the table says, or no table
    kind: tuple = ()
    seek: list[int] = field(default_factory=list)
    payload: bytes = b""


def read_tag(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the ID3v2 tag at ``at``; the place behind it."""
    version, flags = data[at + 3], data[at + 5]
    n = 0
    for b in data[at + 6 : at + 10]:
        n = n << 7 | b & 127
    end = min(len(data), at + 10 + n)
    body = data[at + 10 : end]
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    pos = 0
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        pos = int.from_bytes(body[:4], "big") + (4 if version == 3 else 0)
    tags["id3"] = f"2.{version}"
    while version >= 3 and pos + 10 <= len(body) and body[pos]:
        name, raw = body[pos : pos + 4], body[pos + 4 : pos + 8]
        size = int.from_bytes(raw, "big") if version == 3 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
        text = body[pos + 10 : pos + 10 + size]
        if name[:1] == b"T" and text:
            said = text[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(text[0], "utf-8"), "replace").strip("\0")
            key, _, value = said.partition("\0") if name == b"TXXX" else (name.decode("latin-1"), "", said)
            tags.setdefault(key, value)
        pos += 10 + size
    return end + (10 if flags & 0x10 else 0)


def parse(data: bytes, stride: int = 64) -> Stream:
    out, at, end = Stream(), 0, len(data)
    trailer = end - 128 if data[-128:-125] == b"TAG" and end >= 128 else -1
    parts: list[bytes] = []
    while at + 4 <= end:
        if at == trailer:
            out.tags["id3v1"] = data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            at = end
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = read_tag(data, at, out.tags)
            continue
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        sure = h and (out.kind == h.kind or not out.kind) and after <= end
        if sure and not (out.frames or out.table != "none") and after + 4 <= end:  # the first header needs a second one
            following = header(data[after : after + 4])
            sure = following is not None and following.kind == h.kind
        if not sure:
            nearest = data.find(b"\xff", at + 1, end)
            step = (nearest if nearest > 0 else end) - at
            tag = data.find(b"ID3", at + 1, at + step)
            step = tag - at if tag > 0 else step
            step = trailer - at if at < trailer < at + step else step
            out.skipped += step
            at += step
            continue
        body = at + 4 + 2 * h.crc
        out.kind = h.kind
        if h.crc and h.layer == 3:
            out.checked += 1
            out.broken += crc16(data[at + 2 : at + 4] + data[body : body + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        mark = data[body + h.side : body + h.side + 4]
        if not out.frames and out.table == "none" and (mark in (b"Xing", b"Info") or data[at + 36 : at + 40] == b"VBRI"):
            if mark in (b"Xing", b"Info"):
                out.table, pos = mark.decode(), body + h.side + 8
                flags = data[pos - 1]
                if flags & 1:
                    out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
                if flags & 2:
                    out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
                if flags & 4:
                    out.toc = data[pos : pos + 100]
            else:
                out.table = "VBRI"
                out.table_bytes, out.table_frames = int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        else:
            if out.frames % stride == 0:
                out.seek.append(at)
            out.frames += 1
            out.samples += h.samples
            out.rates.add(h.kbits)
            parts.append(data[body + h.side : after])
        at = after
    out.skipped += max(0, end - at)
    out.whole = out.table_frames in (-1, out.frames)
    if out.kind:
        out.duration = Fraction(out.samples, out.kind[2])
    payload = b"".join(parts)
    said = out.tags.get("payload", "")
    out.payload = payload[: int(said)] if said.isdigit() else payload
    return out


def feature(s: Stream) -> str:
    version, layer, hertz = s.kind or ("-", 0, 0)
    return (
        f"mpeg{version}-layer{layer};hz={hertz};frames={s.frames};samples={s.samples};seconds={s.duration.numerator}/{s.duration.denominator};"
        f"kbits={min(s.rates, default=0)}-{max(s.rates, default=0)};table={s.table}:{s.table_frames}:{s.table_bytes};id3={s.tags.get('id3', '-')};"
        f"crc={s.checked - s.broken}/{s.checked};skipped={s.skipped};whole={s.whole};seek={','.join(map(str, s.seek[:4]))}({len(s.seek)})"
    )


def _mapped(df: DataFrame, name: str, schema: str, work, most: int = 8 << 20) -> DataFrame:
    """``df`` with the columns that ``work`` makes of the bytes of column ``name``, in Arrow batches of bounded size."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name, most):
            made = work(as_bytes(batch, name))
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != name]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *made.values()], names=[*(n for n, _ in kept), *made])

    return df.mapInArrow(run, f"{kinds}, {schema}" if kinds else schema)


def encode_column(df: DataFrame, payload_col: str, media_col: str = "media") -> DataFrame:
    """Replaces the payload by its media."""
    return _mapped(df, payload_col, f"`{media_col}` binary", lambda raw: {media_col: pa.array([None if x is None else encode(x) for x in raw], pa.binary())})


def parse_column(df: DataFrame, media_col: str = "media", stride: int = 64, keep_payload: bool = True) -> DataFrame:
    """Replaces the media by frames, samples, seconds, crc_broken, seek_offsets, feature, sizes and digests, and the payload read back."""

    def work(raw: list[bytes | None]) -> dict[str, pa.Array]:
        found = [None if x is None else parse(x, stride) for x in raw]
        each = lambda f, kind: pa.array([None if s is None else f(s) for s in found], kind)
        out = {
            "frames": each(lambda s: s.frames, pa.int64()),
            "samples": each(lambda s: s.samples, pa.int64()),
            "seconds": each(lambda s: float(s.duration), pa.float64()),
            "crc_broken": each(lambda s: s.broken, pa.int64()),
            "seek_offsets": each(lambda s: s.seek, pa.list_(pa.int64())),
            "payload_bytes": each(lambda s: len(s.payload), pa.int64()),
            "payload_sha256": each(lambda s: hashlib.sha256(s.payload).hexdigest(), pa.string()),
            "tail_crc32": each(lambda s: zlib.crc32(s.payload[-64:]), pa.int64()),
            "media_bytes": pa.array([None if x is None else len(x) for x in raw], pa.int64()),
            "media_sha256": pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
            "feature": each(feature, pa.string()),
        }
        if keep_payload:
            out["payload"] = each(lambda s: s.payload, pa.binary())
        return out

    schema = "frames long, samples long, seconds double, crc_broken long, seek_offsets array<long>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _mapped(df, media_col, schema + (", payload binary" if keep_payload else ""), work)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", multiple: int = 64) -> DataFrame:
    """The contract's columns: every text, padded with zeros, through ``encode`` and ``parse``."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    padded = docs.select(F.col(id_col), F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("__raw"))
    n = F.octet_length("__raw")
    to = F.greatest(F.lit(multiple), F.ceil(n / multiple) * multiple).cast("int")
    padded = padded.select(id_col, "n_bytes", F.rpad(F.col("__raw"), to, F.lit(b"\0")).alias("__payload"))
    read = parse_column(encode_column(padded, "__payload"), keep_payload=False)
    return read.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "samples", "seconds", "crc_broken", "seek_offsets")
