"""PNG files to pixels and back, in Arrow batches, and a thumbnail sink.

No imaging library is needed: the format's chunks, filters and interlacing are
read here.  A file that can't be read gives a state and no pixels, never an
error of the job.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more pixels than these are decoded.
MOST_PIXELS = 80_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, as the format fixes them.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column, first row, column step and row step of the seven interlaced passes, as the format fixes them.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if at + 12 + size > len(raw) or struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        yield kind, body
        at += 12 + size


def _rows(raw: bytes, height: int, stride: int, pixel: int) -> np.ndarray:
    """The scan lines of one pass with their filters undone."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    above, out = np.zeros(stride, np.uint8), np.empty((height, stride), np.uint8)
    for i, line in enumerate(lines):
        kind, row = line[0], line[1:]
        if kind == 1:
            wide = np.pad(row, (0, -stride % pixel)).reshape(-1, pixel)
            row = np.cumsum(wide, axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            made, up = bytearray(row.tobytes()), above.tobytes()
            for x in range(stride):
                left = made[x - pixel] if x >= pixel else 0
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    corner = up[x - pixel] if x >= pixel else 0
                    guess = min((left, up[x], corner), key=lambda v: abs(left + up[x] - corner - v))  # noqa: B023
                made[x] = (made[x] + guess) & 255
            row = np.frombuffer(bytes(made), np.uint8)
        elif kind:
            raise ValueError("unknown filter")
        out[i] = above = row
    return out


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """rows x width x channels, as stored below 8 bits and by the high byte at 16."""
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * channels * depth].reshape(len(lines), width, channels, depth)
        return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=-1).astype(np.uint16)
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    return lines.reshape(len(lines), width, channels).astype(np.uint16)


def _orientation(exif: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if not order or len(exif) < 10:
        return 1
    at = struct.unpack_from(order + "I", exif, 4)[0]
    for i in range(struct.unpack_from(order + "H", exif, at)[0] if at + 2 <= len(exif) else 0):
        entry = exif[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack_from(order + "H", entry)[0] == 0x0112:
            return struct.unpack_from(order + "H", entry, 8)[0]
    return 1


def decode(raw: bytes) -> np.ndarray:
    """height x width x 4 of an image of one frame, turned as its orientation says; ValueError tells why not."""
    if raw[:8] != SIGNATURE:
        raise ValueError("unknown format")
    head, palette, alpha, exif, packed, ended = None, None, None, b"", [], False
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            if not head[0] or not head[1]:
                raise ValueError("no pixels")
            if head[0] * head[1] > MOST_PIXELS:
                raise ValueError("too many pixels")
        elif kind == b"acTL" and struct.unpack_from(">I", body)[0] != 1:
            raise ValueError("several frames")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"eXIf":
            exif = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended:
        raise ValueError("cut short")
    width, height, depth, colour, _, _, laced = head
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise ValueError("unknown colour type")
    channels = CHANNELS[colour]
    bits, pixel = channels * depth, max(1, channels * depth // 8)
    passes = PASSES if laced else ((0, 0, 1, 1),)
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) if width > x and height > y else (0, 0) for x, y, dx, dy in passes]
    total = sum(h * ((w * bits + 7) // 8 + 1) for w, h in sizes if w)
    try:
        data = zlib.decompressobj().decompress(b"".join(packed), total + 1)
    except zlib.error as e:
        raise ValueError("broken data") from e
    if len(data) != total:
        raise ValueError("broken data")
    stored, at = np.zeros((height, width, channels), np.uint16), 0
    for (x, y, dx, dy), (w, h) in zip(passes, sizes, strict=True):
        if w:
            stride = (w * bits + 7) // 8
            lines = _rows(data[at : at + h * (stride + 1)], h, stride, pixel)
            stored[y::dy, x::dx] = _samples(lines, w, channels, depth)
            at += h * (stride + 1)
    full = np.full((height, width), 255, np.uint8)
    if colour == 3:
        if stored.max() >= len(palette):
            raise ValueError("broken palette")
        rgb = palette[stored[:, :, 0]]
        if alpha is not None:
            full = np.concatenate([np.frombuffer(alpha, np.uint8), np.full(256, 255, np.uint8)])[stored[:, :, 0]]
    else:
        scaled = (stored >> 8 if depth == 16 else stored * (255 // ((1 << depth) - 1))).astype(np.uint8)
        rgb = scaled[:, :, :3] if channels > 2 else np.repeat(scaled[:, :, :1], 3, axis=2)
        if channels in (2, 4):
            full = scaled[:, :, -1]
        elif alpha is not None:
            full = np.where((stored == np.frombuffer(alpha, ">u2")[:channels]).all(axis=2), 0, 255).astype(np.uint8)
    out = np.dstack([rgb, full])
    turn = _orientation(exif)
    if turn in (5, 6, 7, 8):
        out = out.transpose(1, 0, 2)
    if turn in (2, 3, 6, 7):
        out = out[:, ::-1]
    if turn in (3, 4, 7, 8):
        out = out[::-1]
    return np.ascontiguousarray(out)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of height x width (grey), x 3 (RGB) or x 4 (RGBA) values, unfiltered."""
    pixels = pixels if pixels.ndim == 3 else pixels[:, :, None]
    height, width, channels = pixels.shape
    lines = np.hstack([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)])
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def pixel_digest(rgba: np.ndarray) -> str:
    """SHA-256 of mode, width and height (four bytes each, high first) and the pixels."""
    return hashlib.sha256(b"RGBA" + struct.pack(">II", rgba.shape[1], rgba.shape[0]) + rgba.tobytes()).hexdigest()


def on_white(rgba: np.ndarray) -> np.ndarray:
    solid = rgba[:, :, 3:].astype(float) / 255
    return np.rint(rgba[:, :, :3] * solid + 255 * (1 - solid)).astype(np.uint8)


def signals(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without ``content``, with state, width, height, pixel_sha256, histogram (8 bins a channel) and low_information.

    The state is ``decoded`` or why not; the rest is null then.  Histogram and flag are of the whole image on white.
    A null content is ``missing``.  One image is held at a time.
    """
    keys = [c for c in files.columns if c != content]
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["state string, width long, height long, pixel_sha256 string, histogram array<double>, low_information boolean"])

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return "missing", None, None, None, None, None
        try:
            rgba = decode(bytes(raw))
        except (ValueError, struct.error) as e:
            return str(e) if isinstance(e, ValueError) else "broken chunk", None, None, None, None, None
        rgb = on_white(rgba)
        bins = np.concatenate([np.bincount(rgb[:, :, c].ravel() >> 5, minlength=8) for c in range(3)])
        low = bool(rgb.mean(axis=2).std() < 4 or len(np.unique(rgb.reshape(-1, 3), axis=0)) <= 4)
        return "decoded", rgba.shape[1], rgba.shape[0], pixel_digest(rgba), np.round(bins / rgb.size, 8).tolist(), low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([one(raw) for raw in batch[content]], columns=["state", "width", "height", "pixel_sha256", "histogram", "low_information"], index=batch.index)
            found[["width", "height"]] = found[["width", "height"]].astype("Int64")
            yield pd.concat([batch[keys], found], axis=1)

    return files.mapInPandas(run, schema)


def shrunk(rgba: np.ndarray, side: int) -> np.ndarray:
    """The image on white, no side above ``side``, by means over boxes."""
    rgb, (height, width) = on_white(rgba).astype(float), rgba.shape[:2]
    scale = min(1.0, side / max(height, width))
    for axis, size in ((0, height), (1, width)):
        edges = np.linspace(0, size, max(1, round(size * scale)) + 1).astype(int)[:-1]
        counts = np.diff(np.append(edges, size)).reshape([-1 if a == axis else 1 for a in range(3)])
        rgb = np.add.reduceat(rgb, edges, axis=axis) / counts
    return np.rint(rgb).astype(np.uint8)


def thumbnails(files: DataFrame, folder: str, priority: list[str], key: str, content: str = "content", most: int = 64, side: int = 256) -> DataFrame:
    """key, state, file, bytes of the first ``most`` distinct keys in the order of ``priority``: the feature is that bound.

    ``folder`` is one that all machines see.  A thumbnail is named by its digest and never changed; one that isn't smaller than
    its source is skipped.  ``clean`` deletes what no row names any more.
    """
    best = files.filter(F.col(content).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*priority)).alias("__at"))
    first = best.orderBy("__at", key).limit(most)
    chosen = files.select(key, content, F.struct(*priority).alias("__at")).join(F.broadcast(first), [key, "__at"]).dropDuplicates([key]).select(key, content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for raw in batch[content]:
                try:
                    small = encode(shrunk(decode(bytes(raw)), side))
                except (ValueError, struct.error):
                    out.append(("unreadable", None, None))
                    continue
                name = hashlib.sha256(small).hexdigest() + ".png"
                if len(small) >= len(raw):
                    out.append(("not smaller", None, None))
                    continue
                if not os.path.exists(os.path.join(folder, name)):
                    with open(os.path.join(folder, uuid.uuid4().hex + ".part"), "wb") as f:
                        f.write(small)
                    os.replace(f.name, os.path.join(folder, name))
                out.append(("made", name, len(small)))
            made = pd.DataFrame(out, columns=["state", "file", "bytes"], index=batch.index)
            made["bytes"] = made["bytes"].astype("Int64")
            yield pd.concat([batch[[key]], made], axis=1)

    kind = files.schema[key].dataType.simpleString()
    return chosen.mapInPandas(run, f"`{key}` {kind}, state string, file string, bytes long")


def clean(made: DataFrame, folder: str) -> list[str]:
    """Delete the thumbnails of ``folder`` that no row of ``made`` (as written, at most ``most`` rows) names."""
    kept = {r.file for r in made.select("file").collect()}
    gone = sorted(f for f in os.listdir(folder) if f.endswith(".png") and f not in kept)
    for f in gone:
        os.remove(os.path.join(folder, f))
    return gone
