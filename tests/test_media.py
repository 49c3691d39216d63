"""Image files against an encoder of its own, and copies, fetches, intakes and shards against plain loops."""

import hashlib
import os
import random
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismarc.sources import images, stores


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, pixel, rng):
    """Scan lines under random filters, byte by byte as the format defines them."""
    out, above = b"", bytes(len(rows[0])) if rows else b""
    for row in rows:
        kind, line = rng.randrange(5), bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - pixel] if i >= pixel else 0, above[i], above[i - pixel] if i >= pixel else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind]) + bytes(line)
        above = row
    return out


def packed_row(samples, depth):
    if depth == 16:
        return b"".join(struct.pack(">H", s) for s in samples)
    bits = "".join(format(s, f"0{depth}b") for s in samples)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def png(stored, colour, depth, rng, laced=False, extra=b"", split=1):
    """``stored``: height x width x channels."""
    height, width, channels = stored.shape
    data = b""
    for x, y, dx, dy in images.PASSES if laced else ((0, 0, 1, 1),):
        part = stored[y::dy, x::dx]
        if part.size:
            data += filtered([packed_row(r.ravel().tolist(), depth) for r in part], max(1, channels * depth // 8), rng)
    data = zlib.compress(data)
    parts = [data[len(data) * i // split : len(data) * (i + 1) // split] for i in range(split)]
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(laced))) + extra + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
@pytest.mark.parametrize("laced", [False, True])
def test_every_kind_of_file(colour, depth, laced):
    rng, channels = random.Random(f"{colour}{depth}{laced}"), images.CHANNELS[colour]
    for _ in range(4):
        height, width = rng.randint(1, 11), rng.randint(1, 11)
        stored = np.array([rng.randrange(1 << depth) for _ in range(height * width * channels)]).reshape(height, width, channels)
        palette = bytes(rng.randrange(256) for _ in range(3 << depth)) if colour == 3 else b""
        seen = bytes(rng.randrange(256) for _ in range(1 << depth - 1))
        extra = chunk(b"PLTE", palette) + chunk(b"tRNS", seen) if colour == 3 else b""
        got = images.decode(png(stored, colour, depth, rng, laced, extra, split=rng.randint(1, 3)))
        level = lambda v: v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1)  # noqa: E731,B023
        for y in range(height):
            for x in range(width):
                s = [int(v) for v in stored[y, x]]
                if colour == 3:
                    want = [*palette[3 * s[0] : 3 * s[0] + 3], seen[s[0]] if s[0] < len(seen) else 255]
                else:
                    v = [level(c) for c in s]
                    want = {0: lambda v: v * 3 + [255], 2: lambda v: v + [255], 4: lambda v: v[:1] * 3 + v[1:], 6: lambda v: v}[colour](v)
                assert got[y, x].tolist() == want


def test_colour_keys_and_orientations():
    rng = random.Random(1)
    grey = np.array([[[3], [9]], [[9], [4]], [[1], [2]]])
    got = images.decode(png(grey, 0, 8, rng, extra=chunk(b"tRNS", struct.pack(">H", 9))))
    assert got[:, :, 3].tolist() == [[255, 0], [0, 255], [255, 255]]
    # places of the stored pixels 1 to 6 (two columns, three rows) once turned
    stored = np.arange(1, 7).reshape(3, 2, 1)
    want = {1: [[1, 2], [3, 4], [5, 6]], 2: [[2, 1], [4, 3], [6, 5]], 3: [[6, 5], [4, 3], [2, 1]], 4: [[5, 6], [3, 4], [1, 2]]}
    want |= {5: [[1, 3, 5], [2, 4, 6]], 6: [[5, 3, 1], [6, 4, 2]], 7: [[6, 4, 2], [5, 3, 1]], 8: [[2, 4, 6], [1, 3, 5]]}
    for order, mark in (("<", b"II"), (">", b"MM")):
        for turn, rows in want.items():
            exif = mark + struct.pack(order + "HIH", 42, 8, 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, turn, 0)
            assert images.decode(png(stored, 0, 8, rng, extra=chunk(b"eXIf", exif)))[:, :, 0].tolist() == rows


def test_states_of_files(spark):
    rng = random.Random(2)
    noise = np.array([rng.randrange(256) for _ in range(48)]).reshape(4, 4, 3)
    good = png(noise, 2, 8, rng)
    big = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 10000, 10000, 8, 2, 0, 0, 0))
    none = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 0, 4, 8, 2, 0, 0, 0))
    files = {
        "decoded": good,
        "missing": None,
        "unknown format": b"GIF89a",
        "cut short": good[:-12],
        "broken chunk": good[:40] + b"\0" + good[41:],
        "too many pixels": big,
        "no pixels": none,
        "several frames": png(noise, 2, 8, rng, extra=chunk(b"acTL", struct.pack(">II", 2, 0))),
        "broken data": png(noise[:3], 2, 8, rng).replace(chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)), chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0))),
    }
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "name string, content binary")
    got = {r.name: r for r in images.signals(rows).collect()}
    assert {k: r.state for k, r in got.items()} == {k: k for k in files}
    r = got["decoded"]
    rgba = b"".join(bytes([*p, 255]) for p in noise.reshape(-1, 3).tolist())
    assert (r.width, r.height, r.pixel_sha256, r.low_information) == (4, 4, hashlib.sha256(b"RGBA\0\0\0\4\0\0\0\4" + rgba).hexdigest(), False)
    assert r.histogram == [round(sum(v // 32 == b for v in noise[:, :, c].ravel().tolist()) / 48, 8) for c in range(3) for b in range(8)]
    assert got["missing"].width is None and images.signals(rows.limit(0)).count() == 0


def test_thumbnails(spark, tmp_path):
    rng, folder = np.random.default_rng(3), str(tmp_path / "thumbs")
    big = [images.encode(rng.integers(0, 256, (40, 20, 3))) for _ in range(6)]
    rows = [(f"k{i}", i, bytearray(b)) for i, b in enumerate(big)] + [("k0", 9, bytearray(big[0])), ("bad", -1, bytearray(b"x")), ("tiny", -2, bytearray(images.encode(np.full((1, 1), 7)))), (None, -3, bytearray(big[1]))]
    files = spark.createDataFrame(rows, "k string, p int, content binary")
    made = {r.k: r for r in images.thumbnails(files, folder, ["p"], "k", most=5, side=10).collect()}
    assert {k: r.state for k, r in made.items()} == {"tiny": "not smaller", "bad": "unreadable", "k0": "made", "k1": "made", "k2": "made"}
    for i in range(3):
        with open(os.path.join(folder, made[f"k{i}"].file), "rb") as f:
            raw = f.read()
        assert hashlib.sha256(raw).hexdigest() + ".png" == made[f"k{i}"].file and len(raw) == made[f"k{i}"].bytes
        full = images.decode(big[i])[:, :, :3].astype(float)
        assert (images.decode(raw)[:, :, :3] == np.rint(full.reshape(10, 4, 5, 4, 3).mean(axis=(1, 3)))).all()
    fewer = images.thumbnails(files, folder, ["p"], "k", most=3, side=10).persist()
    assert images.clean(fewer, folder) == sorted({made["k1"].file, made["k2"].file})
    assert os.listdir(folder) == [made["k0"].file]


def test_copies_are_read_back(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "body string")
    first = stores.copied(rows, "body", lambda: stores.Folder(folder), "p/", ".txt").collect()
    assert {(r.key, r.status, r.bytes) for r in first} == {(f"p/{hashlib.sha256(b).hexdigest()}.txt", "uploaded_verified", len(b)) for b in (b"a", b"b", b"")}
    assert {r.status for r in stores.copied(rows, "body", lambda: stores.Folder(folder), "p/", ".txt").collect()} == {"reused_verified"}
    stores.Folder(folder).put(f"p/{hashlib.sha256(b'a').hexdigest()}.txt", b"other")
    with pytest.raises(Exception, match="conflict"):
        stores.copied(rows, "body", lambda: stores.Folder(folder), "p/", ".txt").collect()

    class Lossy(stores.Folder):
        def put(self, key, body):
            super().put(key, body[:-1])

    with pytest.raises(Exception, match="readback mismatch"):
        stores.copied(rows, "body", lambda: Lossy(str(tmp_path / "lossy"))).collect()


def test_fetches(spark, tmp_path):
    log = str(tmp_path)

    class Client:
        def get(self, url):
            with open(os.path.join(log, hashlib.md5(url.encode()).hexdigest()), "a") as f:
                f.write("x")
            if "deny" in url:
                raise PermissionError("429")
            if "down" in url:
                raise OSError("down")
            return url.encode()

    urls = [f"http://{h}.org/{i}" for h in "ab" for i in range(4)] + ["HTTP://a.org:80/9", "http://c.org/1", "http://c.org/2deny", "http://c.org/3", "http://d.org/down", "no url", None, "http://a.org/0"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    folder = str(tmp_path / "bodies")
    got = stores.fetched(rows, Client, lambda: stores.Folder(folder)).persist()
    state = {r.url: r.state for r in got.collect()}
    assert state == {u: "stopped" if u in ("http://c.org/2deny", "http://c.org/3") else "failed" if "down" in u else "fetched" for u in urls if u}
    assert {r.url: r.host for r in got.collect()}["HTTP://a.org:80/9"] == "a.org"
    calls = {u: os.path.getsize(p) if os.path.exists(p := os.path.join(log, hashlib.md5(u.encode()).hexdigest())) else 0 for u in urls if u}
    assert calls == {u: 3 if "down" in u else 0 if u == "http://c.org/3" else 1 for u in calls}
    assert {r.url for r in got.collect() if r.state == "fetched" and stores.Folder(folder).get(r.sha256) == r.url.encode()} == {u for u, s in state.items() if s == "fetched"}
    again = stores.fetched(rows, Client, done=got).collect()
    assert {r.url for r in again} == {u for u, s in state.items() if s != "fetched"}
    assert {r.state for r in stores.fetched(rows, Client, least_free=1 << 62).collect()} == {"no room"}


def test_intakes(spark):
    def parse(body):
        if body == "bad":
            raise ValueError("bad")
        return body.split(), "part" not in body

    rng = random.Random(5)
    for most in (1, 4, 20):
        rows = [(f"s{rng.randrange(9)}", f"p{i:02}", f"h{i}", rng.choice(["bad", "x part", "x y", "z", ""])) for i in range(60)]
        before = [(s, p, h if rng.random() < 0.7 else "old", datetime(2024, 1, d)) for s, p, h, _ in rng.sample(rows, 25) for d in [rng.choice([1, 9, 20])]]
        now = datetime(2024, 1, 10)
        known = {(s, p, h) for s, p, h, at in before if 0 <= (now - at).total_seconds() < 7 * 86400}
        want, failed = {}, set()
        for s, p, h, body in sorted(rows):
            if (s, p, h) in known or s in failed or len(want) == most:
                continue
            try:
                items, whole = parse(body)
                want[s, p] = ("completed" if whole else "incomplete", items)
            except ValueError:
                failed.add(s)
                want[s, p] = ("failed", [])
        checkpoint = spark.createDataFrame(before, "source string, path string, sha string, sealed_at timestamp")
        taken = stores.intake(spark.createDataFrame(rows, "source string, path string, sha string, body string"), checkpoint, parse, str(now), most).persist()
        assert {(r.source, r.path): (r.state, r["items"]) for r in taken.collect()} == want
        after = {(r.source, r.path): (r.sha, r.sealed_at) for r in stores.sealed(checkpoint, taken, str(now)).collect()}
        sha = {(s, p): h for s, p, h, _ in rows}
        assert after == {(s, p): (h, at) for s, p, h, at in before} | {k: (sha[k], now) for k, (state, _) in want.items() if state == "completed"}


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i * 7 % 1009, f"v{i}") for i in range(1009)], "k long, v string")
    stores.write_shards(rows, str(tmp_path / "s"), "k", 100)
    shards = spark.read.parquet(str(tmp_path / "s" / "shards"))
    assert {(r.shard, r.n, r.low, r.high) for r in shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()} == {(i, min(100, 1009 - 100 * i), 100 * i, min(100 * i + 99, 1008)) for i in range(11)}
    want = {r.k: r.v for r in rows.filter("k IN (0, 99, 100, 1008)").collect()}
    keys = spark.createDataFrame([(0,), (99,), (100,), (1008,), (5000,), (0,)], "k long")
    assert {r.k: r.v for r in stores.from_shards(spark, str(tmp_path / "s"), keys, "k").collect()} == want
