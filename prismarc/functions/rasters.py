"""Signals of decoded rasters (arrays of grey or RGB values), as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_digest(mode: str, width: Column, height: Column, pixels: Column) -> Column:
    """SHA-256 of mode, size and the values as bytes."""
    head = F.concat_ws(":", F.lit(mode), width.cast("string"), height.cast("string"))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), ""))), 256)


def histogram(pixels: Column, bins: int = 8) -> Column:
    """The share of each of ``bins`` equal ranges of 0 to 255, to eight decimals."""
    at = F.transform(pixels, lambda p: F.floor(p * bins / 256))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.round(F.size(F.filter(at, lambda x: x == b)) / F.size(pixels), 8))


def low_information(pixels: Column) -> Column:
    """A standard deviation under 4, or at most four values."""
    n = F.size(pixels)
    total = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p)
    squares = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p * p)
    return (F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0))) < 4) | (F.size(F.array_distinct(pixels)) <= 4)


def gradient_bits(pixels: Column, width: int) -> Column:
    """A bit for each pixel that is darker than its right neighbour, row by row, as a long (a difference hash)."""
    places = F.filter(F.sequence(F.lit(0), F.size(pixels) - 2), lambda i: i % width != width - 1)
    bits = F.transform(places, lambda i: F.when(F.get(pixels, i) < F.get(pixels, i + 1), "1").otherwise("0"))
    return F.conv(F.array_join(F.slice(bits, 1, 64), ""), 2, -10).cast("long")


def l1(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v))


def ratio_delta(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """How far two aspect ratios are apart, of the greater; null unless all are positive."""
    a, b = w1 / h1, w2 / h2
    return F.when((w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0), F.abs(a - b) / F.greatest(a, b))


def pair_relation(same_file: Column, same_pixels: Column, low: Column, hashes: tuple[Column, Column], ratio: Column, colours: Column, cosines: tuple[Column, Column], same_prompt: Column, overlap: Column) -> Column:
    """The first rung that holds: exact_file, exact_pixels, near_copy (all gates, and neither image of low information), semantic, manual, none."""
    close = ~low & (hashes[0] <= 8) & (hashes[1] <= 8) & (ratio <= 0.05) & (colours <= 0.25)
    rungs = (("exact_file", same_file), ("exact_pixels", same_pixels), ("near_copy", close), ("semantic", (cosines[0] >= 0.9)), ("semantic", (cosines[1] >= 0.9)), ("manual", same_prompt | (overlap >= 0.8)))
    out = F.lit("none")
    for name, holds in reversed(rungs):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
