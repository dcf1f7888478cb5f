"""Pixel expressions: brightness, curves, colour maps, quantising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def srgb_encode(v: Column) -> Column:
    """The sRGB curve, mirrored through 0 and unbounded."""
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 0.0031308, a * 12.92).otherwise(1.055 * F.pow(a, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(v: Column) -> Column:
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))


def matrix(m: list[list[float]], rgb: list[Column]) -> list[Column]:
    return [sum((c * w for c, w in zip(rgb[1:], row[1:])), rgb[0] * row[0]) for row in m]


def to_look(rgb: list[Column], balance: list[float], m: list[list[float]]) -> list[Column]:
    """Camera to look space: white balance, matrix, curve."""
    return [srgb_encode(c) for c in matrix(m, [c * w for c, w in zip(rgb, balance)])]


def from_look(rgb: list[Column], balance: list[float], inverse: list[list[float]]) -> list[Column]:
    return [c / w for c, w in zip(matrix(inverse, [srgb_decode(c) for c in rgb]), balance)]


def quantise(v: Column, bits: int = 16, scale: float = 1.0) -> Column:
    top = (1 << bits) - 1
    return F.floor(clamp(v, 0.0, scale) * top / scale + 0.5).cast("int")


def display8(v16: Column) -> Column:
    return F.floor(v16 / 257 + 0.5).cast("int")


# The polynomial of the published Turbo colour map.
TURBO = ((0.13572138, 4.6153926, -42.66032258, 132.13108234, -152.94239396, 59.28637943), (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604), (0.1066733, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973))


def turbo(t: Column) -> list[Column]:
    out = []
    for row in TURBO:
        v = F.lit(row[-1])
        for c in row[-2::-1]:
            v = v * t + c
        out.append(clamp(v))
    return out
