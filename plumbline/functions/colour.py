"""Colour science as column arithmetic (published formulas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ (D65) and the reference white.
RGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
WHITE = (0.95047, 1.0, 1.08883)
_KNEE = 6 / 29

Triple = tuple[Column, Column, Column]


def to_linear(c: Column) -> Column:
    """Linear light of an 8-bit sRGB channel."""
    v = c / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    """8-bit sRGB channel (not rounded) of linear light, clipped."""
    out = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return F.least(F.greatest(out * 255.0, F.lit(0.0)), F.lit(255.0))


def _bend(t: Column) -> Column:
    return F.when(t > _KNEE**3, F.cbrt(t)).otherwise(t / (3 * _KNEE**2) + 4 / 29)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Triple:
    light = [to_linear(c.cast("double")) for c in (r, g, b)]
    x, y, z = (_bend(sum((light[i] * row[i] for i in (1, 2)), light[0] * row[0]) / w) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e76(p: Triple, q: Triple) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:], strict=True)), (p[0] - q[0]) * (p[0] - q[0])))


def _hue(b: Column, a: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def _cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def ciede2000(p: Triple, q: Triple) -> Column:
    """Colour difference of Sharma, Wu and Dalal (2005)."""
    pow25 = 25.0**7
    (l1, a1, b1), (l2, a2, b2) = p, q
    mean = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    stretch = 1.5 - 0.5 * F.sqrt(F.pow(mean, F.lit(7.0)) / (F.pow(mean, F.lit(7.0)) + pow25))
    a1, a2 = stretch * a1, stretch * a2
    c1, c2 = F.hypot(a1, b1), F.hypot(a2, b2)
    grey = c1 * c2 == 0
    h1, h2 = _hue(b1, a1), _hue(b2, a2)
    turn, total = h2 - h1, h1 + h2
    far = F.abs(turn) > 180
    turn = F.when(grey, F.lit(0.0)).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    hue = F.when(grey, total).when(~far, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    light, chroma = (l1 + l2) / 2 - 50, (c1 + c2) / 2
    shape = 1 - 0.17 * _cosd(hue - 30) + 0.24 * _cosd(2 * hue) + 0.32 * _cosd(3 * hue + 6) - 0.20 * _cosd(4 * hue - 63)
    bump = F.exp(-F.pow((hue - 275) / 25, F.lit(2.0)))
    c7 = F.pow(chroma, F.lit(7.0))
    twist = -F.sin(F.radians(60 * bump)) * 2 * F.sqrt(c7 / (c7 + pow25))
    dl = (l2 - l1) / (1 + 0.015 * light * light / F.sqrt(20 + light * light))
    dc = (c2 - c1) / (1 + 0.045 * chroma)
    dh = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2)) / (1 + 0.015 * chroma * shape)
    return F.sqrt(dl * dl + dc * dc + dh * dh + twist * dc * dh)


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> Triple:
    """8-bit sRGB channels (not rounded) of a Lab colour."""
    fy = (lightness + 16) / 116
    xyz = [F.when(f > _KNEE, f * f * f).otherwise(3 * _KNEE**2 * (f - 4 / 29)) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True)]
    inverse = _inverse(RGB_TO_XYZ)
    r, g, b = (to_srgb(sum((xyz[i] * row[i] for i in (1, 2)), xyz[0] * row[0])) for row in inverse)
    return r, g, b


def _inverse(m) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m)).tolist()

