"""Colour maths as Column expressions: sRGB, XYZ, Lab, Oklab, distances, remaps, gamut.

All but the gamut bisection stays inside Catalyst; rounding to integers is half to even
(``rint``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the colour spaces.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
FROM_ROOTS = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
TO_ROOTS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_CONES = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
EPSILON, KAPPA = 216 / 24389, 24389 / 27
GAMUT_SLACK, GAMUT_STEPS = 1e-9, 24
LIGHTNESS_WEIGHT = 1.5

Triple = tuple[Column, Column, Column]


def _apply(matrix, v: Triple) -> Triple:
    return tuple(reduce(lambda s, t: s + t, (F.lit(k) * c for k, c in zip(row, v, strict=True))) for row in matrix)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def channels(argb: Column) -> tuple[Column, Column, Column, Column]:
    """Alpha, red, green and blue of a packed colour, each 0 to 255."""
    return tuple(F.shiftright(argb, s).bitwiseAND(F.lit(255)).cast("int") for s in (24, 16, 8, 0))


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Channels to a packed 32-bit colour; a signed int, alpha in the top byte."""
    return F.shiftleft(a.cast("int"), 24).bitwiseOR(F.shiftleft(r.cast("int"), 16)).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def byte_to_linear(v: Column) -> Column:
    return srgb_to_linear(v / 255.0)


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def linear_to_byte(v: Column) -> Column:
    return F.rint(clamp(linear_to_srgb(clamp(v, 0, 1)), 0, 1) * 255.0).cast("int")


def linear_to_xyz(rgb: Triple) -> Triple:
    return _apply(TO_XYZ, rgb)


def xyz_to_linear(xyz: Triple) -> Triple:
    return _apply(FROM_XYZ, xyz)


def _transfer(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16.0) / 116.0)


def xyz_to_lab(xyz: Triple) -> Triple:
    fx, fy, fz = (_transfer(c / w) for c, w in zip(xyz, WHITE, strict=True))
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Triple:
    """Lab of 8-bit channels."""
    return xyz_to_lab(linear_to_xyz(tuple(map(byte_to_linear, (r, g, b)))))


def linear_to_oklab(rgb: Triple) -> Triple:
    return _apply(FROM_ROOTS, tuple(F.cbrt(c) for c in _apply(TO_CONES, rgb)))


def oklab_to_linear(lab: Triple) -> Triple:
    return _apply(FROM_CONES, tuple(c * c * c for c in _apply(TO_ROOTS, lab)))


def in_gamut(rgb: Triple) -> Column:
    return reduce(lambda s, t: s & t, ((c >= -GAMUT_SLACK) & (c <= 1 + GAMUT_SLACK) for c in rgb))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("r", "g", "b", "chroma_lost")]))
def _compressed(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
    apply = lambda matrix, x: np.array(matrix) @ x
    fits = lambda x: ((x >= -GAMUT_SLACK) & (x <= 1 + GAMUT_SLACK)).all(axis=0)
    rgb = np.stack([c.to_numpy(np.float64) for c in (r, g, b)])
    out, lost = rgb.copy(), np.zeros(rgb.shape[1])
    outside = np.flatnonzero(~fits(rgb))
    light, along, across = apply(FROM_ROOTS, np.cbrt(apply(TO_CONES, rgb[:, outside])))
    light, chroma = np.clip(light, 0, 1), np.sqrt(along * along + across * across)
    ha, hb = (np.divide(c, chroma, out=np.zeros_like(c), where=chroma > 0) for c in (along, across))
    at = lambda c: apply(FROM_CONES, apply(TO_ROOTS, np.stack([light, ha * c, hb * c])) ** 3)
    lo, hi = np.zeros_like(chroma), chroma
    for _ in range(GAMUT_STEPS):
        middle = 0.5 * (lo + hi)
        inside = fits(at(middle))
        lo, hi = np.where(inside, middle, lo), np.where(inside, hi, middle)
    out[:, outside], lost[outside] = np.clip(at(lo), 0, 1), chroma - lo
    return pd.DataFrame({"r": out[0], "g": out[1], "b": out[2], "chroma_lost": lost})


def compress(r: Column, g: Column, b: Column) -> Column:
    """Struct of r, g, b and chroma_lost: chroma cut at constant hue until the colour fits.

    Colours inside the gamut pass unchanged. The bisection runs on whole batches: as nested
    Column expressions its steps are interpreted row by row.
    """
    return _compressed(r, g, b)


def display_colour(r: Column, g: Column, b: Column) -> Column:
    """Opaque packed colour of linear light, out-of-gamut colours compressed."""
    m = compress(r, g, b)
    return pack(F.lit(255), *(linear_to_byte(m[c]) for c in "rgb"))


def quantise(r: Column, g: Column, b: Column) -> Column:
    """18-bit key: the six leading bits of each channel."""
    return F.shiftleft(F.shiftright(r, 2), 12).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 6)).bitwiseOR(F.shiftright(b, 2))


def key_to_rgb(key: Column) -> Triple:
    """Centre of a key's bin."""
    return tuple((F.shiftleft(F.shiftright(key, s).bitwiseAND(F.lit(63)), 2) + 2).cast("int") for s in (12, 6, 0))


def perceptual_distance(x: Triple, y: Triple) -> Column:
    """Weighted HyAB: lightness apart counts 1.5 times, hue and chroma as a plane distance."""
    return LIGHTNESS_WEIGHT * F.abs(x[0] - y[0]) + F.hypot(x[1] - y[1], x[2] - y[2])


def squared_distance(x: Triple, y: Triple, lightness: float = 1.0) -> Column:
    dl, da, db = (p - q for p, q in zip(x, y, strict=True))
    return lightness * dl * dl + da * da + db * db


def ciede2000(x: Triple, y: Triple) -> Column:
    """The CIEDE2000 difference of two Lab colours, neutral colours having no hue."""
    (l1, a1, b1), (l2, a2, b2) = x, y
    c_mean = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    seventh = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))
    grow = 1.5 - 0.5 * seventh(c_mean)
    p1, p2 = a1 * grow, a2 * grow
    c1, c2 = F.hypot(p1, b1), F.hypot(p2, b2)
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)) + 360.0, F.lit(360.0)))
    h1, h2 = hue(p1, b1), hue(p2, b2)
    grey = c1 * c2 == 0
    apart = h2 - h1
    dh = F.when(grey, 0.0).when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart)
    total = h1 + h2
    h = F.when(grey, total).when(F.abs(apart) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    cosine = lambda k, shift: F.cos(F.radians(k * h + shift))
    t = 1 - 0.17 * cosine(1.0, -30.0) + 0.24 * cosine(2.0, 0.0) + 0.32 * cosine(3.0, 6.0) - 0.20 * cosine(4.0, -63.0)
    l_mean, c = (l1 + l2) / 2, (c1 + c2) / 2
    off = (l_mean - 50) * (l_mean - 50)
    dl = (l2 - l1) / (1 + 0.015 * off / F.sqrt(20 + off))
    dc = (c2 - c1) / (1 + 0.045 * c)
    dhue = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2)) / (1 + 0.015 * c * t)
    turn = F.radians(60 * F.exp(-F.pow((h - 275) / 25, F.lit(2.0))))
    return F.sqrt(dl * dl + dc * dc + dhue * dhue - 2 * seventh(c) * F.sin(turn) * dc * dhue)


def describe_quality(de: Column) -> Column:
    return F.when(de < 1, "indistinguishable").when(de < 2, "very close").when(de < 3, "close").when(de < 5, "noticeable").otherwise("clearly different")


def describe_shift(target: Triple, mixed: Triple, least: float = 1.0) -> Column:
    """What a mix reads like beside its target; null where neither shift is large enough."""
    dl = mixed[0] - target[0]
    dc = F.hypot(mixed[1], mixed[2]) - F.hypot(target[1], target[2])
    light = F.when(dl >= least, "lighter").when(dl <= -least, "darker")
    chroma = F.when(dc >= least, "more intense").when(dc <= -least, "duller")
    return F.nullif(F.concat_ws(" and ", light, chroma), F.lit(""))


def remap(lab: Triple, ceiling: Column | float, *, contrast: float, key: float, gain: float) -> Triple:
    """Tone and chroma remap; gains above 1 roll off towards the reachable chroma."""
    light, a, b = lab
    chroma = F.hypot(a, b)
    if gain <= 1:
        scaled = gain * chroma
    else:
        top = F.greatest(F.lit(1e-9), ceiling if isinstance(ceiling, Column) else F.lit(float(ceiling)))
        knee = (gain - 1) / 2
        scaled = (1 - knee) * gain * chroma + knee * top * F.tanh(gain * chroma / top)
    scale = F.when(chroma <= 1e-9, 1.0).otherwise(scaled / chroma)
    return clamp(50 + (light - 50) * contrast + key, 0, 100), a * scale, b * scale


def swatch_css(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("rgb(%d,%d,%d)", r, g, b)


def reads_dark_text(r: Column, g: Column, b: Column) -> Column:
    """Whether dark text reads on this colour."""
    return 0.299 * r + 0.587 * g + 0.114 * b >= 140


def hsv_to_argb(hue: Column, saturation: Column, alpha: Column) -> Column:
    """Full-value HSV colour, hue in degrees."""
    sector = hue / 60.0
    second = saturation * (1 - F.abs(sector % 2.0 - 1))
    zero = F.lit(0.0)
    order = [(saturation, second, zero), (second, saturation, zero), (zero, saturation, second), (zero, second, saturation), (second, zero, saturation)]

    def channel(i: int) -> Column:
        c = F.when(sector < 1, order[0][i])
        for k in range(1, 5):
            c = c.when(sector < k + 1, order[k][i])
        return F.rint((c.otherwise((saturation, zero, second)[i]) + 1 - saturation) * 255)

    return pack(alpha, *(channel(i) for i in range(3)))
