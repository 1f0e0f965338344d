"""The five styles against a plain walk over every pixel of small images."""

import math

import numpy as np
import pytest

from tests.test_mixing_paints import plain_palette
from tests.test_regions import flood, plain_merge
from tintframe.functions import color
from tintframe.operators import mixtures
from tintframe.plans import styles

MARK = 2.0


def lab_of(r, g, b):
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in (r, g, b)]
    f = [np.cbrt(t) if t > color.EPSILON else (color.KAPPA * t + 16) / 116 for t in (sum(m * v for m, v in zip(row, lin, strict=True)) / w for row, w in zip(color.TO_XYZ, color.WHITE, strict=True))]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def mean(grid, radius):
    """Rows first, then columns, each over what lies within the radius."""
    h, w = grid.shape
    rows = np.array([[grid[y, max(0, x - radius) : x + radius + 1].mean() for x in range(w)] for y in range(h)])
    return np.array([[rows[max(0, y - radius) : y + radius + 1, x].mean() for x in range(w)] for y in range(h)])


def filtered(argb, radius, edge, times):
    out = np.zeros((*argb.shape, 3), int)
    for i, shift in enumerate((16, 8, 0)):
        v = np.vectorize(lambda c: c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4)(((argb >> shift) & 255) / 255)
        for _ in range(times):
            m, q = mean(v, radius), mean(v * v, radius)
            var = np.maximum(q - m * m, 0)
            a = var / (var + edge * edge)
            v = mean(a, radius) * v + mean((1 - a) * m, radius)
        v = np.clip(v, 0, 1)
        out[..., i] = np.rint(np.clip(np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055), 0, 1) * 255)
    return out


def remapped(lab, style, ceiling):
    light, a, b = lab
    chroma, gain, top = math.hypot(a, b), style.value("chroma"), max(1e-9, ceiling)
    knee = (gain - 1) / 2
    scaled = gain * chroma if gain <= 1 else (1 - knee) * gain * chroma + knee * top * math.tanh(gain * chroma / top)
    scale = 1.0 if chroma <= 1e-9 else scaled / chroma
    return min(100, max(0, 50 + (light - 50) * style.value("contrast") + style.value("key"))), a * scale, b * scale


def best(p, labs, lightness=1.0):
    gap = [math.floor((lightness * (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 + (p[2] - c[2]) ** 2) * 1e8 + 0.5) for c in labs]
    return gap.index(min(gap))


def contours(index, labs, mark):
    h, w = index.shape
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(labs[p], labs[q], strict=True)) >= 144
    strong = np.zeros((h, w), bool)
    for y, x in np.ndindex(h, w):
        strong[y, x] = any(far(index[y, x], index[p]) for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= p[0] < h and 0 <= p[1] < w)
    reach = max(1, round(mark * 0.10))
    wide = np.array([[strong[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1].any() for x in range(w)] for y in range(h)])
    return np.where(wide, best((35, 5, -15), labs, 1.5), index)


def grounded(index, labs, mark):
    region = flood(index)
    edge = {*region[0], *region[-1], *region[:, 0], *region[:, -1]}
    sizes = {r: int((region == r).sum()) for r in edge if (region == r).sum() >= max(1, math.ceil(4 * mark * mark))}
    if not sizes:
        return index
    field = min(sizes, key=lambda r: (-sizes[r], r))
    _, a, b = labs[index[region == field][0]]
    chroma = math.hypot(a, b)
    scale = 0.0 if chroma <= 1e-9 else min(0.35 * chroma, 25) / chroma
    return np.where(region == field, best((58, a * scale, b * scale), labs, 1.5), index)


def rendered(argb, style, cands):
    """Candidate colours of one image; ``cands`` are (argb, lab) in order."""
    size = MARK * style.mark_scale
    rgb = filtered(argb, max(round(size / 2), 1), style.value("edge"), int(style.value("strength")))
    keys = (rgb[..., 0] >> 2 << 12) | (rgb[..., 1] >> 2 << 6) | (rgb[..., 2] >> 2)
    centre = {int(k): lab_of(*(((int(k) >> s) & 63) * 4 + 2 for s in (12, 6, 0))) for k in np.unique(keys)}
    if style.abstract:
        samples = [(k, int((keys == k).sum()), *centre[k]) for k in centre]
        chosen = plain_palette(samples, [(i, *lab) for i, (_, lab) in enumerate(cands)], min(12, max(3, round(style.value("colours")))))
        cands = [cands[i] for i in chosen]
    labs = [lab for _, lab in cands]
    ceiling = max(math.hypot(a, b) for _, a, b in labs)
    of = {k: best(remapped(lab, style, ceiling) if style.remaps else lab, labs) for k, lab in centre.items()}
    index = np.vectorize(of.__getitem__)(keys)
    least = math.ceil(size * size)
    if style.name == "Fauvism":
        index = contours(index, labs, size)
    if style.name == "Abstract":
        index = grounded(index, labs, size)
    if style.name != "Realism":
        index = plain_merge(index, least)
    return np.array([[(int(argb[y, x]) & ~0xFFFFFF) | (cands[index[y, x]][0] & 0xFFFFFF) for x in range(argb.shape[1])] for y in range(argb.shape[0])])


@pytest.mark.parametrize("name", list(styles.STYLES))
def test_a_style_against_plain_pixels(spark, name):
    rng = np.random.default_rng(4)
    smooth = np.add.outer(np.arange(7) * 20, np.arange(9) * 17)
    grids = [rng.integers(0, 1 << 24, (7, 9)), (smooth << 16) | ((255 - smooth) << 8) | 90, np.where(smooth > 130, 0xE0D020, 0x203080) + rng.integers(0, 9, (7, 9))]
    grids = [np.asarray(g, np.int64) - (1 << 24) if i else np.asarray(g, np.int64) for i, g in enumerate(grids)]
    style, paints = styles.by_name(name), mixtures.palette(spark, [4, 9, 14])
    cands = mixtures.settled(styles.style_candidates(style, paints))
    rows = [(i, y, x, int(v)) for i, g in enumerate(grids) for (y, x), v in np.ndenumerate(g)]
    shown = {(r.image_id, r.y, r.x): r.argb for r in styles.render(spark.createDataFrame(rows, "image_id long, y int, x int, argb int"), style, cands, mark=MARK).collect()}
    listed = [(r.argb, (r.l, r.a, r.b)) for r in cands.orderBy("cand_idx").collect()]
    for i, g in enumerate(grids):
        want = rendered(g, style, listed)
        off = [at for at, v in np.ndenumerate(want) if shown[(i, *at)] != v]
        assert not off, (i, off[:5])
