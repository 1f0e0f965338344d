"""Image palettes: colour histogram, weighted k-means with fixed steps, palette selection.

A histogram has at most 262,144 rows an image, whatever the image's size, so one task takes
an image's histogram whole; images are dealt over all tasks, which take many small ones at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from . import batches
from .nearest import CandidateGrid, collected, lab_of

LLOYD_STEPS = 6


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, colour_key, weight, l, a, b: pixels per image and 18-bit key."""
    _, r, g, b = color.channels(F.col("argb"))
    counted = pixels.groupBy("image_id", color.quantise(r, g, b).alias("colour_key")).agg(F.count("*").alias("weight"))
    lab = color.rgb_to_lab(*color.key_to_rgb(F.col("colour_key")))
    return counted.select("*", *(c.alias(n) for c, n in zip(lab, "lab", strict=True)))


def lloyd(lab: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int, steps: int = LLOYD_STEPS) -> np.ndarray:
    """Centres, ``k`` an image, of images' samples; the seeds are evenly spaced among them.

    Images' samples, which lie from each of ``starts`` to the next, come by lightness. An empty
    centre stays where it is.
    """
    sizes = np.diff(starts)
    image = np.repeat(np.arange(len(sizes)), sizes)
    centres = lab[starts[:-1, None] + np.arange(k) * (sizes[:, None] - 1) // max(k - 1, 1)]
    owner = np.empty(len(lab), np.int64)
    for _ in range(steps):
        for lo in range(0, len(lab), 4096):
            some = slice(lo, lo + 4096)
            gap = sum(w * (lab[some, None, c] - centres[image[some], :, c]) ** 2 for c, w in enumerate((1.5, 1.0, 1.0)))
            owner[some] = image[some] * k + np.floor(gap * 1e8 + 0.5).argmin(axis=1)
        total = np.bincount(owner, weight, len(sizes) * k)
        mean = np.stack([np.bincount(owner, weight * lab[:, c], len(sizes) * k) for c in range(3)], axis=1) / np.maximum(total, 1)[:, None]
        centres = np.where(total[:, None] > 0, mean, centres.reshape(-1, 3)).reshape(len(sizes), k, 3)
    return centres


def _samples(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lab and weights of images' histograms, and where each image's start."""
    return lab_of(table), table["weight"].to_numpy().astype(np.float64), batches.starts_of(table, ["image_id"])


def _by_image(samples: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` on images' samples by lightness, ties by key."""
    typed = samples.select(F.col("image_id").cast("long"), "colour_key", "weight", "l", "a", "b")
    return batches.map_groups(typed, ["image_id"], ["l", "colour_key"], run, ddl)


def kmeans(samples: DataFrame, k: int, steps: int = LLOYD_STEPS) -> DataFrame:
    """image_id, centre, l, a, b: ``k`` centres of each image after a fixed number of steps."""

    def run(table: pa.Table) -> pa.Table:
        lab, weight, starts = _samples(table)
        centres = lloyd(lab, weight, starts, k, steps).reshape(-1, 3)
        image = pa.array(np.repeat(table["image_id"].to_numpy()[starts[:-1]], k), pa.int64())
        return pa.table({"image_id": image, "centre": pa.array(np.tile(np.arange(k), len(starts) - 1), pa.int32()), **{c: pa.array(centres[:, i]) for i, c in enumerate("lab")}})

    return _by_image(samples, run, "image_id long, centre int, l double, a double, b double")


def choose(lab: np.ndarray, weight: np.ndarray, starts: np.ndarray, grid: CandidateGrid, k: int) -> list[list[int]]:
    """Places of the candidates for each image: lightest, darkest and nearest to k centres.

    If fewer than k were found the list is filled up from the samples by lightness, then from
    the candidates in order. With k candidates or fewer they all stay.
    """
    if len(grid.index) <= k:
        return [[*range(len(grid.index))] for _ in starts[1:]]
    light = grid.lab[:, 0]
    ends = {int(light.argmax()), int(light.argmin())}
    place = lambda found: np.searchsorted(grid.index, found).tolist()  # noqa: E731  a grid's index is in order
    near = place(grid.search(lloyd(lab, weight, starts, k).reshape(-1, 3)))
    out = []
    for i, (first, end) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        chosen = ends | set(near[i * k : (i + 1) * k])
        for lo in range(first, end, 1024):
            if len(chosen) >= k:
                break
            for at in place(grid.search(lab[lo : min(end, lo + 1024)])):
                if len(chosen) < k:
                    chosen.add(at)
        for at in range(len(grid.index)):
            if len(chosen) >= k:
                break
            chosen.add(at)
        out.append(sorted(chosen))
    return out


def image_palette(pixels: DataFrame, cands: DataFrame, size: float = 8) -> DataFrame:
    """image_id, cand_idx, argb, l, a, b: each image's candidates for an abstract of it.

    ``k`` is ``size`` rounded and held to 3 to 12; up to ``k + 2`` candidates an image come
    out, numbered anew in their order. Images do not depend on each other.
    """
    k = min(12, max(3, round(size)))
    table = collected(cands.select("cand_idx", "argb", "l", "a", "b"))
    argb = dict(zip(table["cand_idx"].to_pylist(), table["argb"].to_pylist(), strict=True))
    grid = pixels.sparkSession.sparkContext.broadcast(CandidateGrid(np.asarray(table["cand_idx"]).astype(np.int64), lab_of(table), 1.5))
    shown = pixels.sparkSession.sparkContext.broadcast(argb)

    def run(samples: pa.Table) -> pa.Table:
        lab, weight, starts = _samples(samples)
        places = choose(lab, weight, starts, grid.value, k)
        flat, sizes = np.concatenate(places).astype(np.int64), [len(p) for p in places]
        image = pa.array(np.repeat(samples["image_id"].to_numpy()[starts[:-1]], sizes), pa.int64())
        number = np.concatenate([np.arange(n) for n in sizes])
        lab = grid.value.lab[flat]
        return pa.table({"image_id": image, "cand_idx": pa.array(number, pa.int32()), "argb": pa.array([shown.value[int(i)] for i in grid.value.index[flat]], pa.int32()), **{c: pa.array(lab[:, i]) for i, c in enumerate("lab")}})

    return _by_image(histogram(pixels), run, "image_id long, cand_idx int, argb int, l double, a double, b double")
