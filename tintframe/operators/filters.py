"""Image filters as windows over rows and columns: box, guided, Gaussian, dilation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color


#: Pixels that a task filters, on average: each of its sorts, a dozen for a style, holds them.
PIXELS_A_TASK = 200_000


def axes() -> tuple[WindowSpec, WindowSpec]:
    """Windows along an image's rows and along its columns."""
    return W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")


def by_image(pixels: DataFrame, whole: bool = True) -> DataFrame:
    """``pixels`` dealt so that all windows of a filter find theirs together, in one shuffle.

    ``whole`` deals an image to one task, which sorts it anew for each axis and spills what does
    not fit. That suits many images; with few and very large ones it is better off, and rows
    and columns are dealt apart at every step. Tasks grow in number with the pixels, which are
    counted: Spark's own merging of partitions goes by their packed size, a fraction of a sort's.
    """
    if not whole:
        return pixels
    tasks = math.ceil(pixels.count() / PIXELS_A_TASK)
    return pixels.repartition(max(pixels.sparkSession.sparkContext.defaultParallelism, tasks), "image_id")


def box(pixels: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Replace columns by their mean over a square, cut at the image's border."""
    for window in axes():
        frame = window.rowsBetween(-radius, radius)
        pixels = pixels.withColumns({n: F.avg(n).over(frame) for n in names})
    return pixels


def to_linear(pixels: DataFrame) -> DataFrame:
    """Add ``lr, lg, lb``, the linear light of ``argb``."""
    _, *rgb = color.channels(F.col("argb"))
    return pixels.withColumns({n: color.byte_to_linear(c) for n, c in zip(("lr", "lg", "lb"), rgb, strict=True)})


def from_linear(pixels: DataFrame) -> DataFrame:
    """Encode ``lr, lg, lb`` into ``argb``, keeping alpha, and drop them."""
    alpha = color.channels(F.col("argb"))[0]
    return pixels.withColumn("argb", color.pack(alpha, *(color.linear_to_byte(F.col(c)) for c in ("lr", "lg", "lb")))).drop("lr", "lg", "lb")


def guided(pixels: DataFrame, *, radius: int, edge: float, iterations: int = 1, whole: bool = True) -> DataFrame:
    """Self-guided edge-preserving filter of ``argb`` in linear light; :func:`by_image` tells of ``whole``."""
    if radius < 1 or iterations < 1:
        return pixels
    names = ["lr", "lg", "lb"]
    out = to_linear(by_image(pixels, whole))
    for _ in range(iterations):
        out = box(out.withColumns({f"m_{n}": F.col(n) for n in names} | {f"q_{n}": F.col(n) * F.col(n) for n in names}), [f"{p}_{n}" for p in "mq" for n in names], radius)
        slope = {n: F.greatest(F.col(f"q_{n}") - F.col(f"m_{n}") * F.col(f"m_{n}"), F.lit(0.0)) for n in names}
        out = out.withColumns({f"q_{n}": v / (v + edge * edge) for n, v in slope.items()})
        out = out.withColumns({f"m_{n}": (1 - F.col(f"q_{n}")) * F.col(f"m_{n}") for n in names})
        out = box(out, [f"{p}_{n}" for p in "mq" for n in names], radius)
        out = out.withColumns({n: F.col(f"q_{n}") * F.col(n) + F.col(f"m_{n}") for n in names}).drop(*(f"{p}_{n}" for p in "mq" for n in names))
    return from_linear(out)


def gaussian_kernel(radius: int) -> list[float]:
    raw = [math.exp(-(o * o) / (2 * (radius / 3) ** 2)) for o in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def gaussian(pixels: DataFrame, radius: int, *, whole: bool = True) -> DataFrame:
    """Separable Gaussian blur of ``argb`` in linear light, border pixels repeated outwards."""
    if radius < 1:
        return pixels
    kernel, names = gaussian_kernel(radius), ["lr", "lg", "lb"]
    out = to_linear(by_image(pixels, whole))
    for window in axes():
        line = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        sums = {}
        for n in names:
            first, last = F.first(n).over(line), F.last(n).over(line)
            near = lambda o: F.coalesce(F.lag(n, -o).over(window), first) if o < 0 else F.coalesce(F.lead(n, o).over(window), last) if o else F.col(n)  # noqa: B023, E731
            sums[n] = sum(F.lit(k) * near(o) for o, k in enumerate(kernel, -radius))
        out = out.withColumns(sums)
    return from_linear(out)


def dilate(pixels: DataFrame, name: str, radius: int) -> DataFrame:
    """Widen a boolean column to every pixel within a square of ``radius``."""
    for window in axes():
        pixels = pixels.withColumn(name, F.max(name).over(window.rowsBetween(-radius, radius)))
    return pixels


def contour_mask(indexed: DataFrame, cands: DataFrame, least: float = 12.0) -> DataFrame:
    """Add ``boundary``: whether a 4-neighbour's colour is ``least`` or more away in Lab.

    The candidates' table has a bounded size, ``MOST_CANDIDATES`` rows for one palette, and is
    broadcast: dealt by candidate, the pixels of a common one would all meet in one task.
    """
    side = cands.select("cand_idx", *(F.col(c).alias(f"c_{c}") for c in "lab"))
    out = indexed.join(F.broadcast(side), "cand_idx")
    strong = F.lit(False)
    for window in axes():
        for step in (-1, 1):
            other = tuple(F.lag(f"c_{c}", 1).over(window) if step < 0 else F.lead(f"c_{c}", 1).over(window) for c in "lab")
            strong = strong | F.coalesce(color.squared_distance(tuple(F.col(f"c_{c}") for c in "lab"), other) >= least * least, F.lit(False))
    return out.withColumn("boundary", strong).drop("c_l", "c_a", "c_b")


def downsample(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Box average by covered area. ``sizes``: image_id, width, height, to_width, to_height.

    Every source pixel goes to the one to four targets it overlaps; no row meets more.
    """
    joined = pixels.join(sizes, "image_id")
    spread = joined
    for at, n, to, name in (("x", "width", "to_width", "ox"), ("y", "height", "to_height", "oy")):
        ratio = F.col(n) / F.col(to)
        spread = spread.withColumn(name, F.explode(F.sequence(F.floor(F.col(at) / ratio).cast("int"), F.least(F.col(to) - 1, F.ceil((F.col(at) + 1) / ratio).cast("int") - 1))))
        spread = spread.withColumn(f"w_{at}", F.least((F.col(name) + 1) * ratio, F.col(at) + 1.0) - F.greatest(F.col(name) * ratio, F.col(at).cast("double")))
    weighed = spread.withColumn("w", F.col("w_x") * F.col("w_y")).filter("w_x > 0 and w_y > 0")
    mean = {n: F.sum(F.col("w") * c) / F.sum("w") for n, c in zip("argb", color.channels(F.col("argb")), strict=True)}
    level = lambda c: F.floor(c + 1e-9 + 0.5).cast("int")
    return weighed.groupBy("image_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(color.pack(*(level(mean[c]) for c in "argb")).alias("argb"))


def preview_size(width: int, height: int, most: int = 384) -> tuple[int, int]:
    """Size of a preview: fitted into ``most`` pixels, never larger than the image."""
    scale = min(1.0, most / max(width, height))
    return tuple(max(1, round(n * scale)) for n in (width, height))
