"""Colour wheels: blends of a palette over a disc, and the artists' hue wheel.

Wheels are given as points: ``y, x, diameter`` with any other columns, which are kept.
:func:`disc` has all points of one wheel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, pigments
from ..sources import images
from . import mixtures, recipes

# Display hue at every sixth of the artists' red-yellow-blue wheel.
DISPLAY_HUES = (0.0, 30.0, 60.0, 120.0, 240.0, 285.0, 360.0)


def disc(spark: SparkSession, diameter: int) -> DataFrame:
    """y, x, diameter of a square of pixels."""
    if diameter < 2:
        raise ValueError("a wheel is at least 2 pixels wide")
    return spark.range(diameter * diameter).select(F.floor(F.col("id") / diameter).cast("int").alias("y"), (F.col("id") % diameter).cast("int").alias("x"), F.lit(diameter).alias("diameter"))


def _placed(points: DataFrame) -> DataFrame:
    """``points`` with dx, dy and distance from the middle of their wheel."""
    centre = (F.col("diameter") - 1) / 2.0
    moved = points.withColumns({"dx": F.col("x") - centre, "dy": F.col("y") - centre})
    return moved.withColumn("distance", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def wedges(points: DataFrame, paints: int) -> DataFrame:
    """``points`` with alpha, lower, upper, lower_share, upper_share and centre_share.

    The shares of the two rim paints come on top of ``centre_share``, which all paints have
    together. Outside the disc alpha is 0.
    """
    radius = F.col("diameter") / 2.0
    base = _placed(points).withColumn("alpha", color.clamp(radius - F.col("distance"), 0, 1))
    angle = F.atan2("dy", "dx")
    position = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle) * paints / (2 * math.pi)
    whole = F.floor(position).cast("int")
    turned = base.withColumn("lower", F.when(whole >= paints, 0).otherwise(whole)).withColumn("blend", F.when(whole >= paints, 0.0).otherwise(position - whole))
    rim = F.least(F.col("distance") / radius, F.lit(1.0))
    return turned.select(*points.columns, "alpha", "lower", ((F.col("lower") + 1) % paints).alias("upper"), (rim * (1 - F.col("blend"))).alias("lower_share"), (rim * F.col("blend")).alias("upper_share"), (1 - rim).alias("centre_share"))


def weights(points: DataFrame, paints: int) -> DataFrame:
    """``points`` inside the disc with ``paint, weight``, a row for every paint."""
    at = wedges(points, paints).filter("alpha > 0").withColumn("paint", F.explode(F.sequence(F.lit(0), F.lit(paints - 1))))
    own = lambda c: F.when(F.col("paint") == F.col(c), F.col(f"{c}_share")).otherwise(0.0)
    return at.select(*points.columns, "paint", (F.col("centre_share") / paints + own("lower") + own("upper")).alias("weight"))


def paint_wheel(points: DataFrame, paints: DataFrame) -> DataFrame:
    """``points`` with argb: the palette's blends, 0 outside the disc and without paints.

    A point mixes three things whatever the palette's size: the mean of all paints, worked out
    once, and its two rim paints.
    """
    listed = paints.orderBy("paint_idx").limit(mixtures.MOST_PAINTS).collect()
    if not listed:
        return points.withColumn("argb", F.lit(0))
    mean = [[sum(p[c][b] for p in listed) / len(listed) for b in range(pigments.BANDS)] for c in "ks"]
    table = points.sparkSession.createDataFrame([(i, p.k, p.s) for i, p in enumerate(listed)] + [(-1, *mean)], "paint_idx int, k array<double>, s array<double>")
    part = lambda c, s: F.struct(c.cast("int").alias("paint_idx"), F.col(s).alias("share"))
    parts = F.array(part(F.lit(-1), "centre_share"), part(F.col("lower"), "lower_share"), part(F.col("upper"), "upper_share"))
    keyed = wedges(points, len(listed)).select(F.struct(*points.columns, "alpha").alias("ordinal"), parts.alias("parts"))
    shown = mixtures.render(mixtures.mix(keyed, table)).select("ordinal.*", "argb")
    solid = F.shiftleft(F.floor(F.col("alpha") * 255).cast("int"), 24).bitwiseOR(F.col("argb").bitwiseAND(F.lit(0xFFFFFF)))
    return shown.select(*points.columns, F.when(F.col("alpha") > 0, solid).otherwise(0).alias("argb"))


def display_hue(artist_hue: Column) -> Column:
    sixth = F.least(F.lit(5), F.floor(artist_hue / 60).cast("int"))
    hues = F.array(*map(F.lit, DISPLAY_HUES))
    low, high = F.element_at(hues, sixth + 1), F.element_at(hues, sixth + 2)
    return low + (high - low) * (artist_hue - sixth * 60.0) / 60.0


def traditional_wheel(points: DataFrame) -> DataFrame:
    """``points`` with argb of the artists' hue wheel, white in the middle."""
    radius = F.col("diameter") / 2.0
    hue = F.degrees(F.atan2(F.col("dx"), -F.col("dy")))
    cover = color.clamp(radius + 0.5 - F.col("distance"), 0, 1)
    shown = color.hsv_to_argb(display_hue(F.when(hue < 0, hue + 360).otherwise(hue)), F.least(F.lit(1.0), F.col("distance") / radius), F.rint(cover * 255))
    return _placed(points).select(*points.columns, F.when(cover > 0, shown).otherwise(0).alias("argb"))


def lines(points: DataFrame, paints: DataFrame, named: int = 5) -> DataFrame:
    """id, rank, line: what is told of the points ``id, y, x, diameter`` of a paint wheel.

    The largest shares by name and the rest in a last line; nothing outside the disc. A point
    has all it needs in its row, so nothing is shuffled or sorted.
    """
    listed = paints.select("paint_idx", "name", F.row_number().over(mixtures.library_order()).alias("n")).orderBy("n").limit(mixtures.MOST_PAINTS).collect()
    if not listed:
        return points.sparkSession.createDataFrame([], "id long, rank int, line string")
    own = lambda c, i: F.when(F.lit(i) == F.col(c), F.col(f"{c}_share")).otherwise(0.0)
    weight = lambda i: F.col("centre_share") / len(listed) + own("lower", i) + own("upper", i)
    parts = F.array(*(F.struct(F.lit(p.paint_idx).alias("paint_idx"), F.lit(p.name).alias("name"), weight(i).alias("weight")) for i, p in enumerate(listed)))
    return wedges(points, len(listed)).filter("alpha > 0").select("id", parts.alias("parts")).select("id", F.inline(recipes.largest_lines(F.col("parts"), named)))


def hue_lines(points: DataFrame) -> DataFrame:
    """id, rank, line: of the artists' wheel only the colour is told; nothing outside the disc."""
    seen = traditional_wheel(points).filter(F.shiftrightunsigned("argb", 24) != 0)
    return seen.select("id", F.lit(1).alias("rank"), recipes.rgb_line(F.col("argb")).alias("line"))


def files(spark: SparkSession, diameters: dict[str, int], paints: DataFrame) -> DataFrame:
    """name, content: a PNG of the palette's wheel for each name, as the ``images`` sink takes them."""
    every = [disc(spark, d).withColumn("name", F.lit(name)) for name, d in diameters.items()]
    points = every[0]
    for more in every[1:]:
        points = points.union(more)
    names = {name: i for i, name in enumerate(diameters)}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("name")).cast("long")
    drawn = images.encode_png(paint_wheel(points, paints).withColumn("image_id", number))
    called = F.element_at(F.array(*map(F.lit, names)), (F.col("image_id") + 1).cast("int"))
    return drawn.select(F.concat(called, F.lit(".png")).alias("name"), "content")
