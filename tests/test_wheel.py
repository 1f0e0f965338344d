import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.functions import pigments
from tintframe.operators import mixtures, recipes, wheel
from tintframe.sources import decoders


def shares(y, x, diameter, n):
    """What a point of a wheel of ``n`` paints is made of, and how much of it is covered."""
    dx, dy, radius = x - (diameter - 1) / 2, y - (diameter - 1) / 2, diameter / 2
    distance = math.hypot(dx, dy)
    rim = min(1.0, distance / radius)
    at = (math.atan2(dy, dx) % (2 * math.pi)) * n / (2 * math.pi)
    lower = int(at) % n
    out = [(1 - rim) / n] * n
    out[lower] += rim * (1 - (at - int(at)))
    out[(lower + 1) % n] += rim * (at - int(at))
    return out, max(0.0, min(1.0, radius - distance))


def test_points_of_several_wheels(spark):
    points = wheel.disc(spark, 7).union(wheel.disc(spark, 12)).withColumnRenamed("y", "y")
    got = {}
    for r in wheel.weights(points, 5).collect():
        got.setdefault((r.diameter, r.y, r.x), {})[r.paint] = r.weight
    for d in (7, 12):
        for y, x in np.ndindex(d, d):
            want, cover = shares(y, x, d, 5)
            if cover > 0:
                assert [got[d, y, x][i] for i in range(5)] == pytest.approx(want)
                assert sum(want) == pytest.approx(1)
            else:
                assert (d, y, x) not in got
    with pytest.raises(ValueError):
        wheel.disc(spark, 1)


def test_three_things_mixed_are_all_paints_mixed(spark):
    paints = mixtures.palette(spark, [2, 6, 9, 14])
    k, s = (np.array([pigments.PALETTE[i][c] for i in (2, 6, 9, 14)]) for c in (4, 5))
    shown = {(r.y, r.x): r.argb for r in wheel.paint_wheel(wheel.disc(spark, 9), paints).collect()}
    each = []
    for y, x in np.ndindex(9, 9):
        weight, cover = shares(y, x, 9, 4)
        if cover > 0:
            each.append((y * 9 + x, [(i, w) for i, w in zip((2, 6, 9, 14), weight, strict=True)]))
            assert (shown[y, x] >> 24) & 255 == int(cover * 255)
        else:
            assert shown[y, x] == 0
    df = spark.createDataFrame(each, "ordinal long, parts array<struct<paint_idx: int, share: double>>")
    for r in mixtures.render(mixtures.mix(df, paints)).collect():
        assert r.argb & 0xFFFFFF == shown[divmod(r.ordinal, 9)] & 0xFFFFFF
        weight, _ = shares(*divmod(r.ordinal, 9), 9, 4)
        assert recipes._lab_of(np.array([weight]), k, s)[0] == pytest.approx([r.l, r.a, r.b], abs=1e-9)
    assert {r.argb for r in wheel.paint_wheel(wheel.disc(spark, 3), paints.limit(0)).collect()} == {0}


def test_lines_of_both_wheels(spark):
    paints = mixtures.palette(spark, [2, 6, 9, 14, 15, 16, 17])
    points = spark.createDataFrame([(1, 4, 4, 9), (2, 4, 8, 9), (3, 0, 0, 9)], "id long, y int, x int, diameter int")
    told = {}
    for r in wheel.lines(points, paints).orderBy("id", "rank").collect():
        told.setdefault(r.id, []).append(r.line)
    names = [pigments.PALETTE[i][1] for i in (2, 6, 9, 14, 15, 16, 17)]
    assert told[1] == [f"{n}: 14%" for n in names[:5]] + ["+2 more: 29%"]
    assert told[2][0].startswith(f"{names[0]}: ") and 3 not in told
    hues = {r.id: r.line for r in wheel.hue_lines(points).collect()}
    assert hues[1] == "RGB: 255, 255, 255" and hues[2].startswith("RGB: ") and 3 not in hues


def test_wheel_files_hold_the_wheels(spark):
    paints = mixtures.palette(spark, [2, 6, 9])
    files = {r.name: bytes(r.content) for r in wheel.files(spark, {"small": 5, "large": 8}, paints).collect()}
    assert files.keys() == {"small.png", "large.png"}
    for name, d in (("small.png", 5), ("large.png", 8)):
        px = decoders.decode_png(files[name])
        assert {(r.y, r.x): r.argb for r in wheel.paint_wheel(wheel.disc(spark, d), paints).collect()} == {at: int(v) for at, v in np.ndenumerate(px)}


def test_lines_of_a_point_are_told_within_its_row(spark):
    paints = mixtures.palette(spark, [1, 4, 9, 14])
    points = wheel.disc(spark, 9).withColumn("id", F.col("y").cast("long") * 9 + F.col("x"))
    told = wheel.lines(points, paints)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    # the same from rows of weights
    at = F.element_at(F.array(*map(F.lit, [1, 4, 9, 14])), F.col("paint") + 1)
    rows = recipes.wheel_lines(wheel.weights(points, 4).select("id", at.alias("paint_idx"), "weight"), paints)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, rows.collect())) != []
