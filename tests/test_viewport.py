import random

import pytest
from pyspark.sql import functions as F

from tintframe.operators import viewport

DDL = "key long, at long, generation long, kind string, p double, q double, r double, width double, height double, view_width double, view_height double"


def test_a_fitted_view_is_centred():
    v = viewport.View(400, 200, 800, 600)
    assert v.scale == 2 and v.offset == (0, 100)
    v.zoom(100, (400, 300))
    assert v.scale == 32 and v.offset == (400 - 200 * 32, 300 - 100 * 32)
    v.zoom(0.0001, (0, 0))
    assert v.scale == 2 and v.offset == (0, 100)


def test_the_point_under_the_anchor_stays():
    rng = random.Random(1)
    for _ in range(200):
        v = viewport.View(rng.uniform(10, 3000), rng.uniform(10, 3000), 800, 600)
        v.zoom(rng.uniform(1, 9), (rng.uniform(0, 800), rng.uniform(0, 600)))
        if all(n * v.scale > r for n, r in zip(v.size, v.room, strict=True)):
            anchor = (rng.uniform(200, 600), rng.uniform(200, 400))
            before = [(a - o) / v.scale for a, o in zip(anchor, v.offset, strict=True)]
            v.zoom(1.1, anchor)
            if v.scale < 15.9 * viewport.fit_scale(*v.size, *v.room):
                assert [(a - o) / v.scale for a, o in zip(anchor, v.offset, strict=True)] == pytest.approx(before)


def test_the_image_never_leaves_the_view():
    rng = random.Random(2)
    v = viewport.View(1000, 300, 640, 480)
    for _ in range(500):
        rng.choice([lambda: v.zoom(rng.uniform(0.3, 3), (rng.uniform(0, 640), rng.uniform(0, 480))), lambda: v.pan((rng.uniform(-900, 900), rng.uniform(-900, 900))), lambda: v.resize(rng.uniform(50, 900), rng.uniform(50, 900))])()
        least = viewport.fit_scale(*v.size, *v.room)
        assert least <= v.scale <= max(16 * least, v.scale)
        for o, n, r in zip(v.offset, v.size, v.room, strict=True):
            assert (o <= 1e-9 and o + n * v.scale >= r - 1e-9) if n * v.scale > r else o == pytest.approx((r - n * v.scale) / 2)


def test_sessions_are_folded_in_order(spark):
    rng = random.Random(3)
    rows = []
    for key in range(4):
        sizes = (rng.uniform(50, 2000), rng.uniform(50, 2000), 800.0, 600.0)
        for i in range(60):
            rows.append((key, i // 2, key * 100 + i, rng.choice(["zoom", "pan", "resize", "fit", "other", None]), rng.uniform(0.2, 300), rng.uniform(1, 300), rng.uniform(0, 300), *sizes))
    rows += [(9, 0, 900, "zoom", 2.0, 1.0, 1.0, 0.0, 10.0, 5.0, 5.0), (10, 0, 901, "pan", None, None, None, None, None, None, None)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {(r.key, r.generation): (r.scale, r.offset_x, r.offset_y) for r in viewport.views(spark.createDataFrame(shuffled, DDL).repartition(5)).collect()}
    held = {}
    for key, _, generation, kind, p, q, r, *sizes in rows:
        v = held.setdefault(key, viewport.View(*(x or 0.0 for x in sizes)))
        {"zoom": lambda: v.zoom(p, (q, r)), "pan": lambda: v.pan((p or 0, q or 0)), "resize": lambda: v.resize(p, q), "fit": v.fit}.get(kind, lambda: None)()  # noqa: B023
        assert got[key, generation] == pytest.approx((v.scale, *v.offset))
    assert len(got) == len(rows) and viewport.views(spark.createDataFrame([], DDL)).count() == 0


def test_pixels_under_points(spark):
    v = viewport.View(10, 5, 100, 100)
    at = spark.createDataFrame([(0.0, 25.0), (99.9, 74.9), (100.0, 50.0), (5.0, 24.9), (55.0, 40.0)], "px double, py double")
    x, y = viewport.pixel_under(F.col("px"), F.col("py"), F.lit(10), F.lit(5), F.lit(v.scale), F.lit(v.offset[0]), F.lit(v.offset[1]))
    assert [tuple(r) for r in at.select(x, y).collect()] == [(0, 0), (9, 4), (None, None), (None, None), (5, 1)]
