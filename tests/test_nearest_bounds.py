"""Memory of the nearest search, dealing of the contour mask and of filtered images."""

import tracemalloc

import numpy as np

from tintframe.operators import filters, nearest


def test_many_points_of_a_cell_take_bounded_memory():
    rng = np.random.default_rng(3)
    cands, points = rng.uniform(6, 12, (4000, 3)), rng.uniform(6, 12, (6000, 3))
    grid = nearest.CandidateGrid(np.arange(len(cands)), cands)
    tracemalloc.start()
    got = grid.search(points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for at in range(0, 6000, 500):
        d = ((points[at] - cands) ** 2).sum(axis=1)
        assert got[at] == np.floor(d * 1e8 + 0.5).argmin()


def test_kept_cells_are_bounded_by_their_candidates(monkeypatch):
    monkeypatch.setattr(nearest, "KNOWN_PLACES", 300)
    rng = np.random.default_rng(4)
    grid = nearest.CandidateGrid(np.arange(2000), rng.uniform(0, 60, (2000, 3)))
    points = rng.uniform(0, 60, (400, 3))
    got = grid.search(points)
    assert grid.kept == sum(map(len, grid.known.values())) and (grid.kept <= 300 or len(grid.known) == 1)
    assert all(np.floor(((p - grid.lab) ** 2).sum(axis=1) * 1e8 + 0.5).argmin() == i for p, i in zip(points, got, strict=True))


def test_contour_mask_does_not_deal_pixels_by_candidate(spark):
    pixels = lambda n: spark.range(n).selectExpr("id div 100 as image_id", "cast(id % 100 div 10 as int) as y", "cast(id % 10 as int) as x", "cast(id % 2 as int) as cand_idx")
    cands = spark.createDataFrame([(0, 20.0, 0.0, 0.0), (1, 60.0, 0.0, 0.0)], "cand_idx int, l double, a double, b double")
    many = filters.contour_mask(pixels(1 << 40), cands)
    assert "hashpartitioning(cand_idx" not in many._jdf.queryExecution().executedPlan().toString()
    assert filters.contour_mask(pixels(400), cands).filter("boundary").count() == 400


def test_filters_take_more_tasks_for_more_pixels(spark, monkeypatch):
    monkeypatch.setattr(filters, "PIXELS_A_TASK", 100)
    pixels = spark.range(4000).selectExpr("id div 100 as image_id", "cast(id % 100 div 10 as int) as y", "cast(id % 10 as int) as x", "cast(id as int) as argb")
    assert filters.by_image(pixels).rdd.getNumPartitions() == 40
    assert filters.guided(pixels, radius=1, edge=0.1).count() == 4000
