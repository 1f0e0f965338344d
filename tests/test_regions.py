import numpy as np
import pytest

from tintframe.operators import filters, graph, regions


def pixels(spark, grid, image_id=0):
    rows = [(image_id, y, x, int(v)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, cand_idx int")


def back(df, shape, name="cand_idx"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def flood(grid):
    """Labels by a plain flood fill in row order."""
    out, n = np.full(grid.shape, -1), 0
    for y, x in np.ndindex(grid.shape):
        if out[y, x] < 0:
            todo = [(y, x)]
            while todo:
                p, q = todo.pop()
                if 0 <= p < grid.shape[0] and 0 <= q < grid.shape[1] and out[p, q] < 0 and grid[p, q] == grid[y, x]:
                    out[p, q] = n
                    todo += [(p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)]
            n += 1
    return out


def test_labels_against_flood_fill(spark):
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (1, 9), (7, 5), (12, 12)):
        grid = rng.integers(0, 3, shape)
        assert (back(regions.labels(pixels(spark, grid)), shape, "region_id") == flood(grid)).all()


def test_merging_leaves_no_small_region(spark):
    grid = np.add.outer(np.arange(5), np.arange(5)) % 2
    merged = back(regions.merge_small(pixels(spark, grid), 2.0), grid.shape)
    assert np.bincount(flood(merged).reshape(-1)).min() >= 4
    rng = np.random.default_rng(6)
    grid = rng.integers(0, 4, (10, 10))
    merged = back(regions.merge_small(pixels(spark, grid), 2.0), grid.shape)
    assert np.bincount(flood(merged).reshape(-1)).min() >= 4


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(8)
    edges = [(g, int(u), int(v)) for g, n in ((0, 30), (1, 90)) for u, v in rng.integers(0, 60, (n, 2))] + [(2, i, i + 1) for i in range(40)] + [(3, 0, i) for i in range(50)] + [(4, 5, 5)]
    root = {(g, x): (g, x) for g, *e in edges for x in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for g, u, v in edges:
        a, b = sorted((find((g, u)), find((g, v))))
        root[b] = a
    want = {n: find(n)[1] for n in root if find(n) != n}
    got = {(r.graph, r.node): r.root for r in graph.components(spark.createDataFrame(edges, "graph long, u long, v long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "graph long, u long, v long")).count() == 0


@pytest.mark.parametrize("tile", [1, 2, 3, 5, 64])
def test_tiles_against_whole_images(spark, tile):
    rng = np.random.default_rng(tile)
    spiral = np.zeros((9, 9), int)
    for i in range(0, 9, 2):
        spiral[i, (1 if i % 4 else 0) : (9 if i % 4 else 8)] = 1
    grids = [rng.integers(0, 2, (11, 7)), rng.integers(0, 3, (6, 13)), spiral, np.zeros((1, 1), int), np.ones((8, 8), int)]
    df = None
    for i, grid in enumerate(grids):
        one = pixels(spark, grid, i)
        df = one if df is None else df.union(one)
    tiled = regions.labels_tiled(df, tile)
    for i, grid in enumerate(grids):
        assert (back(tiled.filter(f"image_id = {i}"), grid.shape, "region_id") == flood(grid)).all()


def test_merging_on_the_graph_against_whole_images(spark):
    rng = np.random.default_rng(10)
    grids = [rng.integers(0, k, shape) for k, shape in ((2, (9, 9)), (4, (12, 5)), (6, (8, 8)))] + [np.zeros((3, 3), int), np.array([[1, 2]])]
    df = None
    for i, grid in enumerate(grids):
        one = pixels(spark, grid, i)
        df = one if df is None else df.union(one)
    for mark in (1.0, 2.0, 3.5):
        for labelled in (regions.labels(df), regions.labels_tiled(df, 4)):
            merged = regions.merge_regions(labelled, mark).persist()
            for i, grid in enumerate(grids):
                assert (back(merged.filter(f"image_id = {i}"), grid.shape) == regions.merge_grid(grid, int(np.ceil(mark * mark)))).all()
            merged.unpersist()


def plain_merge(grid, least):
    """Merging by flood fills over and over, without a graph."""
    first = flood(grid)
    region, value = first.copy(), {int(r): int(grid[first == r][0]) for r in np.unique(first)}
    while True:
        sizes = {int(r): int((region == r).sum()) for r in np.unique(region)}
        for r in sorted((r for r, n in sizes.items() if n < least), key=lambda r: (sizes[r], r)):
            beside = {int(q) for (y, x), own in np.ndenumerate(region) if own == r for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= p[0] < grid.shape[0] and 0 <= p[1] < grid.shape[1] and (q := region[p]) != r}
            if beside:
                region[region == r] = min(beside, key=lambda q: (sizes[q] < least, -sizes[q], q))
                break
        else:
            return np.vectorize(value.__getitem__)(region)


def test_merging_against_repeated_fills():
    rng = np.random.default_rng(13)
    for k, shape, least in ((2, (6, 6), 4), (3, (7, 4), 5), (4, (5, 8), 3), (5, (6, 6), 9)):
        for _ in range(6):
            grid = rng.integers(0, k, shape)
            assert (regions.merge_grid(grid, least) == plain_merge(grid, least)).all()


def test_a_mark_of_one_changes_nothing(spark):
    grid = np.eye(4, dtype=int)
    assert (back(regions.merge_small(pixels(spark, grid), 1.0), grid.shape) == grid).all()


def test_areas_and_small_share(spark):
    labelled = regions.labels(pixels(spark, [[0, 0, 1], [0, 2, 1]]))
    assert sorted((r.region_id, r.area) for r in regions.areas(labelled).collect()) == [(0, 3), (1, 2), (2, 1)]
    assert regions.count_regions(labelled).first().regions == 3
    assert regions.small_fraction(labelled, 3).first().fraction == 0.5


def test_dilation_is_a_square(spark):
    grid = np.zeros((7, 7), int)
    grid[3, 2] = 1
    df = pixels(spark, grid).selectExpr("image_id", "y", "x", "cand_idx = 1 AS on")
    out = back(filters.dilate(df, "on", 1).selectExpr("y", "x", "int(on) AS on"), grid.shape, "on")
    want = np.zeros_like(grid)
    want[2:5, 1:4] = 1
    assert (out == want).all()


def test_box_mean_is_cut_at_the_border(spark):
    rng = np.random.default_rng(7)
    grid = rng.random((6, 9))
    rows = [(0, y, x, float(v)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    df = filters.box(spark.createDataFrame(rows, "image_id long, y int, x int, v double"), ["v"], 2)
    for r in df.collect():
        assert abs(r.v - grid[max(0, r.y - 2) : r.y + 3, max(0, r.x - 2) : r.x + 3].mean()) < 1e-12


def test_filters_are_the_same_dealt_by_image_or_not(spark):
    rng = np.random.default_rng(21)
    rows = [(i, y, x, int(rng.integers(0, 1 << 24)) - (1 << 24)) for i in range(3) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, argb int")
    same = lambda f: sorted(map(tuple, f(True).collect())) == sorted(map(tuple, f(False).collect()))
    assert same(lambda whole: filters.guided(df, radius=2, edge=0.1, iterations=2, whole=whole))
    assert same(lambda whole: filters.gaussian(df, 2, whole=whole))
    plan = filters.gaussian(filters.guided(df, radius=2, edge=0.1, iterations=3), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(image_id") <= 2
