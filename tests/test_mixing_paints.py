import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.functions import pigments
from tintframe.operators import mixtures, nearest, palette, recipes
from tintframe.plans import catalogue


@pytest.mark.parametrize(("paints", "rows"), [([5], 1), ([4, 9], 65), ([4, 9, 14], 297), ([1, 4, 7, 10, 13, 14], 3051)])
def test_number_of_mixtures(spark, paints, rows):
    every = mixtures.enumerate_mixtures(mixtures.palette(spark, paints))
    assert every.count() == rows == every.select("ordinal").distinct().count()
    off = every.filter(F.abs(F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["share"]) - 1) > 1e-12)
    assert off.count() == 0


def test_a_mother_colour_keeps_shares_whole(spark):
    every = mixtures.blend_into(mixtures.enumerate_mixtures(mixtures.palette(spark, [4, 9])), 9, 0.25)
    totals = every.select(F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["share"]).alias("t"))
    assert all(r.t == pytest.approx(1) for r in totals.collect())
    with pytest.raises(ValueError):
        mixtures.blend_into(every, 9, 1.5)


def test_keeping_falls_back_to_everything(spark):
    cands = mixtures.candidates(mixtures.palette(spark, [4, 9])).persist()
    assert mixtures.keep_only(cands, F.col("l") > 1000).count() == cands.count()
    assert 0 < mixtures.keep_only(cands, F.col("l") > 80).count() < cands.count()


def test_nearest_against_all_pairs(spark):
    cands = mixtures.candidates(mixtures.palette(spark, [4, 9, 14])).persist()
    listed = np.array([(r.l, r.a, r.b) for r in cands.orderBy("cand_idx").collect()])
    rng = np.random.default_rng(2)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform((0, -60, -60), (100, 60, 60), (200, 3)))]
    df = spark.createDataFrame(points, "id long, l double, a double, b double")
    for weight in (1.0, 1.5):
        found = {r.id: r.cand_idx for r in nearest.nearest(df, cands, key="id", lightness=weight).collect()}
        for i, *p in points:
            gap = ((listed - p) ** 2 * (weight, 1, 1)).sum(axis=1)
            assert gap[found[i]] <= gap.min() + 1e-8


def test_a_paint_is_its_own_best_recipe(spark):
    paints = mixtures.palette(spark, [2, 5, 9, 13, 17])
    own = mixtures.mix(paints.select(F.col("paint_idx").alias("own"), F.array(F.struct("paint_idx", F.lit(1.0).alias("share"))).alias("parts")), paints, "own")
    lab = mixtures.render(own).select(F.col("own").cast("long").alias("id"), "l", "a", "b")
    for r in recipes.closest_blends(lab, paints).collect():
        assert r.paints == [r.id] and r.shares == [1.0] and r.distance < 1e-6


def test_recipes_recover_known_mixtures(spark):
    paints = mixtures.palette(spark, [4, 9, 14])
    ladder = [(4, 9, 0.5), (9, 14, 0.25), (4, 14, 0.75)]
    rows = [(i, [(p, s), (q, 1 - s)]) for i, (p, q, s) in enumerate(ladder)]
    mixed = mixtures.mix(spark.createDataFrame(rows, "id long, parts array<struct<paint_idx: int, share: double>>"), paints, "id")
    for r in recipes.closest_blends(mixtures.render(mixed).select("id", "l", "a", "b"), paints).collect():
        p, q, s = ladder[r.id]
        assert r.paints == sorted((p, q)) and r.shares[r.paints.index(p)] == pytest.approx(s, abs=0.01)


def plain_match(paints, target):
    """The best recipe by a sweep of every subset and two finer ones around its best, one by one."""
    k, s = (np.array([p[i] for p in paints]) for i in (1, 2))
    best = None
    for size, steps in ((1, 1), (2, recipes.PAIR_SWEEP), (3, recipes.TRIPLE_SWEEP)):
        for subset in itertools.combinations(range(len(paints)), size):
            lab = lambda shares: recipes._lab_of(np.array(shares), k[list(subset)], s[list(subset)])  # noqa: B023, E731
            tried = [x for x in itertools.product(*[np.arange(steps + 1) / steps] * (size - 1)) if sum(x) <= 1 + 1e-9]
            at, d, window = None, np.inf, 1 / steps
            for _ in range(1 if size == 1 else 1 + recipes.REFINEMENTS):
                shares = [(*x, max(0.0, 1 - sum(x))) for x in tried]
                gap = recipes._distance(lab(shares), target)
                if gap.min() < d:
                    at, d = shares[int(gap.argmin())], float(gap.min())
                fine = np.linspace(-window, window, recipes.REFINE_STEPS + 1)
                tried = [x for x in itertools.product(*(np.clip(u + fine, 0, 1) for u in at[:-1])) if sum(x) <= 1 + 1e-12]
                window /= 4
            if best is None or d < best[0] - 1e-12:
                best = (d, subset, at)
    d, subset, shares = best
    keep = [i for i in range(len(subset)) if shares[i] >= recipes.LEAST_SHARE]
    return [subset[i] for i in keep], [shares[i] / sum(shares[j] for j in keep) for i in keep], d


@pytest.mark.parametrize("count", [1, 2, 3, 7, 18])
def test_batches_with_bounds_against_a_plain_search(count):
    palette_ = [(p[0], p[4], p[5]) for p in pigments.PALETTE]
    paints = [(i, *p[1:]) for i, p in enumerate(palette_[:: max(1, 18 // count)][:count])]
    rng = np.random.default_rng(count)
    solver = recipes.Solver(paints)
    mixed = [recipes._lab_of(rng.dirichlet(np.ones(len(paints)) * 0.3)[None], *(np.array([p[i] for p in paints]) for i in (1, 2)))[0] for _ in range(6)]
    targets = np.array([*rng.uniform((0, -80, -80), (100, 80, 90), (8 if count > 9 else 40, 3)), *mixed, solver.single[0], solver.single[-1]])
    for target, got in zip(targets, solver.match(targets), strict=True):
        want = plain_match(paints, target)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-9) and got[2] == pytest.approx(want[2], abs=1e-9)


def test_percentages_add_up(spark):
    rng = np.random.default_rng(4)
    shares = [(list(map(float, s / s.sum())),) for s in rng.random((300, 3)) ** 4]
    for r in spark.createDataFrame(shares, "s array<double>").select("s", recipes.percentages(F.col("s")).alias("p")).collect():
        assert sum(r.p) == 100 and min(r.p) >= 1


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(1, 9)), *map(float, rng.uniform((0, -40, -40), (100, 40, 40)))) for i in range(120)]
    ddl = "image_id long, colour_key int, weight long, l double, a double, b double"
    other = [(7, i, 1, 50.0 + i, 0.0, 0.0) for i in range(9)]  # another image changes nothing
    found = palette.kmeans(spark.createDataFrame([(3, *r) for r in rows] + other, ddl), 4).filter("image_id = 3")
    data = np.array([r[2:] for r in sorted(rows, key=lambda r: (r[2], r[0]))])
    weight = np.array([r[1] for r in sorted(rows, key=lambda r: (r[2], r[0]))])
    centres = data[[i * 119 // 3 for i in range(4)]]
    for _ in range(palette.LLOYD_STEPS):
        own = (((data[:, None] - centres) ** 2) * (1.5, 1, 1)).sum(axis=2).argmin(axis=1)
        centres = np.array([np.average(data[own == k], axis=0, weights=weight[own == k]) if (own == k).any() else centres[k] for k in range(4)])
    assert np.allclose([(r.l, r.a, r.b) for r in found.orderBy("centre").collect()], centres)


def test_only_measured_paints_can_be_chosen(spark):
    df = mixtures.palette(spark, [0, 1]).unionByName(spark.createDataFrame([(90, "Other", "X", "derived", [1.0] * pigments.BANDS, [1.0] * pigments.BANDS)], pigments.PIGMENT_DDL))
    assert [r.paint_idx for r in mixtures.selectable(df).orderBy("paint_idx").collect()] == [0, 1]
    names = spark.createDataFrame([("Mallow",), ("Nothing",)], "name string")
    assert [r.paint_idx for r in mixtures.by_names(df, names).collect()] == [0]
    assert mixtures.by_names(df, names.filter("name = 'Nothing'")).count() == 3


def test_every_colour_asked_for_gets_its_blend(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(1, 46)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.closest_blends(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in found) == list(range(1, 46))
    assert sorted(r.id for r in catalogue.recipe_lines(spark, str(tmp_path)).collect()) == list(range(1, 46))


def test_equal_colours_share_a_blend(spark):
    rows = [(1, 50.0, 5.0, -3.0), (2, 50.0, 5.0, -3.0), (3, 20.0, 0.0, 0.0)]
    found = {r.id: r for r in recipes.closest_blends(spark.createDataFrame(rows, "id long, l double, a double, b double"), mixtures.palette(spark, [4, 9, 14])).collect()}
    assert sorted(found) == [1, 2, 3] and found[1][1:] == found[2][1:] != found[3][1:]


def test_grid_search_against_all_pairs():
    rng = np.random.default_rng(12)
    lab = np.round(rng.uniform((0, -90, -90), (100, 90, 90), (4000, 3)), 1)
    lab = np.vstack([lab, lab[:50]])  # ties go to the first
    points = np.vstack([rng.uniform((-5, -100, -100), (105, 100, 100), (3000, 3)), lab[::40], [[0, 0, 0], [500.0, 0, 0]]])
    for weight in (1.0, 1.5):
        found = nearest.CandidateGrid(np.arange(len(lab)), lab, weight).search(points)
        gap = lambda p: np.floor(((lab - p) ** 2 * (weight, 1, 1)).sum(axis=1) * 1e8 + 0.5)  # noqa: B023, E731
        assert found.tolist() == [int(gap(p).argmin()) for p in points]


def plain_palette(samples, cands, k):
    """samples (key, weight, l, a, b) and candidates (index, l, a, b) of one image to chosen indices."""
    far = lambda p, q: 1.5 * (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    best = lambda p, of: min(range(len(of)), key=lambda i: (round(far(p, of[i]), 8), i))
    if len(cands) <= k:
        return [c[0] for c in cands]
    ordered = sorted(samples, key=lambda s: (s[2], s[0]))
    centres = [ordered[i * (len(ordered) - 1) // (k - 1)][2:] for i in range(k)]
    for _ in range(palette.LLOYD_STEPS):
        mine = [[] for _ in centres]
        for s in ordered:
            mine[best(s[2:], centres)].append(s)
        centres = [tuple(sum(s[1] * s[c] for s in m) / sum(s[1] for s in m) for c in (2, 3, 4)) if m else centre for m, centre in zip(mine, centres, strict=True)]
    spots = [c[1:] for c in cands]
    chosen = {max(range(len(cands)), key=lambda i: (spots[i][0], -i)), min(range(len(cands)), key=lambda i: (spots[i][0], i))} | {best(c, spots) for c in centres}
    for at in [*(best(s[2:], spots) for s in ordered), *range(len(cands))]:
        if len(chosen) < k:
            chosen.add(at)
    return [cands[i][0] for i in sorted(chosen)]


def test_each_image_has_its_own_palette(spark):
    rng = np.random.default_rng(3)
    cands = mixtures.settled(mixtures.candidates(mixtures.palette(spark, [4, 9, 14])))
    pixels = [(image, y, x, int(rng.integers(0, 1 << 24)) if image < 3 else 0x808080) for image in range(4) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(pixels, "image_id long, y int, x int, argb int")
    listed = [(r.cand_idx, r.l, r.a, r.b) for r in cands.orderBy("cand_idx").collect()]
    shown = {r.cand_idx: r.argb for r in cands.collect()}
    got = palette.image_palette(df, cands, 5)
    samples = palette.histogram(df).collect()
    for image in range(4):
        own = [(r.colour_key, r.weight, r.l, r.a, r.b) for r in samples if r.image_id == image]
        want = [shown[i] for i in plain_palette(own, listed, 5)]
        assert [r.argb for r in got.filter(f"image_id = {image}").orderBy("cand_idx").collect()] == want
    alone = palette.image_palette(df.filter("image_id = 1"), cands, 5)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, got.filter("image_id = 1").collect()))


def test_per_pixel_search_uses_exact_colours(spark):
    cands = spark.createDataFrame([(0, 0x101010), (1, 0x131313)], "cand_idx int, argb int")
    cands = mixtures.with_argb_lab(cands)
    df = spark.createDataFrame([(1, 0, 0, 0x101010), (1, 0, 1, 0x131313)], "image_id long, y int, x int, argb int")
    exact = {r.x: r.cand_idx for r in nearest.resolve_per_pixel(df, cands).collect()}
    binned = {r.x: r.cand_idx for r in nearest.resolve_once(df, cands).collect()}
    assert exact == {0: 0, 1: 1} and binned[0] == binned[1]


def test_recipes_are_mixed_again_as_shown(spark):
    paints = mixtures.palette(spark, [4, 9, 14])
    rows = [(1, 50.0, 5.0, -3.0), (2, 70.0, 20.0, 10.0)]
    targets = spark.createDataFrame(rows, "id long, l double, a double, b double")
    by_id = {r.paint_idx: r for r in paints.collect()}
    for r in recipes.to_match(targets, paints).collect():
        k, s = (np.array([getattr(by_id[p], c) for p in r.paints]) for c in "ks")
        lab = recipes._lab_of(np.array([r.percentages]) / 100, k, s)
        target = np.array(rows[r.id - 1][1:])
        assert sum(r.percentages) == 100 and r.snapped == pytest.approx(float(recipes._distance(lab, target)[0]))
        assert r.exact >= 0 and r.chroma_lost >= 0


def test_recipes_under_points(spark):
    paints = mixtures.palette(spark, [4, 9, 14])
    px = spark.createDataFrame([(1, 0, 0, -8355712), (1, 0, 1, 0x00FFFFFF), (1, 0, 2, -8355712)], "image_id long, y int, x int, argb int")
    points = spark.createDataFrame([(1, x, 0) for x in (0, 1, 2, 9)], "image_id long, x int, y int")
    got = {r.x: r.lines for r in recipes.recipes_at(px, points, paints).collect()}
    assert sorted(got) == [0, 2] and got[0] == got[2]
    assert got[0][:2] == ["RGB: 128, 128, 128", "Closest mix:"] and any(x.startswith("Match: ") for x in got[0])
    shares = [int(x.split("%")[0]) for x in got[0][2:] if "% " in x]
    assert sum(shares) == 100 and shares == sorted(shares, reverse=True)
    plain = recipes.recipes_at(px, points, paints.limit(0)).collect()
    assert {tuple(r.lines) for r in plain} == {("RGB: 128, 128, 128",)}


def test_extents_of_candidates(spark):
    rows = [(0, 50.0, 3.0, 4.0), (1, 90.0, 0.0, 0.0), (2, 10.0, 0.0, 1.0), (3, 90.0, 0.0, 2.0), (4, 10.0, 0.0, 0.0)]
    r = mixtures.extents(spark.createDataFrame(rows, "cand_idx int, l double, a double, b double")).first()
    assert (r.n, r.chroma, r.least_l, r.most_l, r.darkest, r.lightest) == (5, 5.0, 10.0, 90.0, 2, 1)


def test_mixing_against_plain_sums(spark):
    paints = mixtures.palette(spark, [3, 8, 15])
    rng = np.random.default_rng(6)
    rows = [(i, [(int(p), float(x)) for p, x in zip(rng.choice([3, 8, 15, 99], 4), rng.random(4), strict=True)]) for i in range(40)] + [(100, [(3, 0.0)]), (101, []), (102, None), (103, [(99, 1.0)])]
    df = spark.createDataFrame(rows, "ordinal long, parts array<struct<paint_idx: int, share: double>>").repartition(3)
    got = {r.ordinal: (r.x, r.y, r.z) for r in mixtures.mix(df, paints).collect()}
    for i, parts in rows:
        known = [(p, x) for p, x in parts or [] if p != 99]
        total = sum(x for _, x in known)
        if not total:
            assert got[i] == (None, None, None)
            continue
        k, s = (np.sum([x / total * np.array(pigments.PALETTE[p][c]) for p, x in known], axis=0) for c in (4, 5))
        q = k / np.maximum(s, pigments.LEAST_SCATTER)
        inner = 1 + q - np.sqrt(q * q + 2 * q)
        r = (1 - pigments.SAUNDERSON_K1) * (1 - pigments.SAUNDERSON_K2) * inner / (1 - pigments.SAUNDERSON_K2 * inner)
        assert got[i] == pytest.approx([float(r @ np.array(o)) / pigments.NORM for o in pigments.OBSERVERS])


def test_few_recipes_are_refined_and_none_too_few(monkeypatch):
    solver = recipes.Solver([(p[0], p[4], p[5]) for p in pigments.PALETTE])
    refined, plain = [], recipes._Sweep.refined
    monkeypatch.setattr(recipes._Sweep, "refined", lambda sweep, c, *args: refined.append(len(c)) or plain(sweep, c, *args))
    swept, coarse = [], recipes._Sweep.swept
    monkeypatch.setattr(recipes._Sweep, "swept", lambda sweep, *args: swept.append(len(args[0])) or coarse(sweep, *args))
    targets = np.random.default_rng(31).uniform((5, -60, -60), (95, 60, 60), (40, 3))
    got = solver.match(targets)
    # of 969 subsets a colour
    assert sum(refined) < 60 * len(targets) and 0 < sum(swept) < 400 * len(targets)
    monkeypatch.undo()
    for target, match in zip(targets[::4], got[::4], strict=True):
        least = recipes._distance(solver.single, target).min()
        for sweep in solver.sweeps:
            c, one = np.arange(len(sweep.members)), np.broadcast_to(target, (len(sweep.members), 3))
            first, own = sweep.first(target[None])
            least = min(least, sweep.refined(c, *sweep.swept(c, first[0], own[0], one), one)[0].min())
        assert match[2] == pytest.approx(least, abs=1e-9)


def test_colours_solved_together_do_not_depend_on_each_other():
    solver = recipes.Solver([(p[0], p[4], p[5]) for p in pigments.PALETTE[::2]])
    targets = np.random.default_rng(32).uniform((0, -90, -90), (100, 90, 90), (300, 3))
    together = solver.match(targets)
    for i in range(0, 300, 17):
        alone = solver.match(targets[i : i + 1])[0]
        assert together[i][0] == alone[0] and together[i][1] == pytest.approx(alone[1], abs=1e-9) and together[i][2] == pytest.approx(alone[2], abs=1e-9)
    assert solver.match(targets[:0]) == []


def test_close_colours_share_sweeps_and_mixed_lattices(monkeypatch):
    solver = recipes.Solver([(p[0], p[4], p[5]) for p in pigments.PALETTE[::2]])
    met, mixed = [], []
    plain, mix = recipes._Sweep._first_of_all, recipes._lab_of
    monkeypatch.setattr(recipes._Sweep, "_first_of_all", lambda sweep, targets: met.append(len(targets)) or plain(sweep, targets))
    monkeypatch.setattr(recipes, "_lab_of", lambda shares, *args: mixed.append(len(shares)) or mix(shares, *args))
    targets = np.array((55.0, 12.0, -20.0)) + np.random.default_rng(41).uniform(-1.5, 1.5, (700, 3))
    together = solver.match(targets)
    assert not met  # no colour meets all coarse points
    assert sum(n for n in mixed if n > 256) <= 13041 * 84 + 769 * 36  # each subset's finer lattice once at most
    seen = len(mixed)
    assert [x[0] for x in solver.match(targets[::-1])] == [x[0] for x in together[::-1]] and len(mixed) == seen
    for i in range(0, 700, 41):
        alone = solver.match(targets[i : i + 1])[0]
        assert together[i][0] == alone[0] and together[i][1] == pytest.approx(alone[1], abs=1e-9) and together[i][2] == pytest.approx(alone[2], abs=1e-9)


def test_finer_lattices_are_mixed_again_when_few_are_kept(monkeypatch):
    paints = [(p[0], p[4], p[5]) for p in pigments.PALETTE[::3]]
    targets = np.random.default_rng(42).uniform((0, -60, -60), (100, 60, 60), (60, 3))
    want = recipes.Solver(paints).match(targets)
    monkeypatch.setattr(recipes._Sweep, "KEPT", 3)
    got = recipes.Solver(paints).match(targets)
    assert got == want


def test_a_colour_without_a_place_leaves_the_others_alone():
    solver = recipes.Solver([(p[0], p[4], p[5]) for p in pigments.PALETTE[::3]])
    targets = np.random.default_rng(43).uniform((20, -40, -40), (80, 40, 40), (50, 3))
    got = solver.match(np.vstack([targets, [[np.nan, 0, 0]]]))
    assert got[:50] == solver.match(targets) and got[50][1] == [1.0] and np.isnan(got[50][2])


def test_what_is_told_before_a_refinement_holds():
    solver = recipes.Solver([(p[0], p[4], p[5]) for p in pigments.PALETTE if p[0] in (3, 6, 7, 8, 9, 10, 14)])
    dark = np.random.default_rng(44).uniform((0, -20, -40), (12, 40, 20), (150, 3))
    for target in np.array([*[[74.808, -25.6968, -8.0516], [75.4686, -26.4464, -5.4296]], *dark]):
        best = recipes._distance(solver.single, target).min()
        for sweep in solver.sweeps:
            c, one = np.arange(len(sweep.members)), np.broadcast_to(target, (len(sweep.members), 3))
            (first,), (own,) = sweep.first(target[None])
            at, d = sweep.swept(c, first, own, one)
            least = sweep.refined(c, at, d, one)[0]
            refined = least < d
            assert (sweep.least(c, at, one) <= least + 1e-9)[refined].all()
            assert (sweep.may_reach(c, at, d, one) <= least + 1e-9).all() and (sweep.may_come(c, first, one) <= least + 1e-9).all()
            assert (own - sweep.far[c, first] <= least).all() and (d - sweep.reach[c, at] <= least).all()
            best = min(best, least.min())
        assert solver.match(target[None])[0][2] == pytest.approx(best, abs=1e-9)
