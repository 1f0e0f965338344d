"""DuckDB SQL fragments that restate the colour formulas for the oracles."""

from __future__ import annotations

from ..functions import color, pigments


def lin(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92::DOUBLE ELSE pow(({v} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def byte_lin(v: str) -> str:
    return lin(f"({v} / 255.0::DOUBLE)")


def dot(row, names) -> str:
    return "(" + " + ".join(f"{k!r}::DOUBLE * {n}" for k, n in zip(row, names, strict=True)) + ")"


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > {color.EPSILON!r}::DOUBLE THEN cbrt({t}) ELSE ({color.KAPPA!r}::DOUBLE * {t} + 16) / 116 END)"


def lab_columns(x: str, y: str, z: str) -> tuple[str, str, str]:
    fx, fy, fz = (_f(f"({v} / {w!r}::DOUBLE)") for v, w in zip((x, y, z), color.WHITE, strict=True))
    return f"(116 * {fy} - 16)", f"(500 * ({fx} - {fy}))", f"(200 * ({fy} - {fz}))"


def lab_ctes(source: str, name: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """CTEs that end in ``name``: every column of ``source`` and its l, a, b."""
    xyz = ", ".join(f"{dot(row, ('lr', 'lg', 'lb'))} AS {n}_" for row, n in zip(color.TO_XYZ, "xyz", strict=True))
    lab = ", ".join(f"{e} AS {n}" for e, n in zip(lab_columns("x_", "y_", "z_"), ("l", "aa", "bb"), strict=True))
    return f"""{name}_lin AS (SELECT *, {byte_lin(r)} AS lr, {byte_lin(g)} AS lg, {byte_lin(b)} AS lb FROM {source}),
{name}_xyz AS (SELECT *, {xyz} FROM {name}_lin), {name} AS (SELECT *, {lab} FROM {name}_xyz)"""


def encode(v: str) -> str:
    held = f"greatest(0::DOUBLE, least(1::DOUBLE, {v}))"
    srgb = f"(CASE WHEN {held} <= 0.0031308 THEN {held} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({held}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END)"
    return f"round_even(greatest(0, least(1, {srgb})) * 255, 0)::INT"


def pigment_ctes(indices) -> str:
    """CTEs ``pb(paint_idx, band, k, s)`` and ``bands(band, xb, yb, zb)``."""
    rows = ", ".join(f"({p[0]}, {p[4]!r}::DOUBLE[], {p[5]!r}::DOUBLE[])" for p in pigments.PALETTE if p[0] in indices)
    observers = ", ".join(f"{list(o)!r}::DOUBLE[]" for o in pigments.OBSERVERS)
    return f"""pig(paint_idx, ks, ss) AS (VALUES {rows}),
pb AS (SELECT paint_idx, band, ks[band + 1] AS k, ss[band + 1] AS s FROM pig, (SELECT unnest(range({pigments.BANDS})) AS band)),
obs(xs, ys, zs) AS (VALUES ({observers})),
bands AS (SELECT band, xs[band + 1] AS xb, ys[band + 1] AS yb, zs[band + 1] AS zb FROM obs, (SELECT unnest(range({pigments.BANDS})) AS band))"""


def mix_ctes(parts: str, name: str) -> str:
    """``parts(id, paint_idx, share)`` to ``name(id, x, y, z)``."""
    k1, k2 = pigments.SAUNDERSON_K1, pigments.SAUNDERSON_K2
    return f"""{name}_sum AS (SELECT id, band, sum(share * k) / sum(share) AS k, sum(share * s) / sum(share) AS s FROM {parts} JOIN pb USING (paint_idx) GROUP BY id, band),
{name}_q AS (SELECT id, band, k / greatest(s, 1e-6::DOUBLE) AS q FROM {name}_sum),
{name}_r AS (SELECT id, band, {(1 - k1) * (1 - k2)!r}::DOUBLE * (1 + q - sqrt(q * q + 2 * q)) / (1 - {k2}::DOUBLE * (1 + q - sqrt(q * q + 2 * q))) AS r FROM {name}_q),
{name} AS (SELECT id, sum(xb * r) / {pigments.NORM!r}::DOUBLE AS x, sum(yb * r) / {pigments.NORM!r}::DOUBLE AS y, sum(zb * r) / {pigments.NORM!r}::DOUBLE AS z FROM {name}_r JOIN bands USING (band) GROUP BY id)"""


def gamut_ctes(source: str, name: str) -> str:
    """``source(id, r, g, b)`` in linear light to ``name(id, r, g, b, chroma_lost)``."""
    slack = color.GAMUT_SLACK
    fits = lambda r, g, b: " AND ".join(f"{v} BETWEEN {-slack!r}::DOUBLE AND {1 + slack!r}::DOUBLE" for v in (r, g, b))
    cones = ", ".join(f"cbrt({dot(row, 'rgb')}) AS {n}_" for row, n in zip(color.TO_CONES, "lms", strict=True))
    ok = [dot(row, ("l_", "m_", "s_")) for row in color.FROM_ROOTS]
    roots = [dot(row, ("ll", "ha * t", "hb * t")) for row in color.TO_ROOTS]
    rgb = ", ".join(f"{dot(row, [f'({v} * {v} * {v})' for v in roots])} AS {n}2" for row, n in zip(color.FROM_CONES, "rgb", strict=True))
    return f"""{name}_cone AS (SELECT id, r, g, b, {cones} FROM {source} WHERE NOT ({fits("r", "g", "b")})),
{name}_ok AS (SELECT id, greatest(0, least(1, {ok[0]})) AS ll, {ok[1]} AS a_, {ok[2]} AS b_ FROM {name}_cone),
{name}_c AS (SELECT *, sqrt(a_ * a_ + b_ * b_) AS c FROM {name}_ok),
{name}_h AS (SELECT id, ll, c, CASE WHEN c > 0 THEN a_ / c ELSE 0 END AS ha, CASE WHEN c > 0 THEN b_ / c ELSE 0 END AS hb FROM {name}_c),
{name}_s(id, ll, c, ha, hb, n, lo, hi) AS (
  SELECT id, ll, c, ha, hb, 0, 0::DOUBLE, c FROM {name}_h
  UNION ALL
  SELECT id, ll, c, ha, hb, n + 1, CASE WHEN {fits("r2", "g2", "b2")} THEN t ELSE lo END, CASE WHEN {fits("r2", "g2", "b2")} THEN hi ELSE t END
  FROM (SELECT *, {rgb} FROM (SELECT *, 0.5::DOUBLE * (lo + hi) AS t FROM {name}_s WHERE n < {color.GAMUT_STEPS}))
),
{name}_m AS (SELECT id, c - t AS lost, {rgb} FROM (SELECT *, lo AS t FROM {name}_s WHERE n = {color.GAMUT_STEPS})),
{name} AS (
  SELECT id, r, g, b, 0::DOUBLE AS chroma_lost FROM {source} WHERE {fits("r", "g", "b")}
  UNION ALL SELECT id, greatest(0, least(1, r2)), greatest(0, least(1, g2)), greatest(0, least(1, b2)), lost FROM {name}_m
)"""
