"""Registered queries over the driver's tables, and the DuckDB oracles of most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, pigments
from ..operators import filters, mixtures, nearest, palette, recipes, regions, viewport, wheel
from ..operators.colour_maps import ColourMaps, map_name
from ..sources import fixtures, images, pigment_files, scratch
from ..streaming import requests, scheduler
from . import oracle_text as sql
from . import phases, styles

FLAGSHIP = "style_realism"
QUERIES: dict = {}
ORACLES: dict = {}
EVERY = [p[0] for p in pigments.PALETTE]
MARK = 2.0


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r6(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _lab(df: DataFrame) -> DataFrame:
    return df.select("*", *(c.alias(n) for c, n in zip(color.rgb_to_lab(*_rgb()), ("l", "aa", "bb"), strict=True)))


#: Candidates of the session, built once for all queries on the same paints.
_KEPT = styles.Cache()


def _cands(spark: SparkSession, style: str = "Realism") -> DataFrame:
    return _KEPT.candidates(styles.by_name(style), mixtures.palette(spark))


# ---- colour maths

PX, COLOURS = fixtures.PIXELS_SQL, fixtures.COLOURS_SQL


@query(f"WITH {PX}, {sql.lab_ctes('px', 'v')} SELECT image_id, y, x, round(l, 6) AS l, round(aa, 6) AS a, round(bb, 6) AS b FROM v")
def srgb_to_lab(spark, sf_dir):
    return _lab(fixtures.pixels(spark, sf_dir)).select("image_id", "y", "x", *r6(l=F.col("l"), a=F.col("aa"), b=F.col("bb")))


_OK = [sql.dot(row, ("cl", "cm", "cs")) for row in color.FROM_ROOTS]


@query(
    f"WITH {COLOURS}, lin AS (SELECT id, {', '.join(f'{sql.byte_lin(c)} AS {c}' for c in 'rgb')} FROM colours), "
    f"cone AS (SELECT id, {', '.join(f'cbrt({sql.dot(row, chr(114) + chr(103) + chr(98))}) AS {n}' for row, n in zip(color.TO_CONES, ('cl', 'cm', 'cs'), strict=True))} FROM lin) "
    f"SELECT id, round({_OK[0]}, 6) AS ok_l, round({_OK[1]}, 6) AS ok_a, round({_OK[2]}, 6) AS ok_b FROM cone"
)
def srgb_to_oklab(spark, sf_dir):
    light, a, b = color.linear_to_oklab(tuple(map(color.byte_to_linear, _rgb())))
    return fixtures.colours(spark, sf_dir).select("id", *r6(ok_l=light, ok_a=a, ok_b=b))


@query(f"WITH {COLOURS} SELECT id, r, g, b FROM colours")
def oklab_round_trip(spark, sf_dir):
    back = color.oklab_to_linear(color.linear_to_oklab(tuple(map(color.byte_to_linear, _rgb()))))
    return fixtures.colours(spark, sf_dir).select("id", *(color.linear_to_byte(c).alias(n) for c, n in zip(back, "rgb", strict=True)))


@query(f"WITH {COLOURS} SELECT id, r, g, b FROM colours")
def xyz_round_trip(spark, sf_dir):
    back = color.xyz_to_linear(color.linear_to_xyz(tuple(map(color.byte_to_linear, _rgb()))))
    return fixtures.colours(spark, sf_dir).select("id", *(color.linear_to_byte(c).alias(n) for c, n in zip(back, "rgb", strict=True)))


_KEY = "(((r >> 2) << 12) | ((g >> 2) << 6) | (b >> 2))"


@query(f"WITH {PX} SELECT colour_key, n, (((colour_key >> 12) & 63) * 4 + 2)::INT AS r, (((colour_key >> 6) & 63) * 4 + 2)::INT AS g, ((colour_key & 63) * 4 + 2)::INT AS b FROM (SELECT {_KEY}::INT AS colour_key, count(*) AS n FROM px GROUP BY 1)")
def quantise_key_histogram(spark, sf_dir):
    keyed = fixtures.pixels(spark, sf_dir).groupBy(color.quantise(*_rgb()).alias("colour_key")).agg(F.count("*").alias("n"))
    return keyed.select("*", *(c.alias(n) for c, n in zip(color.key_to_rgb(F.col("colour_key")), "rgb", strict=True)))


def _pairs(df: DataFrame) -> DataFrame:
    """Colours beside the next one by id, an equi-join on the id."""
    lab = _lab(df).select("id", "l", "aa", "bb")
    other = lab.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"{c}2") for c in ("l", "aa", "bb")))
    return lab.join(other, "id")


_PAIR_CTES = f"WITH {COLOURS}, {sql.lab_ctes('colours', 'v')}, pairs AS (SELECT p.id, p.l, p.aa, p.bb, q.l AS l2, q.aa AS aa2, q.bb AS bb2 FROM v p JOIN v q ON q.id = p.id + 1)"


def _xy():
    return tuple(map(F.col, ("l", "aa", "bb"))), tuple(map(F.col, ("l2", "aa2", "bb2")))


_DE = f"""{_PAIR_CTES}, m AS (SELECT *, (sqrt(aa * aa + bb * bb) + sqrt(aa2 * aa2 + bb2 * bb2)) / 2 AS cm FROM pairs),
g AS (SELECT *, 1.5::DOUBLE - 0.5::DOUBLE * sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625::DOUBLE)) AS gr FROM m),
p AS (SELECT *, aa * gr AS p1, aa2 * gr AS p2 FROM g),
c AS (SELECT *, sqrt(p1 * p1 + bb * bb) AS c1, sqrt(p2 * p2 + bb2 * bb2) AS c2,
  CASE WHEN p1 = 0 AND bb = 0 THEN 0 ELSE fmod(degrees(atan2(bb, p1)) + 360, 360) END AS h1, CASE WHEN p2 = 0 AND bb2 = 0 THEN 0 ELSE fmod(degrees(atan2(bb2, p2)) + 360, 360) END AS h2 FROM p),
h AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (c1 + c2) / 2 AS cc, ((l + l2) / 2 - 50) * ((l + l2) / 2 - 50) AS lo FROM c),
t AS (SELECT *, 1 - 0.17::DOUBLE * cos(radians(hm - 30)) + 0.24::DOUBLE * cos(radians(2 * hm)) + 0.32::DOUBLE * cos(radians(3 * hm + 6)) - 0.20::DOUBLE * cos(radians(4 * hm - 63)) AS tt FROM h),
d AS (SELECT *, (l2 - l) / (1 + 0.015::DOUBLE * lo / sqrt(20 + lo)) AS dl, (c2 - c1) / (1 + 0.045::DOUBLE * cc) AS dc,
  2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015::DOUBLE * cc * tt) AS dhh, 2 * sqrt(pow(cc, 7) / (pow(cc, 7) + 6103515625::DOUBLE)) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS rt FROM t),
de AS (SELECT *, sqrt(dl * dl + dc * dc + dhh * dhh - rt * dc * dhh) AS e FROM d)"""


@query(_DE + " SELECT id, round(e, 6) AS de FROM de")
def ciede2000_pairs(spark, sf_dir):
    return _pairs(fixtures.colours(spark, sf_dir)).select("id", *r6(de=color.ciede2000(*_xy())))


@query(
    _DE
    + """ SELECT id, CASE WHEN e < 1 THEN 'indistinguishable' WHEN e < 2 THEN 'very close' WHEN e < 3 THEN 'close' WHEN e < 5 THEN 'noticeable' ELSE 'clearly different' END AS quality,
  nullif(concat_ws(' and ', CASE WHEN l2 - l >= 1 THEN 'lighter' WHEN l2 - l <= -1 THEN 'darker' END,
    CASE WHEN sqrt(aa2 * aa2 + bb2 * bb2) - sqrt(aa * aa + bb * bb) >= 1 THEN 'more intense' WHEN sqrt(aa2 * aa2 + bb2 * bb2) - sqrt(aa * aa + bb * bb) <= -1 THEN 'duller' END), '') AS shift FROM de"""
)
def match_descriptions(spark, sf_dir):
    x, y = _xy()
    return _pairs(fixtures.colours(spark, sf_dir)).select("id", color.describe_quality(color.ciede2000(x, y)).alias("quality"), color.describe_shift(x, y).alias("shift"))


@query(_PAIR_CTES + " SELECT id, round(1.5::DOUBLE * abs(l - l2) + sqrt((aa - aa2) * (aa - aa2) + (bb - bb2) * (bb - bb2)), 6) AS distance FROM pairs")
def perceptual_distance_pairs(spark, sf_dir):
    return _pairs(fixtures.colours(spark, sf_dir)).select("id", *r6(distance=color.perceptual_distance(*_xy())))


@query(
    f"""WITH {COLOURS}, {sql.lab_ctes('colours', 'v')}, c AS (SELECT *, sqrt(aa * aa + bb * bb) AS ch FROM v),
s AS (SELECT *, CASE WHEN ch <= 1e-9 THEN 1 ELSE (0.6::DOUBLE * (1.8::DOUBLE * ch) + 0.4::DOUBLE * (90 * tanh(1.8::DOUBLE * ch / 90))) / ch END AS sc FROM c)
SELECT id, round(greatest(0, least(100, 50 + (l - 50) * 0.95::DOUBLE - 4)), 6) AS l, round(aa * sc, 6) AS a, round(bb * sc, 6) AS b FROM s"""
)
def tone_chroma_remap(spark, sf_dir):
    light, a, b = color.remap((F.col("l"), F.col("aa"), F.col("bb")), 90.0, contrast=0.95, key=-4, gain=1.8)
    return _lab(fixtures.colours(spark, sf_dir)).select("id", *r6(l=light, a=a, b=b))


_WIDE = f"WITH RECURSIVE {COLOURS}, wide AS (SELECT id, {', '.join(f'({c} / 255.0::DOUBLE * 1.6::DOUBLE - 0.3::DOUBLE) AS {c}' for c in 'rgb')} FROM colours), {sql.gamut_ctes('wide', 'm')}"


@query(_WIDE + " SELECT id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(chroma_lost, 6) AS chroma_lost FROM m")
def gamut_compress(spark, sf_dir):
    wide = tuple(c / 255.0 * 1.6 - 0.3 for c in _rgb())
    m = fixtures.colours(spark, sf_dir).select("id", color.compress(*wide).alias("m"))
    return m.select("id", *r6(**{n: F.col(f"m.{n}") for n in ("r", "g", "b", "chroma_lost")}))


@query(f"WITH {COLOURS} SELECT id, 'rgb(' || r || ',' || g || ',' || b || ')' AS css, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b >= 140 AS dark_text FROM colours")
def swatches(spark, sf_dir):
    return fixtures.colours(spark, sf_dir).select("id", color.swatch_css(*_rgb()).alias("css"), color.reads_dark_text(*_rgb()).alias("dark_text"))


# ---- pigments and mixtures

_ENUM = lambda idx: f"""p AS (SELECT row_number() OVER (ORDER BY i) AS n, i AS pi FROM (SELECT unnest({idx}) AS i)),
every AS (
  SELECT 1 AS size, a.n AS a, 0 AS b, 0 AS c, 0 AS u, 0 AS v, [a.pi] AS ps, [1::DOUBLE] AS ss FROM p a
  UNION ALL SELECT 2, a.n, b.n, 0, u, 0, [a.pi, b.pi], [u / 64.0::DOUBLE, 1 - u / 64.0::DOUBLE] FROM p a JOIN p b ON a.n < b.n, (SELECT unnest(range(1, 64)) AS u)
  UNION ALL SELECT 3, a.n, b.n, c.n, u, v, [a.pi, b.pi, c.pi], [u / 16.0::DOUBLE, v / 16.0::DOUBLE, 1 - u / 16.0::DOUBLE - v / 16.0::DOUBLE]
    FROM p a JOIN p b ON a.n < b.n JOIN p c ON b.n < c.n, (SELECT unnest(range(1, 15)) AS u), (SELECT unnest(range(1, 15)) AS v) WHERE u + v < 16
), listed AS (SELECT row_number() OVER (ORDER BY size, a, b, c, u, v) - 1 AS id, ps, ss FROM every),
parts AS (SELECT id, unnest(ps) AS paint_idx, unnest(ss) AS share FROM listed)"""  # noqa: E731
_LAB_XYZ = sql.lab_columns("x", "y", "z")


def _mix_sql(idx) -> str:
    return f"{sql.pigment_ctes(idx)}, {_ENUM(idx)}, {sql.mix_ctes('parts', 'mx')}"


@query(f"WITH {sql.pigment_ctes(EVERY)}, {fixtures.LINES_SQL}, {sql.mix_ctes('parts', 'mx')} SELECT id AS ordinal, round({_LAB_XYZ[0]}, 6) AS l, round({_LAB_XYZ[1]}, 6) AS a, round({_LAB_XYZ[2]}, 6) AS b FROM mx")
def km_mixtures(spark, sf_dir):
    """Every order line as a mixture of paints."""
    mixed = mixtures.mix(fixtures.recipes_of_lines(spark, sf_dir), mixtures.palette(spark))
    light, a, b = color.xyz_to_lab(tuple(map(F.col, "xyz")))
    return mixed.select("ordinal", *r6(l=light, a=a, b=b))


XYZ = "xyz"


def _linear_sql(source: str) -> str:
    return f"wide AS (SELECT id, {', '.join(f'{sql.dot(row, XYZ)} AS {n}' for row, n in zip(color.FROM_XYZ, 'rgb', strict=True))} FROM {source}), {sql.gamut_ctes('wide', 'm')}"


def _argb_sql(idx) -> str:
    lin = ", ".join(f"{sql.dot(row, 'xyz')} AS {n}" for row, n in zip(color.FROM_XYZ, "rgb", strict=True))
    return f"""{_mix_sql(idx)}, wide AS (SELECT id, {lin} FROM mx), {sql.gamut_ctes('wide', 'm')},
shown AS (SELECT id, (255::BIGINT << 24) | ({sql.encode('r')}::BIGINT << 16) | ({sql.encode('g')}::BIGINT << 8) | {sql.encode('b')} AS rgba FROM m),
firsts AS (SELECT rgba, min(id) AS id FROM shown GROUP BY rgba),
cand0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cand_idx, ((rgba >> 16) & 255)::INT AS r, ((rgba >> 8) & 255)::INT AS g, (rgba & 255)::INT AS b FROM firsts), {sql.lab_ctes('cand0', 'cand')}"""


@query(f"""WITH RECURSIVE {sql.pigment_ctes(EVERY)}, {fixtures.LINES_SQL}, {sql.mix_ctes('parts', 'mx')}, {_linear_sql('mx')},
shown AS (SELECT l.supplier, m.id, (-16777216 + {sql.encode('r')} * 65536 + {sql.encode('g')} * 256 + {sql.encode('b')})::INT AS argb FROM m JOIN line l USING (id)),
firsts AS (SELECT supplier, argb, min(id) AS id FROM shown GROUP BY supplier, argb)
SELECT supplier, (row_number() OVER (PARTITION BY supplier ORDER BY id) - 1)::INT AS cand_idx, argb FROM firsts""")
def mixture_distinct(spark, sf_dir):
    """Each supplier's colours, numbered as they come up in its order lines."""
    lines, paints = fixtures.recipes_of_lines(spark, sf_dir), mixtures.palette(spark)
    keyed = lines.select(F.struct("supplier", "ordinal").alias("key"), "parts")
    return mixtures.first_of_each(mixtures.render(mixtures.mix(keyed, paints, "key")).select("key.*", "argb"), "supplier")


_NEUTRAL_SQL = f"""alone AS (SELECT i AS id, i AS paint_idx, 1::DOUBLE AS share FROM (SELECT unnest({EVERY}) AS i)), {sql.mix_ctes('alone', 'am')},
awide AS (SELECT id, {', '.join(f'{sql.dot(row, XYZ)} AS {n}' for row, n in zip(color.FROM_XYZ, 'rgb', strict=True))} FROM am), {sql.gamut_ctes('awide', 'ag')},
abyte AS (SELECT id, {sql.encode('r')} AS r, {sql.encode('g')} AS g, {sql.encode('b')} AS b FROM ag), {sql.lab_ctes('abyte', 'al')},
mother AS (SELECT id AS paint_idx FROM al ORDER BY sqrt(aa * aa + bb * bb) + 0.10::DOUBLE * abs(l - 50), abs(l - 50), id LIMIT 1)"""


@query(f"""WITH RECURSIVE {sql.pigment_ctes(EVERY)}, {fixtures.LINES_SQL}, {_NEUTRAL_SQL},
shares AS (SELECT id, paint_idx, share / sum(share) OVER (PARTITION BY id) * 0.85::DOUBLE AS share FROM parts UNION ALL SELECT line.id, mother.paint_idx, 0.15::DOUBLE FROM line, mother),
{sql.mix_ctes('shares', 'mx')}, {_linear_sql('mx')} SELECT id AS ordinal, round({_LAB_XYZ[0]}, 6) AS l, (-16777216 + {sql.encode('m.r')} * 65536 + {sql.encode('m.g')} * 256 + {sql.encode('m.b')})::INT AS argb FROM mx JOIN m USING (id)""")
def mixture_mother_colour(spark, sf_dir):
    """Every order line's mixture with 15 % of the palette's most neutral paint."""
    paints = mixtures.palette(spark)
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["share"])
    whole = F.transform("parts", lambda p: F.struct(p["paint_idx"].alias("paint_idx"), (p["share"] / F.col("total")).alias("share")))
    lines = fixtures.recipes_of_lines(spark, sf_dir).withColumn("total", total).select("ordinal", whole.alias("parts"))
    shown = mixtures.render(mixtures.mix(mixtures.blend_into(lines, mixtures.most_neutral(paints), 0.15), paints))
    return shown.select("ordinal", F.round("l", 6).alias("l"), "argb")


@query(f"WITH RECURSIVE {_argb_sql(EVERY)}, stock AS (SELECT p_partkey % 50 AS few FROM part GROUP BY ALL) SELECT few AS share, count(*) AS n, round(max(sqrt(aa * aa + bb * bb)), 6) AS chroma, round(min(l), 6) AS least_l, round(max(l), 6) AS most_l, arg_min(cand_idx, l * 1000000 + cand_idx / 1000000.0) AS darkest, arg_max(cand_idx, l * 1000000 - cand_idx / 1000000.0) AS lightest FROM stock JOIN cand ON cand_idx % 50 = few GROUP BY few")
def candidate_extents(spark, sf_dir):
    """Extents of the parts of the candidates that the parts' keys ask for."""
    few = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 50).alias("share")).distinct()
    met = _cands(spark).withColumn("share", F.col("cand_idx") % 50).join(few, "share").groupBy("share")
    found = mixtures.extents(met)
    return found.select("share", "n", *r6(chroma=F.col("chroma"), least_l=F.col("least_l"), most_l=F.col("most_l")), "darkest", "lightest")


def _nearest_sql(points: str, weight: str) -> str:
    """The nearest candidate of each point; a few candidates bound how far off in lightness it can be."""
    d = f"round({weight} * (q.l - c.l) * (q.l - c.l) + (q.aa - c.aa) * (q.aa - c.aa) + (q.bb - c.bb) * (q.bb - c.bb), 9)"
    bound = f"(SELECT q.id, q.l, q.aa, q.bb, sqrt((min({d}) + 1e-6) / {weight}) AS off FROM {points} q, cand c WHERE c.cand_idx % 40 = 0 GROUP BY ALL)"
    return f"SELECT q.id, min(struct_pack(d := {d}, i := c.cand_idx)).i AS cand_idx FROM {bound} q JOIN cand c ON c.l BETWEEN q.l - q.off AND q.l + q.off GROUP BY q.id"


def _points(df: DataFrame) -> DataFrame:
    return _lab(df).select("id", "l", F.col("aa").alias("a"), F.col("bb").alias("b"))


@query(f"WITH RECURSIVE {COLOURS}, {sql.lab_ctes('colours', 'q')}, {_argb_sql(EVERY)} {_nearest_sql('q', '1')}")
def nearest_unweighted(spark, sf_dir):
    return nearest.nearest(_points(fixtures.colours(spark, sf_dir)), _cands(spark), key="id")


@query(f"WITH RECURSIVE {COLOURS}, {sql.lab_ctes('colours', 'q')}, {_argb_sql(EVERY)} {_nearest_sql('q', '1.5::DOUBLE')}")
def nearest_weighted(spark, sf_dir):
    return nearest.nearest(_points(fixtures.colours(spark, sf_dir)), _cands(spark), key="id", lightness=1.5)


_BIN = f"keyed AS (SELECT image_id, y, x, {_KEY} AS id FROM px), bins AS (SELECT DISTINCT id, (((id >> 12) & 63) * 4 + 2) AS r, (((id >> 6) & 63) * 4 + 2) AS g, ((id & 63) * 4 + 2) AS b FROM keyed), {sql.lab_ctes('bins', 'q')}"


_JOINED_BACK = f"WITH RECURSIVE {PX}, {_BIN}, {_argb_sql(EVERY)}, near AS ({_nearest_sql('q', '1')}) SELECT image_id, y, x, cand_idx FROM keyed JOIN near USING (id)"


@query(_JOINED_BACK)
def colour_map_joinback(spark, sf_dir):
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb")
    return nearest.resolve_once(px, _cands(spark)).select("image_id", "y", "x", "cand_idx")


@query(_JOINED_BACK)
def colour_map_store(spark, sf_dir):
    """The same by a kept map: the upper halves of all images fill it, whole images then solve the rest only."""
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb")
    cands, maps = _cands(spark), ColourMaps(spark, scratch.folder(spark, "colour-maps"))
    maps.resolve(px.filter("y < 4"), cands, map_name(cands))
    return maps.resolve(px, cands, map_name(cands)).select("image_id", "y", "x", "cand_idx")


@query(f"WITH RECURSIVE {COLOURS}, px AS (SELECT id AS image_id, 0 AS y, 0 AS x, r, g, b FROM colours), {_BIN}, {_argb_sql(EVERY)}, near AS ({_nearest_sql('q', '1')}) SELECT image_id AS id, (-16777216 + c.r * 65536 + c.g * 256 + c.b)::INT AS argb FROM keyed JOIN near USING (id) JOIN cand c USING (cand_idx)")
def mapped_colours(spark, sf_dir):
    """What each part's colour is drawn in."""
    argb = color.pack(F.lit(255), *_rgb())
    return nearest.map_colours(fixtures.colours(spark, sf_dir).select("id", argb.alias("argb")), _cands(spark))


@query(f"WITH RECURSIVE {PX}, seen AS (SELECT DISTINCT r * 65536 + g * 256 + b AS id, r, g, b FROM px), {sql.lab_ctes('seen', 'q')}, {_argb_sql(EVERY)}, near AS ({_nearest_sql('q', '1')}) SELECT image_id, y, x, cand_idx FROM px JOIN near ON near.id = r * 65536 + g * 256 + b")
def exact_colour_map(spark, sf_dir):
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb")
    return nearest.resolve_per_pixel(px, _cands(spark)).select("image_id", "y", "x", "cand_idx")


_NAMES = ", ".join(f"({p[0]}, '{p[1]}')" for p in pigments.PALETTE)


@query(
    f"""WITH {sql.pigment_ctes(EVERY)}, names(paint_idx, name) AS (VALUES {_NAMES}),
own AS (SELECT paint_idx * 2 + t AS id, paint_idx, t FROM names, (SELECT unnest([0, 1]) AS t)),
pb2 AS (SELECT * FROM pb UNION ALL SELECT -1, band, 0::DOUBLE, 1::DOUBLE FROM bands),
parts AS (SELECT id, paint_idx, CASE t WHEN 0 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS share FROM own UNION ALL SELECT id, -1, CASE t WHEN 0 THEN 0::DOUBLE ELSE 0.5::DOUBLE END FROM own),
{sql.mix_ctes('parts', 'mx').replace('JOIN pb USING', 'JOIN pb2 USING')},
lab AS (SELECT own.paint_idx, own.t, {_LAB_XYZ[0]} AS l, {_LAB_XYZ[1]} AS a, {_LAB_XYZ[2]} AS b FROM mx JOIN own USING (id)),
j AS (SELECT m.paint_idx, m.l AS mass, CASE WHEN m.l < 30 THEN t.l ELSE m.l END AS l, CASE WHEN m.l < 30 THEN t.a ELSE m.a END AS a, CASE WHEN m.l < 30 THEN t.b ELSE m.b END AS b FROM lab m JOIN lab t USING (paint_idx) WHERE m.t = 0 AND t.t = 1),
h AS (SELECT *, fmod(degrees(atan2(b, a)) + 360, 360) AS hue FROM j),
f AS (SELECT paint_idx, mass, CASE WHEN sqrt(a * a + b * b) < 8 THEN CASE WHEN l >= 90 THEN 'Whites' ELSE 'Blacks' END WHEN hue >= 330 OR hue < 45 THEN 'Reds' WHEN hue >= 295 THEN 'Violets'
  WHEN hue >= 220 THEN 'Blues' WHEN hue >= 130 THEN 'Greens' WHEN hue >= 65 THEN 'Yellows' ELSE 'Oranges' END AS family FROM h),
named AS (SELECT paint_idx, name, family, (row_number() OVER (PARTITION BY family ORDER BY mass DESC, paint_idx))::INT AS rank, round(mass, 6) AS lightness FROM f JOIN names USING (paint_idx))
SELECT s_nationkey AS nation, name, family, any_value(rank) AS rank, any_value(lightness) AS lightness, count(*) AS suppliers FROM supplier JOIN named ON paint_idx = s_suppkey % {len(EVERY)} GROUP BY ALL"""
)
def paint_family_groups(spark, sf_dir):
    """The paints that each nation's suppliers have, with their families."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % len(EVERY)).alias("paint_idx"))
    named = mixtures.families(mixtures.palette(spark)).withColumn("lightness", F.round("lightness", 6))
    return supplier.groupBy("nation", "paint_idx").agg(F.count("*").alias("suppliers")).join(named, "paint_idx").select("nation", "name", "family", "rank", "lightness", "suppliers")


@query(f"""WITH RECURSIVE {sql.pigment_ctes(EVERY)}, own AS (SELECT s_suppkey AS supplier, (s_suppkey % {len(EVERY)})::INT AS first, (s_nationkey % {len(EVERY)})::INT AS second, x::INT AS x, s_suppkey * 100 + x AS id
  FROM supplier, (SELECT unnest(range(48)) AS x)),
parts AS (SELECT id, first AS paint_idx, 1 - x / 47.0::DOUBLE AS share FROM own UNION ALL SELECT id, second, x / 47.0::DOUBLE FROM own),
{sql.mix_ctes('parts', 'mx')}, {_linear_sql('mx')}
SELECT supplier, first, second, x, (-16777216 + {sql.encode('r')} * 65536 + {sql.encode('g')} * 256 + {sql.encode('b')})::INT AS argb FROM own JOIN m USING (id)""")
def gradient_strips(spark, sf_dir):
    """A strip for each supplier, from its own paint to its nation's."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    pairs = supplier.select(F.col("s_suppkey").alias("supplier"), *((F.col(c) % len(EVERY)).cast("int").alias(n) for c, n in (("s_suppkey", "first"), ("s_nationkey", "second"))))
    return mixtures.strips(pairs, mixtures.palette(spark), 48)


# ---- filters

_PX_LIN = f"{PX}, lin AS (SELECT image_id, y, x, {sql.byte_lin('r')} AS v FROM px)"


@query(
    f"""WITH {_PX_LIN}, h AS (SELECT image_id, y, x, avg(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM lin)
SELECT image_id, y, x, round(avg(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM h"""
)
def box_filter_r1(spark, sf_dir):
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", color.byte_to_linear(F.col("r")).alias("v"))
    return filters.box(px, ["v"], 1).select("image_id", "y", "x", F.round("v", 6).alias("v"))


def _boxes(source: str, name: str, columns: list[str], radius: int) -> str:
    part = lambda p, o: ", ".join(f"avg({c}) OVER (PARTITION BY image_id, {p} ORDER BY {o} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS {c}" for c in columns)
    rest = f"* EXCLUDE ({', '.join(columns)})"
    return f"{name}_h AS (SELECT {rest}, {part('y', 'x')} FROM {source}), {name} AS (SELECT {rest}, {part('x', 'y')} FROM {name}_h)"


_GUIDED = f"""lin AS (SELECT image_id, y, x, {', '.join(f'{sql.byte_lin(c)} AS {c}' for c in 'rgb')} FROM px),
sq AS (SELECT *, {', '.join(f'{c} AS m{c}, {c} * {c} AS q{c}' for c in 'rgb')} FROM lin), {_boxes('sq', 'b1', [p + c for p in 'mq' for c in 'rgb'], 1)},
sl AS (SELECT image_id, y, x, r, g, b, {', '.join(f'm{c} AS n{c}, greatest(q{c} - m{c} * m{c}, 0) / (greatest(q{c} - m{c} * m{c}, 0) + 0.1::DOUBLE * 0.1::DOUBLE) AS q{c}' for c in 'rgb')} FROM b1),
ab AS (SELECT image_id, y, x, r, g, b, {', '.join(f'q{c}, (1 - q{c}) * n{c} AS m{c}' for c in 'rgb')} FROM sl), {_boxes('ab', 'b2', [p + c for p in 'mq' for c in 'rgb'], 1)},
out AS (SELECT image_id, y, x, {', '.join(f'q{c} * {c} + m{c} AS {c}' for c in 'rgb')} FROM b2)"""
_CODED = f"SELECT image_id, y, x, {', '.join(f'{sql.encode(c)} AS {c}' for c in 'rgb')} FROM out"


def _shown(df: DataFrame) -> DataFrame:
    _, *rgb = color.channels(F.col("argb"))
    return df.select("image_id", "y", "x", *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))


@query(f"WITH {PX}, {_GUIDED} {_CODED}")
def guided_filter(spark, sf_dir):
    return _shown(filters.guided(fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb"), radius=1, edge=0.1))


_K2 = filters.gaussian_kernel(2)


def _blur(source: str, name: str, fixed: str, moving: str) -> str:
    return f"{name} AS (SELECT p.image_id, p.y, p.x, {', '.join(f'sum(k.w * q.{c}) AS {c}' for c in 'rgb')} FROM {source} p, kern k JOIN {source} q ON q.image_id = p.image_id AND q.{fixed} = p.{fixed} AND q.{moving} = greatest(0, least(7, p.{moving} + k.o)) GROUP BY p.image_id, p.y, p.x)"


@query(f"WITH {PX}, lin AS (SELECT image_id, y, x, {', '.join(f'{sql.byte_lin(c)} AS {c}' for c in 'rgb')} FROM px), kern(o, w) AS (VALUES {', '.join(f'({o}, {w!r}::DOUBLE)' for o, w in enumerate(_K2, -2))}), {_blur('lin', 'hh', 'y', 'x')}, {_blur('hh', 'out', 'x', 'y')} {_CODED}")
def gaussian_blur(spark, sf_dir):
    return _shown(filters.gaussian(fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb"), 2))


# bands of red stand in for candidates, so that 8 by 8 images have regions
_INDEX_SQL = f"{PX}, ind AS (SELECT image_id, y, x, (r // 86)::INT AS cand_idx FROM px)"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", F.floor(F.col("r") / 86).cast("int").alias("cand_idx"))


def _few(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 20.0, 0.0, 0.0), (1, 30.0, 0.0, 0.0), (2, 60.0, 30.0, 10.0)], "cand_idx int, l double, a double, b double").withColumn("argb", F.lit(0))


_MASK = f"""{_INDEX_SQL}, few(cand_idx, l, a, b) AS (VALUES (0, 20.0, 0.0, 0.0), (1, 30.0, 0.0, 0.0), (2, 60.0, 30.0, 10.0)), seen AS (SELECT * FROM ind JOIN few USING (cand_idx)),
mask AS (SELECT p.image_id, p.y, p.x, coalesce(bool_or(pow(p.l - q.l, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2) >= 144), false) AS boundary
  FROM seen p LEFT JOIN seen q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY p.image_id, p.y, p.x)"""


@query(f"WITH {_MASK} SELECT * FROM mask")
def contour_mask(spark, sf_dir):
    return filters.contour_mask(_indexed(spark, sf_dir), _few(spark)).select("image_id", "y", "x", "boundary")


@query(f"WITH {_MASK} SELECT p.image_id, p.y, p.x, bool_or(q.boundary) AS boundary FROM mask p JOIN mask q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.y, p.x")
def dilate(spark, sf_dir):
    return filters.dilate(filters.contour_mask(_indexed(spark, sf_dir), _few(spark)), "boundary", 1).select("image_id", "y", "x", "boundary")


@query(
    f"""WITH {PX}, o AS (SELECT *, unnest(range(3)) AS oy FROM px), oo AS (SELECT *, unnest(range(3)) AS ox FROM o),
w AS (SELECT *, greatest(0, least((oy + 1) * 8 / 3.0::DOUBLE, y + 1) - greatest(oy * 8 / 3.0::DOUBLE, y)) * greatest(0, least((ox + 1) * 8 / 3.0::DOUBLE, x + 1) - greatest(ox * 8 / 3.0::DOUBLE, x)) AS w FROM oo)
SELECT image_id, oy::INT AS y, ox::INT AS x, {', '.join(f'floor(sum(w * {c}) / sum(w) + 1e-9::DOUBLE + 0.5::DOUBLE)::INT AS {c}' for c in 'rgb')} FROM w WHERE w > 0 GROUP BY image_id, oy, ox"""
)
def downsample_preview(spark, sf_dir):
    px = fixtures.pixels(spark, sf_dir)
    sizes = px.select("image_id").distinct().select("image_id", *(F.lit(n).alias(c) for c, n in (("width", 8), ("height", 8), ("to_width", 3), ("to_height", 3))))
    return _shown(filters.downsample(px.select("image_id", "y", "x", "argb"), sizes))


# ---- regions

_LABELS = f"""{_INDEX_SQL}, reach(image_id, y, x, cand_idx, root) AS (
  SELECT image_id, y, x, cand_idx, y * 8 + x FROM ind
  UNION
  SELECT q.image_id, q.y, q.x, q.cand_idx, p.root FROM reach p JOIN ind q ON q.image_id = p.image_id AND q.cand_idx = p.cand_idx AND abs(q.x - p.x) + abs(q.y - p.y) = 1 WHERE p.root < q.y * 8 + q.x
), rooted AS (SELECT image_id, y, x, cand_idx, min(root) AS root FROM reach GROUP BY ALL),
lab AS (SELECT image_id, y, x, cand_idx, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS region_id FROM rooted)"""


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, y, x, cand_idx, region_id FROM lab")
def region_labels(spark, sf_dir):
    return regions.labels(_indexed(spark, sf_dir))


@query(f"WITH RECURSIVE {_LABELS} SELECT image_id, y, x, cand_idx, region_id FROM lab")
def region_labels_tiled(spark, sf_dir):
    """The same from tiles of 3 by 3 pixels, as of images that do not fit a worker."""
    return regions.labels_tiled(_indexed(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {_LABELS}, area AS (SELECT image_id, region_id, count(*) AS n FROM lab GROUP BY ALL)
SELECT image_id, count(*) AS regions, sum(CASE WHEN n < 4 THEN n ELSE 0 END) / sum(n)::DOUBLE AS fraction FROM area GROUP BY image_id""")
def region_area_stats(spark, sf_dir):
    labelled = regions.labels(_indexed(spark, sf_dir))
    return regions.count_regions(labelled).join(regions.small_fraction(labelled, 4), "image_id")


@query()
def small_region_merge(spark, sf_dir):
    return regions.merge_small(_indexed(spark, sf_dir), MARK)


@query()
def region_graph_merge(spark, sf_dir):
    """The same from tiles and the graph of an image's regions."""
    return regions.merge_regions(regions.labels_tiled(_indexed(spark, sf_dir), 3), MARK)


@query(f"""WITH RECURSIVE {_LABELS}, few(cand_idx, l, a, b) AS (VALUES (0, 20.0, 0.0, 0.0), (1, 30.0, 0.0, 0.0), (2, 60.0, 30.0, 10.0)),
area AS (SELECT image_id, region_id, any_value(cand_idx) AS cand_idx, count(*) AS n, bool_or(x IN (0, 7) OR y IN (0, 7)) AS edge FROM lab GROUP BY image_id, region_id),
field AS (SELECT image_id, arg_max(region_id, n * 1000 - region_id) AS region_id, arg_max(cand_idx, n * 1000 - region_id) AS cand_idx FROM area WHERE edge AND n >= 4 GROUP BY image_id),
want AS (SELECT cand_idx, 58.0 AS l, a * f AS a, b * f AS b FROM (SELECT *, CASE WHEN sqrt(a * a + b * b) <= 1e-9 THEN 0 ELSE least(0.35 * sqrt(a * a + b * b), 25) / sqrt(a * a + b * b) END AS f FROM few)),
swap AS (SELECT w.cand_idx, arg_min(c.cand_idx, round(1.5 * pow(w.l - c.l, 2) + pow(w.a - c.a, 2) + pow(w.b - c.b, 2), 8) * 10 + c.cand_idx) AS ground FROM want w, few c GROUP BY w.cand_idx)
SELECT p.image_id, p.y, p.x, CASE WHEN f.region_id = p.region_id THEN s.ground ELSE p.cand_idx END AS cand_idx FROM lab p LEFT JOIN field f ON f.image_id = p.image_id LEFT JOIN swap s ON s.cand_idx = f.cand_idx""")
def ground_fill(spark, sf_dir):
    return regions.ground_fill(_indexed(spark, sf_dir), _few(spark), 1.0)


@query(f"""WITH {_MASK}, line AS (SELECT arg_min(cand_idx, 1.5 * pow(l - 35, 2) + pow(a - 5, 2) + pow(b + 15, 2)) AS paint FROM few),
wide AS (SELECT p.image_id, p.y, p.x, bool_or(q.boundary) AS boundary FROM mask p JOIN mask q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.y, p.x)
SELECT i.image_id, i.y, i.x, CASE WHEN w.boundary THEN line.paint ELSE i.cand_idx END AS cand_idx FROM ind i JOIN wide w USING (image_id, y, x), line""")
def contour_lines(spark, sf_dir):
    return regions.contour_lines(_indexed(spark, sf_dir), _few(spark), MARK).select("image_id", "y", "x", "cand_idx")


# ---- palettes, recipes, wheels


@query()
def kmeans_palette(spark, sf_dir):
    return palette.kmeans(palette.histogram(fixtures.pixels(spark, sf_dir)), 8)


@query()
def image_palette(spark, sf_dir):
    return palette.image_palette(fixtures.pixels(spark, sf_dir), _cands(spark), 8)


@query(
    """WITH s AS (SELECT l_orderkey % 97 AS a, l_partkey % 31 + 1 AS b, l_suppkey % 7 AS c FROM lineitem),
d AS (SELECT DISTINCT a, b, c FROM s), n AS (SELECT *, a * 10000 + b * 100 + c AS id, [a, b, c] AS v, a + b + c AS t FROM d),
w AS (SELECT id, t, i, v[i]::DOUBLE / t * 100 AS p FROM n, (SELECT unnest([1, 2, 3]) AS i)),
f AS (SELECT *, floor(p)::INT AS whole, p - floor(p) AS rest FROM w),
m AS (SELECT *, 100 - sum(whole) OVER (PARTITION BY id) AS missing, row_number() OVER (PARTITION BY id ORDER BY round(rest, 9) DESC, i) AS k FROM f),
r AS (SELECT *, whole + CASE WHEN k <= missing THEN 1 ELSE 0 END AS q FROM m),
z AS (SELECT *, sum(CASE WHEN q < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS zeros, row_number() OVER (PARTITION BY id ORDER BY q DESC, i) AS top FROM r)
SELECT id, max(CASE WHEN i = 1 THEN f END) AS p1, max(CASE WHEN i = 2 THEN f END) AS p2, max(CASE WHEN i = 3 THEN f END) AS p3
FROM (SELECT id, i, (CASE WHEN q < 1 THEN 1 ELSE q - CASE WHEN top = 1 THEN zeros ELSE 0 END END)::INT AS f FROM z) GROUP BY id"""
)
def recipe_percentages(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = line.select((F.col("l_orderkey") % 97).alias("a"), (F.col("l_partkey") % 31 + 1).alias("b"), (F.col("l_suppkey") % 7).alias("c")).distinct()
    total = F.col("a") + F.col("b") + F.col("c")
    shares = parts.select((F.col("a") * 10000 + F.col("b") * 100 + F.col("c")).alias("id"), recipes.percentages(F.array(*(F.col(c) / total for c in "abc"))).alias("p"))
    return shares.select("id", *(F.col("p")[i].alias(f"p{i + 1}") for i in range(3)))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(fixtures.colours(spark, sf_dir))


@query()
def closest_blends(spark, sf_dir):
    """Recipes of all paints for a table of colours asked for: every part's."""
    return recipes.closest_blends(_targets(spark, sf_dir), mixtures.palette(spark, EVERY))


@query()
def recipe_lines(spark, sf_dir):
    paints = mixtures.palette(spark, EVERY)
    return recipes.recipe_lines(recipes.closest_blends(_targets(spark, sf_dir), paints), paints)


@query()
def recipe_matches(spark, sf_dir):
    """The recipes of every part's colour, mixed again as they are shown."""
    return recipes.to_match(_targets(spark, sf_dir), mixtures.palette(spark, EVERY))


@query()
def pixel_recipes(spark, sf_dir):
    """What is told of a pixel near the middle of every image."""
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb")
    points = px.select("image_id", F.lit(3).alias("x"), F.lit(4).alias("y")).distinct()
    return recipes.recipes_at(px, points, mixtures.palette(spark, EVERY))


_INNER = f"(m / ({(1 - pigments.SAUNDERSON_K1) * (1 - pigments.SAUNDERSON_K2)!r}::DOUBLE + {pigments.SAUNDERSON_K2}::DOUBLE * m))"


@query(f"""WITH {sql.pigment_ctes(EVERY)},
said AS (SELECT vec_id AS id, band, round(least(1, abs(embedding[greatest(0, least(30, band - 2)) + 1]::DOUBLE) * 2) * 100, 2) / 100 AS m FROM embeddings, (SELECT unnest(range({pigments.BANDS})) AS band)),
held AS (SELECT id, band, greatest(1e-6::DOUBLE, least(1 - 1e-9::DOUBLE, {_INNER})) AS r FROM said),
q AS (SELECT id, band, (1 - r) * (1 - r) / (2 * r) AS q FROM held),
seen AS (SELECT id, band, {(1 - pigments.SAUNDERSON_K1) * (1 - pigments.SAUNDERSON_K2)!r}::DOUBLE * (1 + q - sqrt(q * q + 2 * q)) / (1 - {pigments.SAUNDERSON_K2}::DOUBLE * (1 + q - sqrt(q * q + 2 * q))) AS r FROM q),
xyz AS (SELECT id, sum(xb * r) / {pigments.NORM!r}::DOUBLE AS x, sum(yb * r) / {pigments.NORM!r}::DOUBLE AS y, sum(zb * r) / {pigments.NORM!r}::DOUBLE AS z FROM seen JOIN bands USING (band) GROUP BY id)
SELECT id AS paint_idx, format('Vector {{}} |  | derived | {{:.2f}} | {{:.2f}} | {{:.2f}}', id, {', '.join(sql.lab_columns('x', 'y', 'z'))}) AS value FROM xyz""")
def paint_manifest(spark, sf_dir):
    """Manifest lines of paints derived from spectra, one an embedding."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("name", F.concat(F.lit("Vector "), F.col("vec_id").cast("string")))
    percent = F.transform(F.slice("embedding", 1, 31), lambda x: F.round(F.least(F.lit(1.0), F.abs(x.cast("double")) * 2) * 100, 2).cast("string"))
    new = images.derive_pigments(rows.select("name", percent.alias("pct")), mixtures.palette(spark))
    number = F.substring_index("name", " ", -1).cast("long")
    return pigment_files.manifest(new.select(number.alias("paint_idx"), "name", F.lit("").alias("colour_index"), F.lit("derived").alias("provenance"), "k", "s"))


_ON_WHEEL = lambda n: f"""inside AS (SELECT *, greatest(0, least(1, radius - distance)) AS alpha, CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END * {n} / (2 * pi()) AS pos FROM far WHERE radius - distance > 0),
turned AS (SELECT *, CASE WHEN floor(pos) >= {n} THEN 0 ELSE floor(pos)::INT END AS lower, CASE WHEN floor(pos) >= {n} THEN 0 ELSE pos - floor(pos) END AS blend, least(distance / radius, 1) AS rim FROM inside),
w AS (SELECT id, paint, (1 - rim) / {n} + CASE WHEN paint = lower THEN rim * (1 - blend) ELSE 0 END + CASE WHEN paint = (lower + 1) % {n} THEN rim * blend ELSE 0 END AS weight FROM turned, (SELECT unnest(range({n}))::INT AS paint))"""  # noqa: E731


@query(f"WITH {fixtures.POINTS_SQL}, {_ON_WHEEL(6)} SELECT id, paint, round(weight, 6) AS weight FROM w")
def wheel_weights(spark, sf_dir):
    """What a wheel of six paints is made of at each part's point."""
    return wheel.weights(fixtures.wheel_points(spark, sf_dir), 6).select("id", "paint", F.round("weight", 6).alias("weight"))


_SIGNED = lambda a: f"(CASE WHEN {a} >= 128 THEN {a} - 256 ELSE {a} END) * 16777216"


@query(f"""WITH RECURSIVE {sql.pigment_ctes(EVERY)}, {fixtures.POINTS_SQL}, {_ON_WHEEL(len(EVERY))}, parts AS (SELECT id, paint AS paint_idx, weight AS share FROM w),
{sql.mix_ctes('parts', 'mx')}, {_linear_sql('mx')}, solid AS (SELECT id, floor(alpha * 255)::INT AS cover, {sql.encode('r')} * 65536 + {sql.encode('g')} * 256 + {sql.encode('b')} AS rgb FROM m JOIN inside USING (id))
SELECT far.id, far.y, far.x, coalesce({_SIGNED('cover')} + rgb, 0)::INT AS argb FROM far LEFT JOIN solid USING (id)""")
def paint_wheel(spark, sf_dir):
    """The paint wheel under each part's point."""
    return wheel.paint_wheel(fixtures.wheel_points(spark, sf_dir), mixtures.palette(spark)).select("id", "y", "x", "argb")


_HUES = [f"{h}::DOUBLE" for h in wheel.DISPLAY_HUES]
_TRADITIONAL_SQL = f"""shade AS (SELECT id, y, x, greatest(0, least(1, radius + 0.5 - distance)) AS cover, CASE WHEN degrees(atan2(dx, -dy)) < 0 THEN degrees(atan2(dx, -dy)) + 360 ELSE degrees(atan2(dx, -dy)) END AS artist, least(1::DOUBLE, distance / radius) AS s FROM far),
turn AS (SELECT *, [{', '.join(_HUES)}][k + 1] + ([{', '.join(_HUES)}][k + 2] - [{', '.join(_HUES)}][k + 1]) * (artist - k * 60.0::DOUBLE) / 60.0::DOUBLE AS hue FROM (SELECT *, least(5, floor(artist / 60)::INT) AS k FROM shade)),
hsv AS (SELECT *, hue / 60.0::DOUBLE AS h, s * (1 - abs(fmod(hue / 60.0::DOUBLE, 2::DOUBLE) - 1)) AS c FROM turn),
tone AS (SELECT *, CASE WHEN h < 1 THEN [s, c, 0] WHEN h < 2 THEN [c, s, 0] WHEN h < 3 THEN [0, s, c] WHEN h < 4 THEN [0, c, s] WHEN h < 5 THEN [c, 0, s] ELSE [s, 0, c] END AS v FROM hsv),
art AS (SELECT id, y, x, CASE WHEN cover > 0 THEN round_even(cover * 255, 0)::INT ELSE 0 END AS a, {', '.join(f'round_even((v[{i + 1}] + 1 - s) * 255, 0)::INT AS {n}' for i, n in enumerate('rgb'))} FROM tone),
artist AS (SELECT id, y, x, a, r, g, b, CASE WHEN a = 0 AND NOT EXISTS (SELECT 1 FROM shade z WHERE z.id = art.id AND z.cover > 0) THEN 0 ELSE {_SIGNED('a')} + r * 65536 + g * 256 + b END::INT AS argb FROM art)"""


@query(f"WITH {fixtures.POINTS_SQL}, {_TRADITIONAL_SQL} SELECT id, y, x, argb FROM artist")
def traditional_wheel(spark, sf_dir):
    """The artists' wheel under each part's point."""
    return wheel.traditional_wheel(fixtures.wheel_points(spark, sf_dir)).select("id", "y", "x", "argb")


@query(f"""WITH {fixtures.POINTS_SQL}, {_ON_WHEEL(len(EVERY))}, names(paint, name) AS (VALUES {_NAMES}),
ranked AS (SELECT id, name, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, paint) AS rank FROM w JOIN names USING (paint) WHERE weight > 0),
top AS (SELECT id, rank::INT AS rank, name || ': ' || round_even(weight * 100, 0)::INT || '%' AS line FROM ranked WHERE rank <= 5 AND weight >= {recipes.LEAST_SHARE}),
rest AS (SELECT id, count(*) AS n, sum(weight) AS share FROM ranked WHERE NOT (rank <= 5 AND weight >= {recipes.LEAST_SHARE}) GROUP BY id)
SELECT id, rank, line FROM top UNION ALL SELECT id, 6, '+' || n || ' more: ' || round_even(share * 100, 0)::INT || '%' FROM rest WHERE share >= {recipes.LEAST_SHARE}""")
def wheel_lines(spark, sf_dir):
    """What is told of the paint wheel at each part's point."""
    return wheel.lines(fixtures.wheel_points(spark, sf_dir), mixtures.palette(spark))


@query(f"WITH {fixtures.POINTS_SQL}, {_TRADITIONAL_SQL} SELECT id, 1 AS rank, 'RGB: ' || r || ', ' || g || ', ' || b AS line FROM artist WHERE a > 0")
def hue_lines(spark, sf_dir):
    """What is told of the artists' wheel at each part's point: the colour only."""
    return wheel.hue_lines(fixtures.wheel_points(spark, sf_dir))


# ---- styles


def _style(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        style = styles.by_name(name)
        cands = _cands(spark, name)
        px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb")
        return styles.render(px, style, cands, mark=MARK)

    return run


def _realism_sql() -> str:
    """The whole Realism chain: guided filter, bins, nearest candidate, composition."""
    shown = f"shown8 AS ({_CODED}), keyed AS (SELECT image_id, y, x, {_KEY} AS id FROM shown8), bins AS (SELECT DISTINCT id, (((id >> 12) & 63) * 4 + 2) AS r, (((id >> 6) & 63) * 4 + 2) AS g, ((id & 63) * 4 + 2) AS b FROM keyed), {sql.lab_ctes('bins', 'q')}"
    return f"WITH RECURSIVE {PX}, {_GUIDED}, {shown}, {_argb_sql(EVERY)}, near AS ({_nearest_sql('q', '1')}) SELECT k.image_id, k.y, k.x, n.cand_idx, (-16777216 + c.r * 65536 + c.g * 256 + c.b)::INT AS argb FROM keyed k JOIN near n USING (id) JOIN cand c USING (cand_idx)"


for _name in styles.STYLES:
    QUERIES[f"style_{_name.lower().replace('-', '_')}"] = _style(_name)
ORACLES["style_realism"] = _realism_sql()


@query(f"""WITH {PX}, listed AS (SELECT image_id, list((4278190080 + r * 65536 + g * 256 + b)::HUGEINT ORDER BY y, x) AS p FROM px GROUP BY image_id)
SELECT image_id, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, p), lambda h, v: (xor(h, v) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS checksum FROM listed""")
def image_checksums(spark, sf_dir):
    return images.checksum(fixtures.pixels(spark, sf_dir))


@query("SELECT id AS image_id, y::INT AS y, x::INT AS x, (-16777216 + " + " + ".join(f"greatest(0, least(255, {e} + n)) * {m}" for m, e in ((65536, "x * 255 // greatest(1, w - 1)"), (256, "y * 255 // greatest(1, h - 1)"), (1, "(x + y) * 255 // greatest(1, w + h - 2)")))
       + ")::INT AS argb FROM (SELECT *, (xor(x * 73856093, y * 19349663) & 15) - 8 AS n FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM (SELECT s_suppkey AS id, s_suppkey % 13 + 1 AS w, s_nationkey % 7 + 1 AS h FROM supplier))))")
def noisy_gradient(spark, sf_dir):
    """A gradient for each supplier, of a size of its own."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return fixtures.noisy_gradients(supplier.select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 13 + 1).cast("int").alias("width"), (F.col("s_nationkey") % 7 + 1).cast("int").alias("height")))


# ---- sources, text and streams


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), '') AS id, len(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*?\bsrc\s*=\s*["'']([^"'']+)["'']', 1), lambda u: regexp_matches(u, '(?i)^https?://')))::INT AS images FROM pages""")
def page_images(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", images.query_value(F.col("url"), "id").alias("id"), F.size(images.image_sources(F.col("html"))).alias("images"))


@query(r"""SELECT page_id, coalesce(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*?\bsrc\s*=\s*["'']([^"'']+)["'']', 1), lambda u: regexp_matches(u, '(?i)^https?://'))[1],
CASE WHEN regexp_matches(url, '(?i)^https?://[^?#]*\.(png|jpe?g|jfif|bmp|gif|tiff?|webp|avif|hei[cf]|psd)([?#]|$)') THEN url END) AS source FROM pages""")
def page_sources(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", images.page_source(F.col("url"), F.col("html")).alias("source"))


@query("""SELECT image_id, axis, n * i / 4.0::DOUBLE AS at FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings), (SELECT unnest(['x', 'y']) AS axis, 8 AS n), (SELECT unnest(range(5)) AS i)""")
def grid_segments(spark, sf_dir):
    sizes = fixtures.pixels(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"))
    return images.grid_segments(sizes, 4)


def _micros(name: str) -> Column:
    """Microseconds of a time without zone, whatever the session's zone is."""
    return F.unix_micros(F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()))


@query(
    """WITH e AS (SELECT ts, user_id AS key, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation FROM events),
m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY key ORDER BY generation) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY generation) AS burst FROM m)
SELECT key, epoch_us(min(ts)) AS start_us, count(*) AS n, max(generation) AS generation, round(arg_max(value, generation), 6) AS payload FROM s GROUP BY key, burst"""
)
def session_debounce(spark, sf_dir):
    bursts = requests.debounce(fixtures.requests(spark, sf_dir), "6 hours")
    return bursts.select("key", _micros("start").alias("start_us"), "n", "generation", F.round("payload", 6).alias("payload"))


@query(
    """WITH e AS (SELECT user_id AS key, value, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'load' ELSE 'change' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation FROM events)
SELECT key, kind, max(generation) AS generation, round(arg_max(value, generation), 6) AS payload FROM e GROUP BY key, kind"""
)
def latest_generation(spark, sf_dir):
    return requests.latest_values(fixtures.requests(spark, sf_dir)).select("key", "kind", "generation", F.round("payload", 6).alias("payload"))


@query(
    """WITH e AS (SELECT ts, user_id AS key, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation FROM events),
m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY key ORDER BY generation) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY generation) AS burst FROM m),
b AS (SELECT key, epoch_us(min(ts)) AS start_us, max(generation) AS generation, arg_max(event_type, generation) AS last FROM s GROUP BY key, burst)
SELECT key, start_us, generation, pass FROM b, (SELECT unnest(['preview', 'full']) AS pass) WHERE last <> 'error'"""
)
def cancelled_bursts(spark, sf_dir):
    live = requests.live_bursts(fixtures.requests(spark, sf_dir), "6 hours")
    return requests.passes(live).select("key", _micros("start").alias("start_us"), "generation", "pass")



_HOUR = 3_600_000
_DURATIONS = {"gap": 2 * _HOUR, "preview": _HOUR, "full": 6 * _HOUR}
_KINDS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixtures.SESSION_KINDS.items())
_SCHEDULE_SQL = f"""WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS generation, value AS payload, CASE event_type {_KINDS_SQL} ELSE 'change' END AS kind FROM events),
g AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('begin', 'end') THEN kind END IGNORE NULLS) OVER w = 'begin', false) AS closed,
  last_value(CASE WHEN kind IN ('load', 'change') THEN generation END IGNORE NULLS) OVER w AS set_last,
  sum(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) OVER w - CASE WHEN kind = 'end' THEN 1 ELSE 0 END AS operation FROM e WINDOW w AS (PARTITION BY key ORDER BY ms, generation)),
o AS (SELECT *, bool_or(kind = 'load' AND closed) OVER (PARTITION BY key, operation) AS owed FROM g),
a AS (SELECT *, CASE WHEN kind = 'end' THEN owed ELSE kind IN ('load', 'change') AND NOT closed END AS asks, CASE WHEN kind = 'end' THEN owed ELSE kind <> 'change' OR NOT closed END AS stops FROM o),
u AS (SELECT *, min(CASE WHEN stops THEN ms END) OVER (PARTITION BY key ORDER BY ms, generation ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM a)
SELECT u.key, u.set_last AS generation, round(e.payload, 6) AS payload, f.pass, u.ms + f.wait AS shown_ms
FROM u JOIN e ON e.key = u.key AND e.generation = u.set_last, (VALUES ('preview', {_DURATIONS["gap"] + _DURATIONS["preview"]}), ('full', {sum(_DURATIONS.values())})) f(pass, wait)
WHERE u.asks AND (u.until IS NULL OR u.ms + f.wait <= u.until)"""


@query(_SCHEDULE_SQL)
def render_schedule(spark, sf_dir):
    """The frames that every session shows, by windows over its events."""
    return scheduler.schedule(fixtures.sessions(spark, sf_dir), **_DURATIONS).withColumn("payload", F.round("payload", 6))


@query(_SCHEDULE_SQL)
def render_schedule_stream(spark, sf_dir):
    """The same frames from the state machine, to which the events come as a stream."""
    frames = scheduler.drained(fixtures.sessions(spark, sf_dir), lambda s: scheduler.scheduled(s, **_DURATIONS), scheduler.FRAMES_DDL, scratch.folder(spark, "sessions"))
    return frames.withColumn("payload", F.round("payload", 6))


@query(f"WITH RECURSIVE {fixtures.GESTURES_SQL} SELECT key, generation, floor(s * 100000 + 0.37::DOUBLE) / 100000 AS scale, floor(x * 1000 + 0.37::DOUBLE) / 1000 AS offset_x, floor(y * 1000 + 0.37::DOUBLE) / 1000 AS offset_y FROM v WHERE n > 0")
def viewports(spark, sf_dir):
    """Every user's view after each of their events, taken as gestures; to a fraction of a pixel."""
    seen = viewport.views(fixtures.gestures(spark, sf_dir))
    fine = lambda c, n: (F.floor(F.col(c) * n + 0.37) / n).alias(c)  # noqa: E731  views lie on round numbers
    return seen.select("key", "generation", fine("scale", 100_000), fine("offset_x", 1000), fine("offset_y", 1000))


@query(f"WITH {PX} SELECT unnest(['pre-map', 'colour map', 'post-map', 'compose']) AS phase, (SELECT count(*) FROM px) AS rows")
def render_phases(spark, sf_dir):
    """Rows of the phases of a Realism render of all images; ``benchmark`` tells seconds, too."""
    taken = phases.Phases(spark)
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "argb")
    styles.render(px, styles.by_name("Realism"), _cands(spark), mark=MARK, phases=taken)
    return taken.table().select("phase", "rows")
