"""Pixel, colour and event views over the driver's tables, and generated images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, pigments

SIDE = 8


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b, argb: each 64-component embedding as an 8 by 8 image."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.size("embedding") >= 64)
    longer = F.raise_error(F.lit("an image has 64 components"))
    rows = rows.withColumn("embedding", F.when(F.size("embedding") == 64, F.col("embedding")).otherwise(longer))
    at = rows.select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    level = lambda shift: F.floor(color.clamp((F.get("embedding", (F.col("i") + shift) % 64).cast("double") + 0.4) / 0.8, 0, 1) * 255).cast("int")
    out = at.select("image_id", (F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), *(level(s).alias(c) for s, c in ((0, "r"), (21, "g"), (42, "b"))))
    return out.withColumn("argb", color.pack(F.lit(255), F.col("r"), F.col("g"), F.col("b")))


PIXELS_SQL = """px AS (
  SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x,
    floor(greatest(0, least(1, (embedding[i + 1]::DOUBLE + 0.4::DOUBLE) / 0.8::DOUBLE)) * 255)::INT AS r,
    floor(greatest(0, least(1, (embedding[(i + 21) % 64 + 1]::DOUBLE + 0.4::DOUBLE) / 0.8::DOUBLE)) * 255)::INT AS g,
    floor(greatest(0, least(1, (embedding[(i + 42) % 64 + 1]::DOUBLE + 0.4::DOUBLE) / 0.8::DOUBLE)) * 255)::INT AS b
  FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) >= 64
)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, r, g, b: part keys hashed to 24-bit colours."""
    key = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    h = (F.col("id") * F.lit(2654435761)) % F.lit(1 << 24)
    return key.select("id", *((F.shiftright(h, s).bitwiseAND(F.lit(255).cast("long"))).cast("int").alias(c) for s, c in ((16, "r"), (8, "g"), (0, "b"))))


COLOURS_SQL = """colours AS (
  SELECT p_partkey AS id, ((h >> 16) & 255)::INT AS r, ((h >> 8) & 255)::INT AS g, (h & 255)::INT AS b
  FROM (SELECT p_partkey, (p_partkey * 2654435761) % 16777216 AS h FROM part)
)"""


def solid(spark: SparkSession, width: int, height: int, argb: int, image_id: int = 0) -> DataFrame:
    """An image of one colour."""
    return _grid(spark, width, height, image_id).withColumn("argb", F.lit(argb))


def noisy_gradients(sizes: DataFrame) -> DataFrame:
    """image_id, y, x, argb of gradients with hash noise, the same for a size every time.

    ``sizes``: image_id, width, height.
    """
    noise = ((F.col("x").cast("long") * 73856093).bitwiseXOR(F.col("y").cast("long") * 19349663)).bitwiseAND(F.lit(15).cast("long")) - 8
    level = lambda n, d: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(n * 255 / F.greatest(d, F.lit(1))) + noise)).cast("int")
    rows = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    grid = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    x, y, width, height = (F.col(c) for c in ("x", "y", "width", "height"))
    return grid.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", color.pack(F.lit(255), level(x, width - 1), level(y, height - 1), level(x + y, width + height - 2)).alias("argb"))


def noisy_gradient(spark: SparkSession, width: int, height: int, image_id: int = 0) -> DataFrame:
    return noisy_gradients(spark.createDataFrame([(image_id, width, height)], "image_id long, width int, height int"))


def _grid(spark: SparkSession, width: int, height: int, image_id: int) -> DataFrame:
    return spark.range(width * height).select(F.lit(image_id).cast("long").alias("image_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


#: Paints of the palette, that keys are taken modulo of.
PAINTS = len(pigments.PALETTE)


def recipes_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, supplier, parts: each order line as a mixture of up to three paints, equal ones added up."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    added = line.groupBy(*keys).agg(F.sum("l_quantity").alias("first"), F.sum(F.col("l_discount") * 100 + 1).alias("second"), F.sum(F.col("l_tax") * 100).alias("third"))
    part = lambda paint, share: F.struct((F.col(paint) % PAINTS).cast("int").alias("paint_idx"), F.col(share).cast("double").alias("share"))
    parts = F.array(part("l_partkey", "first"), part("l_suppkey", "second"), part("l_orderkey", "third"))
    ordinal = (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    return added.select(ordinal.alias("ordinal"), F.col("l_suppkey").alias("supplier"), parts.alias("parts"))


LINES_SQL = f"""line AS (SELECT ((l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey)::BIGINT AS id, l_suppkey AS supplier, (l_partkey % {PAINTS})::INT AS p1, sum(l_quantity)::DOUBLE AS s1,
  (l_suppkey % {PAINTS})::INT AS p2, sum(l_discount * 100 + 1)::DOUBLE AS s2, (l_orderkey % {PAINTS})::INT AS p3, sum(l_tax * 100)::DOUBLE AS s3 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
parts AS (SELECT id, p1 AS paint_idx, s1 AS share FROM line UNION ALL SELECT id, p2, s2 FROM line UNION ALL SELECT id, p3, s3 FROM line)"""


def wheel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, x, diameter: each part as a point of a wheel of its own size."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    at = part.select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") + 15).cast("int").alias("diameter"))
    return at.select("id", (F.col("id") * 7919 % F.col("diameter")).cast("int").alias("y"), (F.col("id") * 104729 % F.col("diameter")).cast("int").alias("x"), "diameter")


POINTS_SQL = """pts AS (SELECT *, x - (d - 1) / 2.0::DOUBLE AS dx, y - (d - 1) / 2.0::DOUBLE AS dy, d / 2.0::DOUBLE AS radius
  FROM (SELECT id, d, (id * 7919 % d)::INT AS y, (id * 104729 % d)::INT AS x FROM (SELECT p_partkey::BIGINT AS id, (p_size + 15)::INT AS d FROM part))),
far AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance FROM pts)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, key, kind, generation, payload: events as requests of one session a user."""
    from pyspark.sql import Window as W

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "purchase", "load").otherwise("change")
    return events.select("ts", F.col("user_id").alias("key"), kind.alias("kind"), rank.cast("long").alias("generation"), F.col("value").alias("payload"))


#: Kinds of a session's events by their types; the rest are changes.
SESSION_KINDS = {"error": "cancel", "purchase": "load", "signup": "begin", "view": "end"}


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, key, kind, generation, payload: events as those of one session a user, times taken as UTC."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.lit("change")
    for name, of in SESSION_KINDS.items():
        kind = F.when(F.col("event_type") == name, of).otherwise(kind)
    ts = F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()) if dict(events.dtypes)["ts"] == "timestamp" else F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return events.select(ts.alias("ts"), F.col("user_id").alias("key"), kind.alias("kind"), F.col("event_id").alias("generation"), F.col("value").alias("payload"))


def gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gestures on one view a user, for ``viewport.views``; times taken as UTC."""
    n, kind = F.col("event_id"), F.col("event_type")
    by_kind = lambda **of: F.coalesce(*(F.when(kind == k, v) for k, v in of.items()), F.lit(0.0))
    side = lambda m, a: (n % m).cast("double") - a
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    what = F.when(kind.isin("click", "view"), "zoom").when(kind.isin("signup", "purchase"), "pan").otherwise(F.when(n % 5 == 0, "fit").otherwise("resize"))
    p = by_kind(click=F.lit(1.5), view=F.lit(0.75), signup=side(301, 150), purchase=side(97, 48), error=side(400, -500))
    q = by_kind(click=side(800, 0), view=side(700, 0), signup=side(211, 105), purchase=side(89, 44), error=side(300, -400))
    sizes = {"width": F.col("user_id") % 7 * 300 + 400, "height": F.col("user_id") % 5 * 200 + 300, "view_width": F.lit(800), "view_height": F.lit(600)}
    return events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), n.alias("generation"), what.alias("kind"), p.alias("p"), q.alias("q"), side(600, 0).alias("r"), *(c.alias(k) for k, c in sizes.items()))


GESTURES_SQL = """g AS (
  SELECT user_id AS key, event_id AS generation, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE WHEN event_type IN ('click', 'view') THEN 'zoom' WHEN event_type IN ('signup', 'purchase') THEN 'pan' WHEN event_id % 5 = 0 THEN 'fit' ELSE 'resize' END AS kind,
    CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.75 WHEN 'signup' THEN event_id % 301 - 150 WHEN 'purchase' THEN event_id % 97 - 48 WHEN 'error' THEN event_id % 400 + 500 ELSE 0 END::DOUBLE AS p,
    CASE event_type WHEN 'click' THEN event_id % 800 WHEN 'view' THEN event_id % 700 WHEN 'signup' THEN event_id % 211 - 105 WHEN 'purchase' THEN event_id % 89 - 44 WHEN 'error' THEN event_id % 300 + 400 ELSE 0 END::DOUBLE AS q,
    (event_id % 600)::DOUBLE AS r, (user_id % 7 * 300 + 400)::DOUBLE AS w, (user_id % 5 * 200 + 300)::DOUBLE AS h FROM events
), v AS (
  SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS generation, w, h, 800::DOUBLE AS vw, 600::DOUBLE AS vh, least(800 / w, 600 / h) AS s, (800 - w * least(800 / w, 600 / h)) / 2 AS x, (600 - h * least(800 / w, 600 / h)) / 2 AS y FROM g
  UNION ALL
  SELECT key, n, generation, w, h, vw, vh, s2, CASE WHEN w * s2 <= vw THEN (vw - w * s2) / 2 ELSE least(0, greatest(vw - w * s2, x2)) END, CASE WHEN h * s2 <= vh THEN (vh - h * s2) / 2 ELSE least(0, greatest(vh - h * s2, y2)) END
  FROM (SELECT *, CASE kind WHEN 'zoom' THEN q - (q - x) / s * s2 WHEN 'pan' THEN x + p ELSE x END AS x2, CASE kind WHEN 'zoom' THEN r - (r - y) / s * s2 WHEN 'pan' THEN y + q ELSE y END AS y2
    FROM (SELECT *, CASE kind WHEN 'zoom' THEN greatest(fit, least(fit * 16, s * p)) WHEN 'fit' THEN fit WHEN 'resize' THEN CASE WHEN s <= was THEN fit ELSE greatest(s, fit) END ELSE s END AS s2
      FROM (SELECT *, least(vw / w, vh / h) AS fit FROM (
        SELECT g.*, v.s, v.x, v.y, least(v.vw / g.w, v.vh / g.h) AS was, CASE WHEN g.kind = 'resize' THEN g.p ELSE v.vw END AS vw, CASE WHEN g.kind = 'resize' THEN g.q ELSE v.vh END AS vh FROM v JOIN g ON g.key = v.key AND g.n = v.n + 1))))
)"""
