"""Mixing pigments: enumeration of mixtures, band sums, rendering, distinct candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color, pigments
from .nearest import collected

PAIR_STEPS, TRIPLE_STEPS = 64, 16


def library_order():
    """The order of a palette, a short list."""
    return W.orderBy("paint_idx")


def palette(spark: SparkSession, indices: list[int] | None = None) -> DataFrame:
    """The built-in pigments, or those at ``indices``, always in library order."""
    rows = [p for p in pigments.PALETTE if indices is None or p[0] in indices]
    return spark.createDataFrame(rows, pigments.PIGMENT_DDL)


def selectable(paints: DataFrame) -> DataFrame:
    """Only measured pigments can be chosen."""
    return paints.filter(F.col("provenance") == "measured")


def by_names(paints: DataFrame, names: DataFrame) -> DataFrame:
    """Pigments whose names are listed, in library order; all of them if none is."""
    chosen = paints.join(names.select("name").distinct(), "name", "left_semi")
    return chosen if chosen.limit(1).count() else paints


def bands(spark: SparkSession) -> DataFrame:
    rows = [(b, pigments.START_NM + b * pigments.STEP_NM, *(o[b] for o in pigments.OBSERVERS)) for b in range(pigments.BANDS)]
    return spark.createDataFrame(rows, "band int, nm int, xbar double, ybar double, zbar double")


def enumerate_mixtures(paints: DataFrame) -> DataFrame:
    """ordinal, parts(paint_idx, share): every paint, pair and triple on its share grid.

    n + 63 C(n, 2) + 105 C(n, 3) rows, in library order. Paints are a short list (18 in the
    library), so that their theta-joins are broadcast.
    """
    one = paints.select(F.row_number().over(library_order()).alias("i"), "paint_idx")
    n = F.lit(one.count())
    a, b, c = (one.select(F.col("i").alias(x), F.col("paint_idx").alias(f"p{x}")) for x in "abc")
    part = lambda p, s: F.struct(F.col(p).cast("int").alias("paint_idx"), s.cast("double").alias("share"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    triples = pairs.join(F.broadcast(c), F.col("b") < F.col("c"))
    step = lambda name, to: F.explode(F.sequence(F.lit(1), F.lit(to))).alias(name)
    singles = a.select(F.lit(1).alias("size"), "a", F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("u"), F.lit(0).alias("v"), F.array(part("pa", F.lit(1.0))).alias("parts"))
    u = F.col("u") / PAIR_STEPS
    doubles = pairs.select("*", step("u", PAIR_STEPS - 1)).select(F.lit(2).alias("size"), "a", "b", F.lit(0).alias("c"), "u", F.lit(0).alias("v"), F.array(part("pa", u), part("pb", 1 - u)).alias("parts"))
    u, v = F.col("u") / TRIPLE_STEPS, F.col("v") / TRIPLE_STEPS
    grid = triples.select("*", step("u", TRIPLE_STEPS - 2)).select("*", step("v", TRIPLE_STEPS - 2)).filter(F.col("u") + F.col("v") < TRIPLE_STEPS)
    trebles = grid.select(F.lit(3).alias("size"), "a", "b", "c", "u", "v", F.array(part("pa", u), part("pb", v), part("pc", 1 - u - v)).alias("parts"))
    every = singles.union(doubles).union(trebles).withColumn("n", n)
    return every.withColumn("ordinal", F.row_number().over(W.orderBy("size", "a", "b", "c", "u", "v")) - 1).select("ordinal", "parts")


def blend_into(mixtures: DataFrame, mother: int, fraction: float) -> DataFrame:
    """Every mixture with ``fraction`` of a mother colour; its own share of it is kept on top."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    kept = F.transform("parts", lambda p: F.struct(p["paint_idx"].alias("paint_idx"), (p["share"] * (1 - fraction)).alias("share")))
    extra = F.array(F.struct(F.lit(mother).cast("int").alias("paint_idx"), F.lit(float(fraction)).alias("share")))
    return mixtures.withColumn("parts", F.concat(kept, extra))


#: Paints that mix at a time; their coefficients travel with the tasks.
MOST_PAINTS = 256
_OBSERVERS = np.array(pigments.OBSERVERS).T / pigments.NORM


def mix(mixtures: DataFrame, paints: DataFrame, key: str = "ordinal") -> DataFrame:
    """``key``, x, y, z of mixtures given as ``parts``: band sums, reflectance, observer sums.

    Shares are normalised; a mixture without a positive sum of known paints has null results.
    The paints are a short list, so a batch of mixtures is a matrix of shares, its band sums
    are matrix products, and nothing is shuffled.
    """
    rows = paints.select("paint_idx", "k", "s").orderBy("paint_idx").limit(MOST_PAINTS + 1).collect()
    if len(rows) > MOST_PAINTS:
        raise ValueError(f"more than {MOST_PAINTS} paints")
    known = np.array([r.paint_idx for r in rows], np.int64)
    k, s = (np.array([r[c] for r in rows]).reshape(-1, pigments.BANDS) for c in "ks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch["parts"]
            lengths = np.diff(parts.offsets.to_numpy())
            entries = parts.flatten()
            row = np.repeat(np.arange(len(parts)), np.where(parts.is_valid().to_numpy(zero_copy_only=False), lengths, 0))
            paint = entries.field("paint_idx").to_numpy(zero_copy_only=False).astype(np.int64)
            share = entries.field("share").to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.minimum(np.searchsorted(known, paint), max(0, len(known) - 1))
            real = known[at] == paint if len(known) else np.zeros(len(paint), bool)
            shares = np.zeros((len(parts), len(known)))
            np.add.at(shares, (row[real], at[real]), share[real])
            total = shares.sum(axis=1)
            missing = ~(total > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                q = (shares @ k) / np.maximum(shares @ s, pigments.LEAST_SCATTER * total[:, None])
                r = 1 + q - np.sqrt(q * q + 2 * q)
                r = (1 - pigments.SAUNDERSON_K1) * (1 - pigments.SAUNDERSON_K2) * r / (1 - pigments.SAUNDERSON_K2 * r)
            xyz = r @ _OBSERVERS
            yield pa.RecordBatch.from_arrays([batch[key], *(pa.array(xyz[:, i], mask=missing) for i in range(3))], names=[key, "x", "y", "z"])

    plain = mixtures.select(key, "parts")
    fields = [plain.schema[key], *(T.StructField(c, T.DoubleType()) for c in "xyz")]
    return plain.mapInArrow(run, T.StructType(fields))


def render(mixed: DataFrame) -> DataFrame:
    """Add the spectrum's Lab (``l, a, b``), display colour ``argb`` and ``chroma_lost``."""
    xyz = tuple(F.col(c) for c in "xyz")
    linear = mixed.select("*", *(c.alias(n) for c, n in zip(color.xyz_to_linear(xyz), ("lr", "lg", "lb"), strict=True)))
    mapped = linear.withColumn("m", color.compress(F.col("lr"), F.col("lg"), F.col("lb")))
    lab = color.xyz_to_lab(xyz)
    return mapped.select(*mixed.columns, *(c.alias(n) for c, n in zip(lab, "lab", strict=True)), color.pack(F.lit(255), *(color.linear_to_byte(F.col(f"m.{c}")) for c in "rgb")).alias("argb"), F.col("m.chroma_lost").alias("chroma_lost"))


def with_argb_lab(df: DataFrame) -> DataFrame:
    """Lab (``l, a, b``) of the 8-bit colour ``argb``."""
    _, r, g, b = color.channels(F.col("argb"))
    return df.select("*", *(c.alias(n) for c, n in zip(color.rgb_to_lab(r, g, b), "lab", strict=True)))


def candidates(paints: DataFrame, *, mother: int | None = None, fraction: float = 0.0) -> DataFrame:
    """cand_idx, argb, l, a, b: distinct colours of all mixtures in order of first occurrence.

    Lab is of the 8-bit colour. At most 95,337 rows for the 18 paints of the library.
    """
    every = enumerate_mixtures(paints)
    if mother is not None:
        every = blend_into(every, mother, fraction)
    seen = render(mix(every, paints)).groupBy("argb").agg(F.min("ordinal").alias("ordinal"))
    numbered = seen.select((F.row_number().over(W.orderBy("ordinal")) - 1).alias("cand_idx"), "argb")
    return with_argb_lab(numbered)


def settled(cands: DataFrame) -> DataFrame:
    """The candidates as a local table, after a check of their number: later uses cost nothing."""
    return cands.sparkSession.createDataFrame(collected(cands), cands.schema)


def keep_only(cands: DataFrame, predicate: Column) -> DataFrame:
    """Candidates that satisfy the predicate; all of them if none does."""
    kept = cands.filter(predicate)
    return kept if kept.limit(1).count() else cands


def first_of_each(rendered: DataFrame, by: str) -> DataFrame:
    """``by``, cand_idx, argb: the distinct colours of each group, numbered by first occurrence.

    ``rendered`` has ``by``, ordinal and argb. Colours are made distinct before they are numbered.
    """
    seen = rendered.groupBy(by, "argb").agg(F.min("ordinal").alias("ordinal"))
    return seen.select(by, (F.row_number().over(W.partitionBy(by).orderBy("ordinal")) - 1).alias("cand_idx"), "argb")


def extents(cands: DataFrame | GroupedData) -> DataFrame:
    """Of candidates, or of each of their groups: their number ``n``, largest ``chroma``, least and
    largest lightness ``least_l, most_l``, and the first candidate that has each, ``darkest, lightest``."""
    first = lambda f, sign: f("cand_idx", F.struct("l", (sign * F.col("cand_idx")).alias("i")))
    return cands.agg(F.count("*").alias("n"), F.max(F.hypot("a", "b")).alias("chroma"), F.min("l").alias("least_l"), F.max("l").alias("most_l"), first(F.min_by, 1).alias("darkest"), first(F.max_by, -1).alias("lightest"))


def select_candidates(cands: DataFrame, chosen: DataFrame) -> DataFrame:
    """The candidates listed in ``chosen(cand_idx)``, numbered anew in ascending order."""
    kept = cands.join(chosen.select("cand_idx").distinct(), "cand_idx", "left_semi")
    return kept.withColumn("cand_idx", (F.row_number().over(W.orderBy("cand_idx")) - 1).cast("int"))


def most_neutral(paints: DataFrame) -> int:
    """paint_idx of the paint nearest to middle grey: chroma, and a tenth of the lightness gap."""
    own = paints.select(F.col("paint_idx").alias("own"), F.array(F.struct("paint_idx", F.lit(1.0).alias("share"))).alias("parts"))
    lab = with_argb_lab(render(mix(own, paints, "own")).select("own", "argb"))
    gap = F.abs(F.col("l") - 50)
    score = F.struct((F.hypot("a", "b") + 0.10 * gap).alias("score"), gap.alias("gap"), "own")
    return lab.agg(F.min_by("own", score)).first()[0]


def strips(pairs: DataFrame, paints: DataFrame, width: int) -> DataFrame:
    """``pairs`` (first, second, and any other columns) with x, argb: swept from one paint to the other."""
    at = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    share = F.col("x") / float(max(1, width - 1))
    part = lambda c, s: F.struct(F.col(c).cast("int").alias("paint_idx"), s.alias("share"))
    keyed = at.select(F.struct(*pairs.columns, "x").alias("ordinal"), F.array(part("first", 1 - share), part("second", share)).alias("parts"))
    return render(mix(keyed, paints)).select("ordinal.*", "argb")


def gradient_strips(paints: DataFrame, width: int) -> DataFrame:
    """first, second, x, argb: every pair of paints swept from one to the other."""
    a = paints.select(F.col("paint_idx").alias("first"))
    b = paints.select(F.col("paint_idx").alias("second"))
    return strips(a.join(F.broadcast(b), F.col("first") < F.col("second")), paints, width)


def families(paints: DataFrame) -> DataFrame:
    """paint_idx, name, family, rank, lightness: colour family, and order in it, lightest first.

    Dark paints are judged by their half tint with an ideal white.
    """
    spark = paints.sparkSession
    white = spark.createDataFrame([(-1, "Ideal White", "PW", "ideal", [0.0] * pigments.BANDS, [1.0] * pigments.BANDS)], pigments.PIGMENT_DDL)
    shares = paints.select("paint_idx", F.explode(F.array(F.lit(1.0), F.lit(0.5))).alias("own"))
    parts = F.array(F.struct("paint_idx", F.col("own").alias("share")), F.struct(F.lit(-1).alias("paint_idx"), (1 - F.col("own")).alias("share")))
    keyed = shares.select(F.struct("paint_idx", "own").alias("ordinal"), parts.alias("parts"))
    lab = mix(keyed, paints.unionByName(white))
    named = lab.select("ordinal.*", *(c.alias(n) for c, n in zip(color.xyz_to_lab((F.col("x"), F.col("y"), F.col("z"))), "lab", strict=True)))
    tones = named.groupBy("paint_idx").agg(*(F.max(F.when(F.col("own") == own, F.struct("l", "a", "b"))).alias(n) for own, n in ((1.0, "mass"), (0.5, "tint"))))
    judged = tones.withColumn("j", F.when(F.col("mass.l") < 30, F.col("tint")).otherwise(F.col("mass")))
    hue = F.pmod(F.degrees(F.atan2(F.col("j.b"), F.col("j.a"))) + 360, F.lit(360.0))
    family = F.when(F.hypot("j.a", "j.b") < 8, F.when(F.col("j.l") >= 90, "Whites").otherwise("Blacks"))
    family = family.when((hue >= 330) | (hue < 45), "Reds")
    for least, name in ((295, "Violets"), (220, "Blues"), (130, "Greens"), (65, "Yellows")):
        family = family.when(hue >= least, name)
    out = judged.select("paint_idx", family.otherwise("Oranges").alias("family"), F.col("mass.l").alias("lightness")).join(paints.select("paint_idx", "name"), "paint_idx")
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.desc("lightness"), "paint_idx"))
    return out.select("paint_idx", "name", "family", rank.alias("rank"), "lightness")
