"""Mixing sources to target weights, in DataFrame functions only.

Three steps: total the tokens of each source, derive one repetition rate per source, and
give each document ``floor(rate)`` copies plus one more with probability ``rate -
floor(rate)``, drawn from a hash of its id so that a rerun draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free_name, save

#: Hexadecimal digits of the hash that make the uniform draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(sizes: DataFrame, *, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``(source, size)`` rows to one row per source: source, source_size, target, rate.

    Targets are proportional to the weights, which go round the sources in code point
    order with null last, and add up to ``share`` times all sizes. No target exceeds
    ``cap`` times its source's size; what is cut off goes to the others by weight. The level
    at which that settles is found directly: with sources by ``cap / weight``, the first
    whose cap is not below its part of what the earlier ones leave over. Windows over all
    rows see one row per source only, in one task: fit for up to some million sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap))
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    levels = limited.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share)).withColumn("level", (F.col("wanted") - before) / onward)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), F.col("rank"), F.col("level")))
    settled = levels.withColumn("settled", F.min(fits).over(everything)["level"])
    target = F.least(F.col("limit"), F.col("settled") * F.col("weight"))
    return settled.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def plan_mix(docs: DataFrame, *, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    ``docs`` needs doc_id, text and source; other columns are not read. A null text has
    size 0. A null source is a source of its own, ordered last. Repeated rows draw alike. A
    source without words has rate 0. An empty table gives no rows.

    The hot source needs no care: its sizes are summed in each task before the shuffle, and
    the rates meet the documents in a join that Spark broadcasts only while the written
    table of rates is below its own threshold and splits by skew beyond it.
    """
    sized = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rates = save(source_targets(sized, share=share, weights=weights, cap=cap), "rates")
    return _with_rates(sized, rates, seed)


def _with_rates(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    rate = rates.withColumnRenamed("source", "rated_source")
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return sized.join(rate, F.col("source").eqNullSafe(F.col("rated_source"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, *, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all its columns, as often as its rate says.

    Edge cases are those of :func:`plan_mix`; extra columns are kept whatever their names.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = save(source_targets(sizes, share=share, weights=weights, cap=cap), "rates")
    source, rate, copy = (free_name(docs, x) for x in ("rated_source", "rate", "copy"))
    rated = docs.join(rates.select(F.col("source").alias(source), F.col("rate").alias(rate)), F.col("source").eqNullSafe(F.col(source)))
    extra = (draw(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate)).cast("long")
    copies = F.array_repeat(F.lit(0), (F.floor(rate) + extra).cast("int"))
    return rated.withColumn(copy, F.explode(copies)).drop(source, rate, copy)
