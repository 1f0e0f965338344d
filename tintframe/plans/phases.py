"""Phases of renders as rows: how long each took and how many rows and keys it put out."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import mixtures
from ..sources import scratch
from . import styles

PHASES_DDL = "phase string, seconds double, rows long, keys long"
BENCH_DDL = "style string, phase string, runs int, seconds double, rows long, keys long"


class Phases:
    """Takes the phases of a job: each is written and observed, and the next one starts from it.

    A phase's seconds are those of its own work only, since what came before is a table by then.
    ``keys`` are the distinct values of a column that the caller names, about which Spark keeps
    a sketch; null without one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.taken: list[tuple[str, float, int, int | None]] = []

    def take(self, name: str, df: DataFrame, key: str | None = None) -> DataFrame:
        seen = Observation(f"{name}-{len(self.taken)}")
        keys = F.approx_count_distinct(key) if key else F.lit(None).cast("long")
        began = time.perf_counter()
        out = scratch.save(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.lit(0)).alias("any") if not key else keys.alias("keys")), name)
        seconds = time.perf_counter() - began
        told = seen.get
        self.taken.append((name, seconds, told["rows"], told.get("keys")))
        return out

    def table(self) -> DataFrame:
        """phase, seconds, rows, keys in the order in which the phases were taken."""
        return self.spark.createDataFrame(self.taken, PHASES_DDL)


def benchmark(pixels: DataFrame, paints: DataFrame, *, names: tuple[str, ...] = tuple(styles.STYLES), mark: float, runs: int = 3) -> DataFrame:
    """style, phase, runs, seconds, rows, keys: the median seconds of each phase of renders.

    The phase ``candidates`` is the building of a style's candidates, ``cached`` finding them
    again; the others are those of ``styles.render``, which share colour maps between the runs
    of a style, and ``total`` is a run's sum.
    """
    spark, out = pixels.sparkSession, []
    for name in names:
        style, cache = styles.by_name(name), styles.Cache()
        took = []
        for _ in range(2):
            began = time.perf_counter()
            cands = cache.candidates(style, paints)
            took.append(time.perf_counter() - began)
        n = cands.count()
        out += [(name, phase, 1, seconds, n, None) for phase, seconds in zip(("candidates", "cached"), took, strict=True)]
        maps = styles.ColourMaps(spark, scratch.folder(spark, "bench-maps"))
        told: dict[str, list] = {}
        for _ in range(runs):
            phases = Phases(spark)
            styles.render(pixels, style, cands, mark=mark, maps=maps, phases=phases)
            for phase, seconds, rows, keys in phases.taken:
                told.setdefault(phase, []).append((seconds, rows, keys))
            told.setdefault("total", []).append((sum(t[1] for t in phases.taken), phases.taken[-1][2], None))
        out += [(name, phase, runs, statistics.median(t[0] for t in seen), seen[-1][1], seen[-1][2]) for phase, seen in told.items()]
    return spark.createDataFrame(out, BENCH_DDL)


def noisy_benchmark(spark: SparkSession, width: int, height: int, *, paints: int, mark: float, runs: int = 3) -> DataFrame:
    """The benchmark on a noisy gradient with the first ``paints`` of the palette."""
    from ..sources import fixtures, images

    return benchmark(fixtures.noisy_gradient(spark, width, height), images.first_paints(mixtures.palette(spark), paints), mark=mark, runs=runs)
