"""Render requests by bursts, on tables and streams: debounce, latest wins, preview then full.

``scheduler`` has the whole machine, with cancel, gate and one render in flight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def debounce(requests: DataFrame, gap: str) -> DataFrame:
    """key, start, end, n, generation, payload: one row a burst, with its latest request.

    A burst ends where no request of its key follows within ``gap``. Works on a stream (with a
    watermark on ``ts``) as on a table.
    """
    latest = F.max_by(F.struct("generation", "payload"), "generation")
    burst = requests.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), latest.alias("last"))
    return burst.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.col("last.generation").alias("generation"), F.col("last.payload").alias("payload"))


def live_bursts(requests: DataFrame, gap: str) -> DataFrame:
    """Bursts of a table whose last event is no cancel."""
    last = F.max_by("kind", "generation")
    burst = requests.groupBy("key", F.session_window("ts", gap).alias("w")).agg(last.alias("kind"), F.max("generation").alias("generation"))
    return burst.filter(F.col("kind") != "cancel").select("key", F.col("w.start").alias("start"), "generation")


def passes(bursts: DataFrame) -> DataFrame:
    """Two rows a burst: a preview and then the full render."""
    return bursts.withColumn("pass", F.explode(F.array(F.lit("preview"), F.lit("full"))))


def latest_values(changes: DataFrame) -> DataFrame:
    """key, kind, generation, payload: the last value of each key and kind."""
    return changes.groupBy("key", "kind").agg(F.max_by("payload", "generation").alias("payload"), F.max("generation").alias("generation")).select("key", "kind", "generation", "payload")
