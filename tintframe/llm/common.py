"""Shared scratch tables and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

#: A word of the contracts: a run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the tasks that read the table. The
    tables of an application lie in one folder, which goes when its driver ends in order.
    """
    spark = df.sparkSession
    path = scratch.folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.saved_at = path
    return again


def discard(*saved: DataFrame) -> None:
    """Delete tables of :func:`save` that no later plan reads, and the shuffles behind them."""
    for df in saved:
        scratch.remove(df.sparkSession, df.saved_at)
    if saved:
        release(saved[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files of finished plans.

    Spark does so when the driver next collects garbage; asking for that here keeps the
    shuffles of a long job from piling up on the disks.
    """
    spark._jvm.System.gc()


#: Bits of the filter of wanted keys, whatever the number of ids: 2 MB in every task.
_FILTER_BITS = 24


def wanted_filter(wanted: DataFrame, key: str) -> Callable[[np.ndarray], np.ndarray]:
    """Which of some 64-bit hashes may be among the wanted ones, to ask inside tasks.

    The low bits of the wanted keys set bits of a filter of fixed size, put together by an
    aggregate. Beyond some millions of keys it lets more and more through.
    """
    words = (1 << _FILTER_BITS - 6) - 1
    one = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    bits = wanted.groupBy(F.shiftright(key, 6).bitwiseAND(F.lit(words)).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    mask = np.zeros(words + 1, np.int64)
    mask[np.asarray(bits["word"].combine_chunks())] = np.asarray(bits["bits"].combine_chunks())
    told = wanted.sparkSession.sparkContext.broadcast(mask)
    return lambda k: ((told.value[(k >> 6) & words] >> (k & 63)) & 1).astype(bool)


def thinned(rows: DataFrame, may: Callable[[np.ndarray], np.ndarray], key: str) -> DataFrame:
    """``rows`` without most of those that a :func:`wanted_filter` on ``key`` rules out."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may(np.asarray(batch[key]))))

    return rows.mapInArrow(thin, rows.schema)


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``wanted`` on ``key``, a 64-bit hash; few others are shuffled.

    What :func:`wanted_filter` rules out falls away before the join, which decides.
    """
    return thinned(rows, wanted_filter(wanted, key), key).join(wanted, key)


def both_sides(pairs: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """``a, b`` and the value of each: one row a pair whose keys both have one.

    A value is shuffled once for each pair that it is in, and not with those it is in none of.
    """
    side = lambda c: F.first(F.when(F.col(key) == F.col(c), F.col(value)), ignorenulls=True).alias(f"{value}_{c}")
    met = pairs.select("a", "b", F.explode(F.array("a", "b")).alias(key)).join(values, key)
    return met.groupBy("a", "b").agg(side("a"), side("b"))


def _give_back() -> None:
    """Hand freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable, rows: int | None = None) -> Callable:
    """``run`` for mapInArrow, on batches of ``rows`` at most, leaving a small worker behind.

    Spark keeps Python workers for later tasks, and with them what they have not given back.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)) if rows else batches
        yield from run(cut)
        _give_back()

    return wrapped


def bites(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut at spaces."""
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + size)
        end = len(data) if cut < 0 else cut
        yield data[at:end]
        at = end


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, in any case of letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds, F.lit(0))
