"""Work on many small groups of rows at a time, and on large ones one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a table sorted by ``keys`` start, and the number of its rows."""
    n = table.num_rows
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for key in keys:
        value = table[key].to_numpy()
        fresh[1:] |= value[1:] != value[:-1]
    return np.append(np.flatnonzero(fresh), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; a group's rows wait for its last."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = starts_of(table, keys)[-2]
        if held and (last or any(table[k][0] != held[-1][k][held[-1].num_rows - 1] for k in keys)):
            before, table = table.slice(0, last), table.slice(last)
            yield pa.concat_tables([*held, before]).combine_chunks()
            held = []
        elif not held and last:
            yield table.slice(0, last).combine_chunks()
            table = table.slice(last)
        held.append(table)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def map_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``run`` on tables of whole groups by ``keys``, whose keys are not null, sorted by keys and ``order``.

    Spark deals and sorts the groups, and spills what does not fit. A table holds as many
    groups as a batch of Arrow has, so that small ones cost no call each, or one large group.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from run(table).to_batches()

    # by a hash of the keys: Spark 4.1 leaves out a plain repartition over a union whose sides are
    # dealt by the keys, though their partitions need not match
    return df.repartition(F.hash(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(mapped, ddl)
