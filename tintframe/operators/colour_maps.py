"""Colour maps that outlive a render: which candidate a colour key leads to, kept as tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .nearest import collected, key_points, nearest, with_key

_KEYS_DDL = "colour_key int, cand_idx int"


def map_name(cands: DataFrame, *remap: float) -> str:
    """A name that differs for other candidates, in number, order or colour, and for another remap."""
    table = collected(cands.select("cand_idx", "l", "a", "b").orderBy("cand_idx"))
    told = hashlib.sha256(repr(tuple(map(float, remap))).encode())
    for column in table.columns:
        told.update(column.combine_chunks().buffers()[1] or b"")
    return told.hexdigest()[:32]


class ColourMaps:
    """A folder of colour maps, one a name, of which the last ``room`` used stay.

    A map is a table of the keys that were solved so far, at most 262,144 whatever is rendered
    with it. A render looks its keys up in the map, solves those that are missing and appends
    them. What filters an image before, or merges its regions after, is not part of a name: it
    changes which keys occur, and not where they lead. Renders at the same time may append a
    key twice, to the same candidate; a map that goes while it is read fails that render, which
    then solves anew.
    """

    def __init__(self, spark: SparkSession, folder: str, room: int = 4):
        if room < 1:
            raise ValueError("a store has room for a map")
        self.spark, self.folder, self.room = spark, folder.rstrip("/"), room
        self.solved = 0  # keys that the last render had to solve

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """The maps that are there, the last used first."""
        store = self._store()
        if not store.exists(self._path()):
            return []
        used = [(f.getModificationTime(), f.getPath().getName()) for f in store.listStatus(self._path("used"))] if store.exists(self._path("used")) else []
        return [name for _, name in sorted(used, reverse=True)]

    def _use(self, name: str) -> None:
        store, last = self._store(), self.names()[:1]
        newest = store.getFileStatus(self._path("used", last[0])).getModificationTime() if last else 0
        store.create(self._path("used", name), True).close()
        if last and last[0] != name and store.getFileStatus(self._path("used", name)).getModificationTime() <= newest:
            store.setTimes(self._path("used", name), newest + 1, -1)
        for old in self.names()[self.room :]:
            store.delete(self._path("used", old), False)
            store.delete(self._path("maps", old), True)

    def known(self, name: str) -> DataFrame:
        """colour_key, cand_idx of a map; no rows if it is not there."""
        path = self._path("maps", name)
        if not self._store().exists(path):
            return self.spark.createDataFrame([], _KEYS_DDL)
        return self.spark.read.schema(_KEYS_DDL).parquet(path.toString()).groupBy("colour_key").agg(F.min("cand_idx").alias("cand_idx"))

    def resolve(self, pixels: DataFrame, cands: DataFrame, name: str, remap=None) -> DataFrame:
        """The rows of ``nearest.resolve_once``, by the map ``name`` as far as it goes."""
        keyed = with_key(pixels)
        missing = scratch.save(keyed.select("colour_key").distinct().join(self.known(name), "colour_key", "left_anti"), "missing-keys")
        self.solved = missing.count()
        if self.solved:
            found = nearest(key_points(missing, remap), cands, key="colour_key")
            found.select("colour_key", "cand_idx").write.mode("append").parquet(self._path("maps", name).toString())
        self._use(name)
        return keyed.join(self.known(name), "colour_key").drop("colour_key")
