"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each task keeps a fixed number of windows open. A piece goes to the open window that it
fills best; when none has room and no more may be opened, the fullest is emitted. If that
window's gap is larger than ``max_gap`` the piece is cut to fill it first. What is open when
a task ends is a leftover: leftovers of ``fan_in`` tasks are packed again by one, and so on
up to a last task, which joins its leftovers end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import lean, save

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("leftover", pa.bool_())])
_DDL = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, leftover boolean"
_ID_BYTES = 4
#: Texts handled at a time, and bytes of them that are tokenised at once.
_ROWS, _BITE = 512, 1 << 20
#: A task hands on its rows once it has this many.
_ROWS_OUT = 4096


class Windows:
    """The open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, length: int, keep_open: int, max_gap: int):
        self.length, self.keep_open, self.max_gap = length, keep_open, max_gap
        self.free: list[int] = []
        self.held: list[list[tuple]] = []

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Place a piece; yield each window that is now emitted, as its pieces in order."""
        doc_id, start, ids, doc_tokens = piece
        while (n := len(ids) // _ID_BYTES) >= self.length:
            yield [(doc_id, start, ids[: self.length * _ID_BYTES], doc_tokens)]
            start, ids = start + self.length, ids[self.length * _ID_BYTES :]
        while n:
            fits = [(free, at) for at, free in enumerate(self.free) if free >= n]
            if fits:
                free, at = min(fits)
                self.held[at].append((doc_id, start, ids, doc_tokens))
                self.free[at] = free - n
                if free == n:
                    yield self._take(at)
                return
            if len(self.free) < self.keep_open:
                self.free.append(self.length - n)
                self.held.append([(doc_id, start, ids, doc_tokens)])
                return
            gap, at = min((free, at) for at, free in enumerate(self.free))
            if gap > self.max_gap:
                self.held[at].append((doc_id, start, ids[: gap * _ID_BYTES], doc_tokens))
                start, ids, n = start + gap, ids[gap * _ID_BYTES :], n - gap
            yield self._take(at)

    def _take(self, at: int) -> list[tuple]:
        self.free.pop(at)
        return self.held.pop(at)

    def join(self) -> Iterator[list[tuple]]:
        """Empty the open windows end to end: all but the last that comes out are full."""
        rest = [piece for window in self.held for piece in window]
        one, free = [], self.length
        for doc_id, start, ids, doc_tokens in rest:
            while ids:
                cut = ids[: free * _ID_BYTES]
                one.append((doc_id, start, cut, doc_tokens))
                n = len(cut) // _ID_BYTES
                start, ids, free = start + n, ids[len(cut) :], free - n
                if not free:
                    yield one
                    one, free = [], self.length
        if one:
            yield one
        self.free, self.held = [], []


def _pack(pieces: Iterator[tuple], windows: Windows, base: int, part: int, *, last: bool, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    rows, emitted = [], 0

    def put(window: list[tuple], leftover: bool) -> None:
        nonlocal emitted
        offset = 0
        for doc_id, start, ids, doc_tokens in window:
            n = len(ids) // _ID_BYTES
            rows.append((doc_id, start, n, ids if keep_ids or leftover else None, zlib.crc32(ids), doc_tokens, base + emitted, offset, part, leftover))
            offset += n
        emitted += 1

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        rows.clear()
        return out

    for piece in pieces:
        for window in windows.add(piece):
            put(window, False)
        if len(rows) >= _ROWS_OUT:
            yield batch()
    for window in windows.join() if last else windows.held:
        put(window, not last)
    if rows:
        yield batch()


def _bites(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``_BITE`` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy()
    at = 0
    while at < whole.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + _ROWS]), _BITE, "right")))
        yield whole.slice(at, n)
        at += n


def _first(path: str, end_id: int | None, length: int, keep_open: int, max_gap: int, keep_ids: bool):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.tokenizer(path).encode
        end = b"" if end_id is None else end_id.to_bytes(_ID_BYTES, "little")

        def pieces():
            for whole in batches:
                for some in _bites(whole):
                    texts = [t or "" for t in some["text"].to_pylist()]
                    for doc_id, ids in zip(some["doc_id"].to_pylist(), encode(texts), strict=True):
                        ids += end
                        yield doc_id, 0, ids, len(ids) // _ID_BYTES

        part = TaskContext.get().partitionId()
        yield from _pack(pieces(), Windows(length, keep_open, max_gap), part << 32, part, last=False, keep_ids=keep_ids)

    return first


def _again(level: int, last: bool, length: int, keep_open: int, max_gap: int, keep_ids: bool):
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (p for b in batches for p in zip(b["doc_id"].to_pylist(), b["start"].to_pylist(), b["ids"].to_pylist(), b["doc_tokens"].to_pylist(), strict=True))
        part = TaskContext.get().partitionId()
        yield from _pack(pieces, Windows(length, keep_open, max_gap), (level << 56) + (part << 32), part, last=last, keep_ids=keep_ids)

    return again


def pack(docs: DataFrame, *, length: int = 2048, end_id: int | None = 1, tokenizer_path: str | None = None, keep_open: int = 32, max_gap: int = 16, fan_in: int = 32, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every text is tokenised whole and followed by ``end_id`` (None: by nothing); null counts
    as empty, and a document without ids has no piece. ``start`` counts the document's ids
    before the piece, ``offset`` the ids before it in its sequence; ``ids`` holds unsigned
    32-bit little-endian ids (null with ``keep_ids=False``). Only doc_id and text are read,
    so other columns can't clash; repeated rows are packed as often as they occur. An empty
    table gives no rows. Memory of a task: ``keep_open`` windows, one bite of texts with
    their ids, and the worker's bounded word cache.
    """
    path = tokenizer_path or tokens.default_path()
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    level, made = 0, []
    table = save(rows.mapInArrow(lean(_first(path, end_id, length, keep_open, max_gap, keep_ids), _ROWS), _DDL), "pieces-0")
    while True:
        made.append(table.filter(~F.col("leftover")))
        rest = table.filter("leftover")
        tasks = rest.select("part").distinct().count()
        if not tasks:
            break
        level, groups = level + 1, -(-tasks // fan_in)
        dealt = rest.repartition(groups, F.floor(F.col("part") / fan_in)).sortWithinPartitions("part", "sequence_id", "offset")
        table = save(dealt.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(_again(level, groups == 1, length, keep_open, max_gap, keep_ids), _DDL), f"pieces-{level}")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.drop("part", "leftover")
