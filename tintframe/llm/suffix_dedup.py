"""Repeated byte strings across and within texts, by sampled suffixes and names.

The method follows the difference-cover suffix sort: sample positions so that any two equal
strings of the wanted length share a sampled position, name the sampled strings, let every
other suffix inherit from the sampled one to its right, sort, and compare neighbours. Two
things differ from the textbook, since a sort of every position does not fit the disk:

* The cover is chosen by content, not by residue: of each window's half-length strings the
  one with the least name is sampled. Equal windows sample alike, and some 2 % of all
  positions are sampled, where residues modulo 3 take 67 %.
* Names are 64-bit hashes and not ranks, so that every task gives a string the same name
  without a sort. They are still built by triples, and triples of names, level by level.

Only suffixes whose sampled string occurs again go on. Their surroundings are dealt by that
string's name; each shard names the whole windows, sorts them and compares neighbours.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .hashing import U, _CODE, mix

#: Bytes of text that are named at a time, but for longer single texts.
_BITE = 1 << 20
_SAMPLES_A_SHARD = 200_000
#: A sampled string that occurs more often is dealt window by window.
HOT = 20_000


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b * U(0xC2B2AE3D27D4EB4F) + c)


def names(raw: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of ``length`` bytes, by triples of names of a third of it.

    ``length`` is at least 3; a level's triples overlap where ``length`` is no power of 3.
    """
    name, covered = _CODE[raw], 1
    while covered < length:
        wide = min(3 * covered, length)
        steps = (0, min(covered, wide - covered), wide - covered)
        n = max(0, len(raw) - wide + 1)
        name = _triple(*(name[s : s + n] for s in steps))
        covered = wide
    return name


def _sliding(x: np.ndarray, width: int, f: np.ufunc, blank: np.uint64) -> np.ndarray:
    """``f`` over every ``width`` neighbours, by blockwise running values from both ends."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, blank, U)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).reshape(-1)
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(back[: n - width + 1], ahead[width - 1 : n])


def sampled(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of one text and the names there."""
    half = length // 2
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, U)
    name, width = names(raw, half), length - half + 1
    least = _sliding(name, width, np.minimum, U(2**64 - 1))
    around = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    at = np.flatnonzero(_sliding(around, width, np.maximum, U(0)) == name)
    return at, name[at]


_SAMPLE_DDL = "shard int, id array<long>, which array<int>, at array<int>, name array<long>"
_ARRAYS = {"id": pa.int64(), "which": pa.int32(), "at": pa.int32(), "name": pa.int64()}


def _lists(shard: int, **arrays) -> pa.RecordBatch:
    columns = [pa.array([shard], pa.int32()), *(pa.array([a.view(np.int64) if a.dtype == U else a], pa.list_(_ARRAYS[k])) for k, a in arrays.items())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", *arrays])


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[order[lo]]), order[lo:hi]


def _sample(length: int, shards: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, name, which = [], [], [], []
            for i, text in dict(zip(batch["id"].to_pylist(), batch["text"], strict=True)).items():
                where, named = sampled(np.frombuffer(text.as_py() or b"", np.uint8), length)
                which.append(np.full(len(where), len(ids), np.int32))
                ids.append(i)
                at.append(where.astype(np.int32))
                name.append(named)
            if not ids:
                continue
            at, name, which, ids = np.concatenate(at), np.concatenate(name), np.concatenate(which), np.array(ids, np.int64)
            for shard, mine in _by_shard((mix(name) % U(shards)).astype(np.int64)):
                present, local = np.unique(which[mine], return_inverse=True)
                yield _lists(shard, id=ids[present], which=local.astype(np.int32), at=at[mine], name=name[mine])

    return sample


def _shards(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[list[list]]:
    """All rows of one shard after another; rows come sorted by shard."""
    now, held = None, []
    for batch in batches:
        for i, shard in enumerate(batch["shard"].to_pylist()):
            if shard != now and held:
                yield held
                held = []
            now = shard
            held.append([batch[f][i] for f in fields])
    if held:
        yield held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples whose name occurs at two places at least: id, at, hot."""
    for rows in _shards(batches, ("id", "which", "at", "name")):
        arrays = [[np.asarray(x.values) for x in row] for row in rows]
        ids = np.concatenate([i[w] for i, w, _, _ in arrays])
        at, name = (np.concatenate([r[k] for r in arrays]) for k in (2, 3))
        order = np.lexsort((at, ids, name))
        ids, at, name = ids[order], at[order], name[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1]) | (name[1:] != name[:-1])  # copies of a text come from several tasks
        ids, at, name = ids[new], at[new], name[new]
        cuts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(cuts, len(name)))
        size = np.repeat(size, size)
        keep = size > 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(at[keep]), pa.array(size[keep] > HOT)], names=["id", "at", "hot"])


def _runs(at: np.ndarray, name: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each sample: those in which it is the leftmost least."""
    width = length - length // 2 + 1
    windows = np.arange(n - length + 1)
    now = np.searchsorted(at, windows)
    best, step = now.copy(), 1
    while True:
        ahead = np.minimum(now + step, len(at) - 1)
        inside = (now + step < len(at)) & (at[ahead] < windows + width)
        if not inside.any():
            break
        better = inside & (name[ahead] < name[best])
        best[better] = ahead[better]
        step += 1
    first = np.searchsorted(best, np.arange(len(at)))  # best never goes back
    last = np.searchsorted(best, np.arange(len(at)), "right") - 1
    return first, last


_NEAR_DDL = "shard int, id array<long>, at array<int>, size array<int>, name array<long>, bytes binary, done array<long>"


def _surroundings(length: int, shards: int):
    """Texts with their repeated samples to windows, dealt by the samples' names.

    A row holds windows in runs (first window, number, the sample's name) and their bytes.
    Windows of hot samples are dealt by their own names, one of each name a batch; those
    that repeat inside the batch are done: id and first byte in ``done``.
    """

    def row(shard, ids, at, size, name, data, done=np.empty(0, np.int64)):
        one = lambda a, t: pa.array([a], pa.list_(t))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), one(ids, pa.int64()), one(at, pa.int32()), one(size, pa.int32()), one(name.view(np.int64), pa.int64()), pa.array([data], pa.binary()), one(done, pa.int64())], names=[x.split()[0] for x in _NEAR_DDL.split(", ")])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, size, name, where, texts, hot_id, hot_at, hot_name = [], [], [], [], [], [], [], [], []
            for i, text, spots, warm in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["at"], batch["hot"], strict=True):
                raw = np.frombuffer(text, np.uint8)
                places, named = sampled(raw, length)
                first, last = _runs(places, named, len(raw), length)
                spots, warm = np.asarray(spots.values), np.asarray(warm.values)
                mine = np.searchsorted(places, spots)
                some = last[mine] >= first[mine]  # a tied sample may be leftmost nowhere
                mine, warm = mine[some], warm[some]
                if warm.any():
                    whole = names(raw, length)
                    starts = np.concatenate([np.arange(first[m], last[m] + 1) for m in mine[warm]])
                    hot_id.append(np.full(len(starts), i, np.int64))
                    hot_at.append(starts)
                    hot_name.append(whole[starts])
                mine = mine[~warm]
                ids.append(np.full(len(mine), i, np.int64))
                at.append(first[mine])
                size.append(last[mine] - first[mine] + 1)
                name.append(named[mine])
                where.append(np.full(len(mine), len(texts)))
                texts.append(text)
            if not ids:
                continue
            ids, at, size, name, where = (np.concatenate(x) for x in (ids, at, size, name, where))
            for shard, mine in _by_shard((mix(name) % U(shards)).astype(np.int64)):
                data = b"".join(texts[w][a : a + s + length - 1] for w, a, s in zip(where[mine], at[mine], size[mine], strict=True))
                yield row(shard, ids[mine], at[mine].astype(np.int32), size[mine].astype(np.int32), name[mine], data)
            if hot_id:
                ids, at, name = (np.concatenate(x) for x in (hot_id, hot_at, hot_name))
                kind, back, seen = np.unique(name, return_inverse=True, return_counts=True)
                again = seen[back] > 1
                done = np.stack([ids[again], at[again]], axis=1).reshape(-1)
                yield row(0, *(np.empty(0, t) for t in (np.int64, np.int32, np.int32, U)), b"", done)
                one = np.full(len(kind), -1)
                one[back[::-1]] = np.arange(len(back))[::-1]
                for shard, mine in _by_shard((mix(kind) % U(shards)).astype(np.int64)):
                    mine = one[mine]
                    yield row(shard, ids[mine], at[mine].astype(np.int32), np.zeros(len(mine), np.int32), name[mine], b"")

    return near


def _spans(ids: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows to ``id, lo, hi``, neighbouring windows in one row."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(ids)) - 1 if len(ids) else lo
    return pa.RecordBatch.from_arrays([pa.array(ids[lo]), pa.array(at[lo].astype(np.int64)), pa.array(at[hi].astype(np.int64) + length)], names=["id", "lo", "hi"])


def _named(data: bytes, size: np.ndarray, length: int) -> np.ndarray:
    """Names of the windows of a row's runs, ``_BITE`` bytes of its text at a time."""
    sizes = size[size > 0].astype(np.int64)
    ends = np.cumsum(sizes + length - 1)
    out, at, lo = [np.empty(0, U)], 0, 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, lo + _BITE, "right")))
        n = sizes[at:upto]
        whole = names(np.frombuffer(data, np.uint8, int(ends[upto - 1]) - lo, lo), length)
        begin = (ends[at:upto] - (n + length - 1)) - lo
        out.append(whole[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        at, lo = upto, int(ends[upto - 1])
    return np.concatenate(out)


def _compare(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches, ("id", "at", "size", "name", "bytes", "done")):
            arrays = [[np.asarray(x.values) for x in row[:4]] for row in rows]
            ids, at, size, name = (np.concatenate([r[k] for r in arrays]) for k in range(4))
            done = np.concatenate([np.asarray(r[5].values) for r in rows]).reshape(-1, 2)
            if len(done):
                yield _spans(done[:, 0], done[:, 1], length)
            run = size > 0
            spread = np.repeat(np.flatnonzero(run), size[run])
            within = np.arange(len(spread)) - np.repeat(np.cumsum(size[run]) - size[run], size[run])
            single = np.flatnonzero(~run)  # windows of hot samples bring their names
            window = np.concatenate([*(_named(r[4].as_py(), a[2], length) for r, a in zip(rows, arrays, strict=True)), name[single].view(U)])
            sample = np.concatenate([name[spread], np.zeros(len(single), np.int64)])
            owner, place = np.concatenate([ids[spread], ids[single]]), np.concatenate([at[spread] + within, at[single]])
            order = np.lexsort((window, sample))
            same = (window[order][1:] == window[order][:-1]) & (sample[order][1:] == sample[order][:-1])
            again = np.zeros(len(order), bool)
            again[1:] |= same
            again[:-1] |= same
            if again.any():
                yield _spans(owner[order[again]], place[order[again]], length)

    return compare


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests, kept = [], [], [], []
        for text, los, his in zip(batch["text"].to_pylist(), batch["lo"], batch["hi"], strict=True):
            lo, hi = np.asarray(los.values), np.asarray(his.values)
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > hi[:-1]
            starts, ends = lo[new], np.append(hi[np.flatnonzero(new)[1:] - 1], hi[-1])
            rest = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))
            removed.append(len(text) - len(rest))
            spans.append(len(starts))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = 200, keep_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte of a text (its UTF-8 bytes; null is empty) is removed if a string of ``length``
    bytes that covers it also starts at another place of any text, its own and its copies
    included. All strings are judged on the input. ``n_spans`` counts maximal removed runs;
    ``kept`` holds the other bytes, null where all stayed. A text that occurs twice goes
    whole if it has ``length`` bytes. Only doc_id and text are read; null and repeated ids
    change nothing; texts shorter than ``length`` stay; an empty table gives no rows. The
    result holds on 64-bit names: two strings are taken for equal only if the names of the
    string and of a half-length sample in it both agree.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).withColumn("id", F.xxhash64("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total * 4 / (length * _SAMPLES_A_SHARD)))
    samples = base.filter(F.octet_length("text") >= length).select("id", "text").mapInArrow(_sample(length, shards), _SAMPLE_DDL)
    spots = samples.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_repeated, "id long, at int, hot boolean")
    spots = spots.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "hot"))).alias("s")).select("id", F.col("s.at").alias("at"), F.col("s.hot").alias("hot"))
    spots = save(spots, "repeated-samples")
    texts = base.select("id", "text").groupBy("id").agg(F.first("text").alias("text"))
    suspects = save(texts.join(spots, "id"), "suspects")
    near = suspects.mapInArrow(_surroundings(length, shards), _NEAR_DDL)
    spans = near.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_compare(length), "id long, lo long, hi long")
    spans = spans.groupBy("id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    cut = suspects.select("id", "text").join(spans, "id").mapInArrow(_cut, "id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = save(cut if keep_bytes else cut.drop("kept"), "cut")
    copies = base.groupBy("id").agg(F.count("*").alias("copies"))
    facts = base.select("doc_id", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"))
    found = facts.join(copies.filter("copies > 1"), "id", "left").join(cut, "id", "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    out = found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_bytes else []),
    )
    discard(spots, suspects)
    return out
