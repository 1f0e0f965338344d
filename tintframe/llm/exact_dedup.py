"""Exact deduplication over an extendible-hash index in shared files.

The index is three written tables. ``postings`` holds one row per input row; within one
Arrow batch, equal texts share the text of the first, so that a text which fills a third of
the corpus is shuffled once a batch and not once a row. ``directory`` maps hash prefixes to
buckets: it starts at a depth at which buckets are half full on average and doubles while a
bucket overflows. ``slots`` is what the owner tasks write: each owns whole buckets, reads
their entries in hash order, chains entries whose hashes collide and compares their bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, save

#: Bits of the key that buckets are addressed by; the directory can't go deeper.
KEY_BITS = 62

_POSTING = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("entry", pa.int64()), ("key", pa.int64()), ("sha256", pa.binary()), ("bytes", pa.binary()), ("members", pa.int64()), ("last_doc", pa.int64()), ("last_row", pa.int64())])
_POSTING_DDL = "row long, doc_id long, entry long, key long, sha256 binary, bytes binary, members long, last_doc long, last_row long"
_SLOT = pa.schema([("entry", pa.int64()), ("slot", pa.int64()), ("members", pa.int64()), ("last_doc", pa.int64()), ("last_row", pa.int64())])
_SLOT_DDL = "entry long, slot long, members long, last_doc long, last_row long"


def _rank(doc_id: int | None, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, row)


def _post(key_bits: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries: dict[bytes, list] = {}
            out = []
            for row, doc_id, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                normal = (text.as_py() or b"").lower()  # bytes.lower() changes A-Z only
                entry = entries.get(normal)
                if entry is None:
                    key = xxhash.xxh3_64_intdigest(normal) >> (64 - key_bits)
                    entry = entries[normal] = [row, key, hashlib.sha256(normal).digest(), 0, _rank(doc_id, row), len(out)]
                    out.append([row, doc_id, row, key, entry[2], normal, None, None, None])
                else:
                    out.append([row, doc_id, entry[0], entry[1], entry[2], None, None, None, None])
                entry[3] += 1
                entry[4] = max(entry[4], _rank(doc_id, row))
            for _, _, _, members, (known, last_doc, last_row), at in entries.values():
                out[at][6:] = [members, last_doc if known else None, last_row]
            columns = zip(*out, strict=True) if out else [[]] * len(_POSTING)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _POSTING, strict=True)], schema=_POSTING)

    return post


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order to their slots: of one key, the first entry with the same bytes."""
    key, chain = None, []
    for batch in batches:
        slots = []
        for entry, k, text in zip(batch["entry"].to_pylist(), batch["key"].to_pylist(), batch["bytes"], strict=True):
            if k != key:
                key, chain = k, []
            mine = text.as_py()
            slot = next((s for s, theirs in chain if theirs == mine), None)
            if slot is None:
                chain.append((slot := entry, mine))
            slots.append(slot)
        yield pa.RecordBatch.from_arrays([batch["entry"], pa.array(slots, pa.int64()), batch["members"], batch["last_doc"], batch["last_row"]], schema=_SLOT)


def directory(keys: DataFrame, *, capacity: int, key_bits: int = KEY_BITS, doublings: int = 4) -> DataFrame:
    """``leaf, bucket`` for a table of ``key``: which bucket each hash prefix belongs to.

    The first depth is the least at which ``capacity`` keys a bucket would hold them all at
    half load. Every prefix of that depth is one bucket; a bucket over ``capacity`` splits
    by one more bit, and so on. Bits are looked at ``doublings`` at a time, until what still
    overflows holds entries of one key, which no bit can split; its owner chains them.
    """
    n = keys.count()
    start = min(key_bits, max(0, math.ceil(math.log2(max(1, 2 * n / capacity)))))
    deepest = min(key_bits, start + doublings)
    prefix = lambda column, depth: F.shiftright(column, deepest - depth)
    while True:
        leaves = keys.groupBy(F.shiftright("key", key_bits - deepest).alias("leaf")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        if deepest == key_bits or not leaves.filter((F.col("n") > capacity) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        deepest = min(key_bits, deepest + doublings)
    loads = leaves.withColumn("root", prefix(F.col("leaf"), start))
    depth = F.lit(deepest)
    for d in range(deepest - 1, start - 1, -1):
        loads = loads.withColumn(f"load{d}", F.sum("n").over(W.partitionBy("root", prefix(F.col("leaf"), d))))
        depth = F.when(F.col(f"load{d}") <= capacity, d).otherwise(depth)
    placed = loads.withColumn("depth", depth)
    shift = (F.lit(deepest) - F.col("depth")).cast("int")
    first_leaf = F.call_function("shiftleft", F.call_function("shiftright", F.col("leaf"), shift), shift)
    out = placed.select("leaf", first_leaf.alias("bucket"))
    out.leaf_bits, out.leaf_shift = deepest, key_bits - deepest
    return out


def index(docs: DataFrame, *, capacity: int = 4096, key_bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """Build the index over ``doc_id`` and ``text``; return its postings and its slots."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    postings = save(rows.mapInArrow(_post(key_bits), _POSTING_DDL), "postings")
    entries = postings.filter(F.col("members").isNotNull())
    pages = directory(entries.select("key"), capacity=capacity, key_bits=key_bits)
    where = save(pages, "directory")
    addressed = entries.withColumn("leaf", F.shiftright("key", pages.leaf_shift)).join(where, "leaf")
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # an owner takes a range of keys, that is of neighbouring buckets
    owner = F.floor(F.col("bucket") / F.lit(float(1 << pages.leaf_bits)) * owners).cast("int").alias("owner")
    owned = addressed.select("*", owner).repartitionById(owners, "owner").sortWithinPartitions("key", "entry")
    slots = save(owned.select("entry", "key", "bytes", "members", "last_doc", "last_row").mapInArrow(_chain, _SLOT_DDL), "slots")
    discard(where)
    return postings.select("row", "doc_id", "entry", "sha256"), slots


def exact_groups(docs: DataFrame, *, capacity: int = 4096, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays (a null doc_id is below all others; of
    repeated rows with one doc_id exactly one stays). Columns other than doc_id and text are
    not read, so their names can't clash. An empty table gives no rows. The texts of one
    Arrow batch and of one colliding key are all that a task holds at a time.
    """
    postings, slots = index(docs, capacity=capacity, key_bits=key_bits)
    last = F.max(F.struct(F.col("last_doc").isNotNull().alias("known"), "last_doc", "last_row"))
    groups = slots.groupBy("slot").agg(F.sum("members").alias("group_size"), last.alias("last"))
    verdict = slots.select("entry", "slot").join(groups, "slot").select("entry", "group_size", F.col("last.last_doc").alias("keep_id"), F.col("last.last_row").alias("keep_row"))
    return postings.join(verdict, "entry").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))
