"""Jaccard self-join of shingle sets: prefix blocks, count-vector R-trees, verification.

Equal sets are one node from the start. Two sets as similar as the threshold share a key among
each one's first ``n - ceil(t * n) + 1`` shingles in any order that all sets agree on. Here
that order is by hash, with the shingles that are frequent within a batch of documents last.
Sets that share such a key form a block. How many keys a pair shares at least depends on its
sizes; a set that is in fewer blocks than any partner in them asks for has none and falls out.

Pairs come from R-trees over points ``(block, size, count vector)``: shingles are hashed to
groups, the counts of the groups are coordinates, and the summed minima of two vectors bound
the overlap of their sets. One tree serves all blocks of a task, whatever their sizes. The
first search is greedy: every node enters the trees of a few of its blocks and asks for one
earlier partner of high bound. What links on the whole sets is one component, and a block
within one component needs no more work. A second greedy search across components takes the
other blocks. The third takes those still open and finds every pair across components that
the bound allows; those that share enough of their first shingles are verified, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import both_sides, discard, free_name, lean, only, save, thinned, wanted_filter
from .components import components, hooked
from .hashing import U, mix, words_by_doc

#: Dimensions of a count vector: with about 16 shingles to a group and fewer, its bound tells
#: sets that share a part from sets that are alike.
GROUPS = 512
#: Members of a block that meet in one cell; larger blocks are cut and joined piece by piece.
BLOCK_ROWS = 4096
#: How many frequent shingles are ordered last, at most: 8 bytes each in every task.
FREQUENT = 200_000
#: A frequent shingle of more sets is dealt to several shards.
HOT = 20_000
#: Blocks of a node that take part in the first search.
FIRST_BLOCKS = 3
_KEYS_A_SHARD = 500_000
#: Points of a task's tree, on average; queries, pairs and texts handled at a time.
_POINTS, _QUERIES, _PAIRS, _ROWS = 40_000, 8192, 4096, 4096


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a shorter text's words are one shingle."""
    out: list[np.ndarray] = []
    for _, hashes, counts in words_by_doc(texts):
        n = len(hashes)
        rolled = np.zeros(max(0, n - width + 1), U)
        for j in range(width):
            rolled = mix(rolled * U(0x2545F4914F6CDD1D) + hashes[j : n - width + 1 + j]) if n >= width else rolled
        ends = np.cumsum(counts)
        for start, k in zip((ends - counts).tolist(), counts.tolist(), strict=True):
            if k >= width:
                out.append(np.unique(rolled[start : start + k - width + 1]))
            elif k:
                one = np.zeros(1, U)
                for h in hashes[start : start + k]:
                    one = mix(one * U(0x2545F4914F6CDD1D) + h)
                out.append(mix(one + U(k)))
            else:
                out.append(np.empty(0, U))
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].to_pylist()]


def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((mix(s) >> U(55)).astype(np.int64), minlength=GROUPS)


def packed(counts: np.ndarray) -> bytes:
    """A count vector in a byte a group, or in four if a count needs them."""
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def unpacked(vectors: list[bytes]) -> np.ndarray:
    kinds = [np.frombuffer(v, np.uint8 if len(v) == GROUPS else "<u4") for v in vectors]
    small = all(len(v) == GROUPS for v in vectors)
    return np.array(kinds, np.uint16 if small else np.int64).reshape(-1, GROUPS)


_PROFILE_DDL = "frequent boolean, row long, doc_id long, n long, node long"


def node_id(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    return int(mix(np.add.reduce(s, keepdims=True, dtype=U) + mix(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True, dtype=U) + U(len(s))))[0])


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(node_id, sets), U, len(sets)).view(np.int64)


def _profile(width: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch), width)
            nodes, n = _nodes(sets), np.fromiter(map(len, sets), np.int64, len(sets))
            names = [x.split()[0] for x in _PROFILE_DDL.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), bool)), batch["row"], batch["doc_id"], pa.array(n), pa.array(nodes, mask=n == 0)], names=names)
            first = dict(zip(nodes.tolist(), sets, strict=True))
            found, seen = np.unique(np.concatenate(list(first.values()) or [np.empty(0, U)]), return_counts=True)
            often = seen >= 3
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, bool)), pa.array(found[often].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(seen[often].astype(np.int64)), pa.nulls(k, pa.int64())], names=names)

    return profile


def prefix(s: np.ndarray, frequent: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The keys of a set: its first shingles in the common order."""
    n = len(s)
    if not n:
        return s
    if len(frequent):
        at = np.searchsorted(frequent, s)
        at[at == len(frequent)] = 0
        s = s[np.argsort(frequent[at] == s, kind="stable")]
    return s[: n - math.ceil(threshold * n) + 1]


_KEYS_DDL = "shard int, node array<long>, size array<int>, at array<int>, key array<long>"


def _keys(width: int, threshold: Fraction, shards: int, frequent):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, pieces = frequent.value
        for batch in batches:
            sets = shingle_sets(_texts(batch), width)
            distinct = {node: s for node, s in zip(_nodes(sets).tolist(), sets, strict=True) if len(s)}
            if not distinct:
                continue
            own = [prefix(s, often, threshold) for s in distinct.values()]
            key, at = np.concatenate(own), np.repeat(np.arange(len(own)), [*map(len, own)])
            nodes, sizes = np.array([*distinct], np.int64), np.array([*map(len, distinct.values())], np.int32)
            salt = mix(nodes.view(U))[at] % U(1)
            if len(often):  # the rows of a hot key go to several shards
                place = np.searchsorted(often, key)
                place[place == len(often)] = 0
                salt = mix(nodes.view(U))[at] % np.where(often[place] == key, pieces[place], 1).astype(U)
            shard = (mix(key ^ U(0x9FB21C651E98DF25) ^ mix(salt)) % U(shards)).astype(np.int64)
            order = np.lexsort((at, shard))
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                mine = order[lo:hi]
                present, local = np.unique(at[mine], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([shard[mine[0]]], pa.int32()), pa.array([nodes[present]], pa.list_(pa.int64())), pa.array([sizes[present]], pa.list_(pa.int32())), pa.array([local.astype(np.int32)], pa.list_(pa.int32())), pa.array([key[mine].view(np.int64)], pa.list_(pa.int64()))], names=["shard", "node", "size", "at", "key"])

    return keys


def _least_need(n: np.ndarray, group: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The least number of keys that a member of a block shares with any partner there.

    Members come sorted by block and size. Of the smaller sets the smallest that fits needs
    least, of the larger ones the largest; for these, what rounding adds is left out.
    """
    p, q = threshold.numerator, threshold.denominator
    at, spot = np.arange(len(n)), group << 32
    low = np.searchsorted(spot + n, spot - (-n * p) // q)
    high = np.searchsorted(spot + n, spot + n * q // p, "right") - 1
    need = np.full(len(n), np.iinfo(np.int32).max, np.int64)
    some = low < at
    need[some] = least_shared(n[some], n[low[some]], threshold)
    some = high > at
    m = n[high[some]]
    need[some] = np.minimum(need[some], 1 - ((p + q) * (p * m + q - 1) - p * q * (n[some] + m)) // (q * (p + q)))
    return np.maximum(need, 1)


#: ``need`` is the least number of keys that the node shares with any partner of the block.
_MEMBER_DDL = "block long, node long, n int, times int, need int"


def _blocks(threshold: Fraction, frequent):
    """Keys of a shard to the members of its blocks; blocks with the same members are one, ``times`` over.

    A block is named by its members, so that those of other shards can join it.
    """

    def block(rows: list) -> pa.RecordBatch:
        key, node, size = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((node, size, key))
        key, node, size = (x[order] for x in (key, node, size))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size = (x[new] for x in (key, node, size))
        often, pieces = frequent.value
        hot = often[pieces > 1]
        # a set whose neighbours by size are too large or small has no partner here
        fits = (key[1:] == key[:-1]) & (size[:-1] * threshold.denominator >= size[1:] * threshold.numerator)
        keep = np.isin(key.view(U), hot)
        keep[1:] |= fits
        keep[:-1] |= fits
        key, node, size = (x[keep] for x in (key, node, size))
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        width = np.diff(np.append(cuts, len(key)))
        sums = np.add.reduceat(mix(node.view(U)), cuts) if len(cuts) else node.view(U)
        whole = np.isin(key[cuts].view(U), hot)
        sums[whole] = mix(key[cuts][whole].view(U))  # a hot block is in pieces, so it is like no other
        _, first, seen = np.unique(sums, return_index=True, return_counts=True)
        times = np.zeros(len(cuts), np.int32)
        times[first] = seen
        times, named = np.repeat(times, width), np.repeat(sums, width).view(np.int64)
        keep = times > 0
        need = _least_need(size, np.repeat(np.arange(len(cuts)), width), threshold)
        need[np.repeat(whole, width)] = 1  # a piece does not show all partners
        return pa.RecordBatch.from_arrays([pa.array(named[keep]), pa.array(node[keep]), pa.array(size[keep].astype(np.int32)), pa.array(times[keep]), pa.array(need[keep].astype(np.int32))], names=["block", "node", "n", "times", "need"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for i, shard in enumerate(batch["shard"].to_pylist()):
                if shard != now and rows:
                    yield block(rows)
                    rows = []
                now = shard
                at = np.asarray(batch["at"][i].values)
                rows.append((np.asarray(batch["key"][i].values), np.asarray(batch["node"][i].values)[at], np.asarray(batch["size"][i].values)[at].astype(np.int64)))
        if rows:
            yield block(rows)

    return blocks


def least_overlap(n: np.ndarray, m: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The least intersection with which sets of n and m shingles reach the threshold."""
    p, q = threshold.numerator, threshold.denominator
    return -((-p * (n + m)) // (p + q))


class CountTree:
    """An R-tree over points of a block, a size, a component and a count vector.

    It is packed in order of block, size and fullest group. A node knows the ranges of its
    points' blocks, sizes and components, and the largest count of each group.
    """

    def __init__(self, n: np.ndarray, vectors: np.ndarray, block: np.ndarray | None = None, part: np.ndarray | None = None, leaf: int = 16, fan: int = 8):
        block = np.zeros(len(n), np.int64) if block is None else block
        part = np.arange(len(n)) if part is None else part
        self.order = np.lexsort((vectors.argmax(axis=1) if len(n) else n, n, block))
        self.block, self.n, self.part, self.vectors = (x[self.order] for x in (block, n, part, vectors))
        self.leaf, self.fan, self.levels = leaf, fan, []
        low, high, top, wide = [self.block, self.n, self.part], [self.block, self.n, self.part], self.vectors, leaf
        while not self.levels or len(top) > fan:
            at = np.arange(0, len(top), wide)
            low, high = [np.minimum.reduceat(x, at) for x in low] if len(at) else low, [np.maximum.reduceat(x, at) for x in high] if len(at) else high
            top = np.maximum.reduceat(top, at, axis=0) if len(at) else top
            self.levels.append((low, high, top))
            wide = fan

    def pairs(self, asked: np.ndarray, threshold: Fraction, *, earlier: bool = False, greedy: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of each asked point (a place in the tree) the partners that the bound allows.

        Partners are of the same block and of another component; ``earlier`` takes only those
        at lesser places. A greedy search follows the two best nodes of each level and ends
        with one partner, if any.
        """
        p, q = threshold.numerator, threshold.denominator
        at, node = np.repeat(asked, len(self.levels[-1][2])), np.tile(np.arange(len(self.levels[-1][2])), len(asked))
        span = self.leaf * self.fan ** (len(self.levels) - 1)
        for low, high, top in [*reversed(self.levels), (None, None, self.vectors)]:
            lows, highs = (low, high) if low else ([self.block, self.n, self.part],) * 2
            may = (lows[0][node] <= self.block[at]) & (highs[0][node] >= self.block[at]) & (highs[1][node] * q >= self.n[at] * p) & (lows[1][node] * p <= self.n[at] * q)
            may &= (lows[2][node] != self.part[at]) | (highs[2][node] != self.part[at])
            if earlier:
                may &= node * span < at
            at, node = at[may], node[may]
            need, bound = least_overlap(self.n[at], lows[1][node], threshold), np.zeros(len(at), np.int64)
            for lo in range(0, len(at), _PAIRS):
                some = slice(lo, lo + _PAIRS)
                bound[some] = np.minimum(self.vectors[at[some]], top[node[some]]).sum(axis=1)
            may = bound >= need
            at, node, bound = at[may], node[may], bound[may]
            if greedy:
                order = np.lexsort((-bound, at))
                at, node = at[order], node[order]
                start = np.searchsorted(at, at)
                best = np.arange(len(at)) - start < (2 if low else 1)
                at, node = at[best], node[best]
            if low:
                wide, below = (self.leaf, len(self.n)) if span == self.leaf else (self.fan, -(-len(self.n) // (span // self.fan)))
                node = (node[:, None] * wide + np.arange(wide)).reshape(-1)
                at = np.repeat(at, wide)
                at, node = at[node < below], node[node < below]
                span = 1 if span == self.leaf else span // self.fan
        return at, node

    def search(self, n: int, vector: np.ndarray, threshold: Fraction) -> np.ndarray:
        """Places, in the input's order, of the points that a set from outside may match."""
        one = CountTree(np.append(self.n[np.argsort(self.order)], n), np.vstack([self.vectors[np.argsort(self.order)], vector]), leaf=self.leaf, fan=self.fan)
        own = np.flatnonzero(one.order == len(self.n))
        return one.order[one.pairs(own, threshold)[1]]


def least_shared(n: np.ndarray, m: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The least number of keys that two such sets have in common.

    Of the shingles they share, those up to where the first prefix ends are keys of both; at
    most as many follow as that set has behind its prefix.
    """
    p, q = threshold.numerator, threshold.denominator
    return least_overlap(n, m, threshold) + (-p * np.maximum(n, m)) // q + 1


_PAIR_DDL = "a long, b long, shared long, least long"


def _tree_pairs(threshold: Fraction, greedy: bool):
    """The points of a task to pairs of nodes; the whole partition is one tree.

    ``shared`` counts the keys whose cells of this task hold the pair, ``least`` what it needs.
    """

    def summed(found: list[np.ndarray]) -> np.ndarray:
        a, b, shared, least = np.hstack(found)
        order = np.lexsort((b, a))
        a, b, shared, least = (x[order] for x in (a, b, shared, least))
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return np.stack([a[at], b[at], np.add.reduceat(shared, at) if len(at) else shared, least[at]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table = pa.Table.from_batches(rows) if rows else None
        if table is None or not table.num_rows:
            return
        node, n, block, part, side, times = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("node", "n", "cell", "component", "side", "times"))
        vectors = unpacked(table["counts"].to_pylist())
        tree = CountTree(n, vectors, block, part)
        node, side, times = node[tree.order], side[tree.order], times[tree.order]
        found = [np.empty((4, 0), np.int64)]
        asked = np.flatnonzero(side < 2)
        for lo in range(0, len(asked), _QUERIES):
            some = asked[lo : lo + _QUERIES]
            for earlier, mine in ((True, some[side[some] == 0]), (False, some[side[some] == 1])):
                a, b = tree.pairs(mine, threshold, earlier=earlier, greedy=greedy)
                ok = (node[a] != node[b]) & (side[b] == (0 if earlier else 2))
                a, b = a[ok], b[ok]
                found.append(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), times[a], least_shared(tree.n[a], tree.n[b], threshold)]))
            if sum(f.shape[1] for f in found) > 1 << 20:
                found = [summed(found)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(found)], names=[x.split()[0] for x in _PAIR_DDL.split(", ")])

    return pairs


def _verify(width: int, threshold: Fraction):
    """Pairs with both texts to those that reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = dict(zip([*some["a"].to_pylist(), *some["b"].to_pylist()], [*some["text_a"], *some["text_b"]], strict=True))
                sets = dict(zip(texts, shingle_sets([t.as_py() or b"" for t in texts.values()], width), strict=True))
                for a, b in zip(some["a"].to_pylist(), some["b"].to_pylist(), strict=True):
                    x, y = sets[a], sets[b]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _vectors(width: int):
    """Texts of nodes with their count vectors; each node once a task."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [not (node in seen or seen.add(node)) for node in batch["node"].to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            counts = [packed(count_vector(s)) for s in shingle_sets(_texts(batch), width)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(counts, pa.binary()), batch["text"]], names=["node", "counts", "text"])

    return vectors


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def jaccard_components(docs: DataFrame, *, width: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, row.

    A text's words are its runs without ASCII white space, A-Z lower-cased; its set holds the
    distinct ``width``-word shingles, or all its words as one if they are fewer. Null, empty
    and blank texts have empty sets and link with nothing. Sets whose Jaccard similarity is
    ``threshold`` or more link; ``component_id`` is the least doc_id that links lead to, the
    row's own included (null ids count for nothing; alone, they stay null). Rows equal in id
    and text share ``row`` and come out as often as they went in. Only doc_id and text are
    read. An empty table gives no rows. The result holds on 64-bit hashes: of words, of
    shingles, of rows and of whole sets.
    """
    spark = docs.sparkSession
    base = _rows(docs)
    profile = save(base.mapInArrow(lean(_profile(width)), _PROFILE_DDL), "profiles")
    often = profile.filter("frequent").groupBy(F.col("row").alias("shingle")).agg(F.sum("n").alias("df")).orderBy(F.desc("df"), "shingle").limit(FREQUENT).toArrow()
    shingle, df = (np.asarray(often[c].combine_chunks()) for c in ("shingle", "df"))
    order = np.argsort(shingle.view(U))
    frequent = spark.sparkContext.broadcast((shingle.view(U)[order], -(-df[order] // HOT)))
    rows = profile.filter(~F.col("frequent")).select("row", "doc_id", "n", "node")
    classes = save(rows.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil((1 - threshold) * total / _KEYS_A_SHARD))
    keys = base.select("text").mapInArrow(lean(_keys(width, threshold, shards, frequent), _ROWS), _KEYS_DDL)
    met = save(keys.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(_blocks(threshold, frequent)), _MEMBER_DDL), "met-blocks")
    # a node with a partner is in at least as many blocks as some of these ask for
    shared = F.sum("times").over(W.partitionBy("node").orderBy("need"))
    able = met.select("node", "need", "times").withColumn("shared", shared).filter("shared >= need").select("node").distinct()
    able = save(able, "able")
    # blocks of several shards with the same members are one, too
    members = thinned(met.drop("need"), wanted_filter(able, "node"), "node").groupBy("block", "node").agg(F.first("n").alias("n"), F.sum("times").cast("int").alias("times"))
    members = save(members, "blocks")
    discard(met)

    wanted = save(able.join(classes.select("node", "row"), "node"), "suspect-rows")
    suspects = only(base.select("row", "text"), wanted, "row").select("node", "text")
    suspects = save(suspects.mapInArrow(lean(_vectors(width), _ROWS), "node long, counts binary, text binary"), "suspects")

    def links(points: DataFrame, greedy: bool, name: str) -> DataFrame:
        """Pairs of nodes in the cells of ``points`` that reach the threshold on whole sets."""
        points = save(points.join(suspects.select("node", "counts"), "node"), f"{name}-points")
        tasks = max(1, math.ceil(points.count() / _POINTS))
        met = points.repartition(tasks, "cell").mapInArrow(lean(_tree_pairs(threshold, greedy)), _PAIR_DDL)
        # only the last search meets every key that a pair shares
        met = met if greedy else met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).filter("shared >= least")
        pairs = save(met.select("a", "b").distinct(), f"{name}-candidates")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = only(suspects.select("node", "text"), nodes, "node")
        found = save(both_sides(pairs, texts, "node", "text").mapInArrow(lean(_verify(width, threshold), _ROWS), "a long, b long"), name)
        discard(points, pairs)
        return found

    def open_members(parts: DataFrame) -> DataFrame:
        """Members of the blocks that hold several components, and into how many pieces to cut these."""
        placed = members.join(parts, "node", "left").select("block", "node", "n", "times", F.coalesce("component", "node").alias("component"))
        placed = save(placed, "placed")
        sized = placed.groupBy("block").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        sized = save(sized.select("block", F.ceil(F.col("members") / BLOCK_ROWS).cast("long").alias("pieces")), "open-blocks")
        still = save(placed.join(sized, "block"), "open-members")
        discard(placed, sized)
        return still

    # a large block is dealt in pieces; what that keeps apart is left to the third search
    piece = F.when(F.coalesce("pieces", F.lit(1)) == 1, F.col("block")).otherwise(F.xxhash64("block", F.pmod(F.xxhash64("node"), F.col("pieces")))).alias("cell")
    chosen = members.groupBy("node", "n").agg(*(F.min(F.struct(F.xxhash64("block", F.lit(i)).alias("h"), "block")).alias(f"b{i}") for i in range(FIRST_BLOCKS)))
    chosen = chosen.select("node", "n", F.explode(F.array_distinct(F.array(*(F.col(f"b{i}.block") for i in range(FIRST_BLOCKS))))).alias("block"))
    large = chosen.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("pieces")).filter("pieces > 1")
    first = chosen.join(large, "block", "left").select("node", "n", piece, F.col("node").alias("component"), F.lit(0).alias("side"), F.lit(1).alias("times"))
    found = links(first, True, "links")
    parts = hooked(found)

    still = open_members(parts)
    second = links(still.select("node", "n", piece, "component", F.lit(0).alias("side"), "times"), True, "more-links")
    discard(still, parts)
    parts = components(found.union(second))

    still = open_members(parts)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other")
    low, high = F.least("piece", "other"), F.greatest("piece", "other")
    side = F.when(low == high, 0).when(F.col("piece") < F.col("other"), 1).otherwise(2).alias("side")
    cells = still.select("*", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece"), other).select("node", "n", "times", "component", F.xxhash64("block", low, high).alias("cell"), side)
    third = links(cells, False, "last-links")
    # what the last links join are whole components
    at = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    joined = third.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    over = components(joined).select(F.col("node").alias("component"), F.col("component").alias("part"))
    final = parts.join(over, "component", "left").select("node", F.coalesce("part", "component").alias("component"))
    lone = over.select(F.col("component").alias("node"), F.col("part").alias("component")).join(parts.select("node"), "node", "left_anti")
    final = final.union(lone)

    named = classes.join(final.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = save(named, "named")
    least = named.groupBy("part").agg(F.min("least_id").alias("component_id"), F.sum("rows").alias("rows")).filter("rows > 1")
    told = save(named.join(least.drop("rows"), "part").select(F.col("node").alias("told"), "component_id"), "components")
    # a row alone in its component is its own; only the others are looked up
    out = rows.join(told, F.col("node") == F.col("told"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("told").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row")
    discard(classes, members, able, wanted, suspects, still, found, second, third, parts, named)
    return out


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the least doc_id stays.

    Rows without words stay, as do rows with a null id whose component has no other id; of
    rows equal in id and text one stays. Other columns are kept whatever their names.
    """
    found = jaccard_components(docs, **settings)
    row = free_name(docs, "row")
    gone = found.filter((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias(row)).distinct()
    marked = docs.withColumn(row, F.xxhash64(F.col("doc_id"), F.col("text")))
    return marked.join(gone, row, "left_anti").dropDuplicates([row]).drop(row)
