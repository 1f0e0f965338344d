"""Near-duplicate lines: a segment-partition edit join with banded bit-parallel checks.

A line is cut into ``errors + 1`` segments. A line within ``errors`` edits holds one of them
unchanged, near its place; which substrings can match depends on both lengths. Segments are
index entries and those substrings are probes, under keys of text, segment number and indexed
length. Long lines may also differ by some whole words, and hold too many segments for that.
Of two of them, a run of words longer than a window is the same in both, and so is the run's
least-hashed sequence of words in it; these sequences are keys, too.

Lines that share a key form a block. A line goes as soon as one earlier line is near it, so
blocks are not paired up: each line first meets the earliest and the commonest of its blocks.
Lines that stay then meet all earlier lines of their blocks. Pairs that lengths or tallies of
words and characters rule out fall away; the others are verified on the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import both_sides, discard, free_name, lean, save, thinned, wanted_filter
from .hashing import U, mix, powers, words_by_doc

_BLANK = " \t\r\x0b\x0c"
_ENTRIES_A_SHARD = 1_000_000
#: Characters hashed and pairs compared at a time.
_CHARS, _PAIRS = 1 << 19, 1 << 19
#: Texts, or pairs of lines, handled at a time.
_ROWS = 4096
#: Texts that lines are cut out of at a time.
_CUT_ROWS = 512
#: A key of more lines that are hashed together is dealt to several shards.
_HOT = 64
#: Lines of a block that meet as many others in one cell; larger blocks meet cell by cell.
BLOCK_LINES = 8192
#: Unless a least length is given, one edit is allowed a so many characters, up to the edits.
_CHARS_AN_EDIT = 20
#: One word edit is allowed a so many words of the longer line.
_WORDS_AN_EDIT = 20
#: Words of the shorter line, of the longer one, in a sequence, and sequences in a window. Two
#: lines share 10 words in a row in the first class and 13 in the second, of which a window
#: takes 10 and 13: (n - t) / (t + 1), rounded up, for t = n // 20 edits and n words.
_CLASSES = ((19, 39, 6, 5), (38, None, 6, 8))


def _wordy(errors: int) -> int:
    """Lines of so many words that stay within ``errors`` character edits share 13 in a row.

    Such an edit touches two words at most, so ``n - 2 * errors`` are left in ``errors + 1`` runs.
    """
    return 15 * errors + 13


def line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def _split(text: str | None) -> list[str]:
    return [line.strip(_BLANK) for line in (text or "").split("\n")]


_PLANES = tuple(f"{c}{i}" for c in ("low", "high") for i in range(4))
#: What the first look at a pair compares, and what members of blocks are compared by.
_BRIEF = ("chars", "words", "tally", "bag")
_FACTS = (*_BRIEF, *_PLANES)
_LINES_DDL = "row long, doc_id long, keys long, lines array<long>"
_FACTS_DDL = f"id long, row long, line string, chars int, words int, {', '.join(f'{c} long' for c in _FACTS[2:])}"


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Per text: about how many keys its lines have, and the id of each line (null if blank)."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        split = [_split(t) for t in texts]
        ids = [line_id(s) if len(s) >= least else None for lines in split for s in lines]
        keys = [len(t or "") // 20 + 12 * len(lines) for t, lines in zip(texts, split, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, split)]), pa.int32()), pa.array(ids, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(keys, pa.int64()), lists], names=[x.split()[0] for x in _LINES_DDL.split(", ")])


def _measure(lines: list[str], errors: int) -> dict[str, np.ndarray]:
    """Of each line: characters, words, a tally of those, and a coarse and a fine one of these."""
    chars, words = np.fromiter(map(len, lines), np.int64, len(lines)), np.zeros(len(lines), np.int64)
    bag, planes = np.zeros(len(lines), U), np.zeros((len(lines), 8), U)
    for first, hashes, counts in words_by_doc([line.encode() for line in lines]):
        words[first : first + len(counts)] = counts
        bag[first : first + len(counts)] = _bags(mix(hashes), counts)
        planes[first : first + len(counts)] = _fine_bags(mix(hashes + U(1)), counts)
    tally = np.zeros(len(lines), U)
    short = np.flatnonzero((words < _wordy(errors)) & (chars > 0))
    for at, hi in _slices(chars[short]):
        some = short[at:hi]
        codes = np.frombuffer("".join([lines[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
        tally[some] = _tallies(codes, np.cumsum(chars[some]) - chars[some])
    return {"chars": chars, "words": words, "tally": tally, "bag": bag, **{c: planes[:, i] for i, c in enumerate(_PLANES)}}


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbours of ``_CHARS`` together, or alone if they are larger."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        hi = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHARS, "right")))
        yield at, hi
        at = hi


def _tallies(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per line, counts of 16 classes of characters modulo 16, in one 64-bit word."""
    one = U(1) << (mix(codes.astype(U)) >> U(60) << U(2))
    out = np.zeros(len(starts), U)
    for k in range(16):
        shift = U(4 * k)
        out |= (np.add.reduceat((one >> shift) & U(1), starts) & U(15)) << shift
    return out


def _bags(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same of the words of each line, which come end to end."""
    owner = np.repeat(np.arange(len(counts)), counts)
    seen = np.bincount(owner * 16 + (hashes >> U(60)).astype(np.int64), minlength=16 * len(counts)).reshape(-1, 16)
    return ((seen.astype(U) & U(15)) << (U(4) * np.arange(16, dtype=U))).sum(axis=1, dtype=U)


def _fine_bags(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of 256 classes of words modulo 4: four 64-bit words of low bits and four of high ones."""
    out = np.zeros((len(counts), 8), U)
    ends = np.cumsum(counts)
    for lo in range(0, len(counts), _ROWS):
        some = counts[lo : lo + _ROWS]
        mine = hashes[ends[lo] - counts[lo] : ends[lo + len(some) - 1]]
        owner = np.repeat(np.arange(len(some)), some)
        seen = np.bincount(owner * 256 + (mine >> U(56)).astype(np.int64), minlength=256 * len(some)).reshape(-1, 256)
        for bit in (0, 1):
            out[lo : lo + len(some), 4 * bit : 4 * bit + 4] = np.packbits((seen >> bit & 1).astype(np.uint8), axis=1).view(U)
    return out


def fine_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`tally_gap` of rows of :func:`_fine_bags`."""
    low = a[:, :4] ^ b[:, :4]
    two = (a[:, 4:] ^ b[:, 4:] ^ (~a[:, :4] & b[:, :4])) & ~low
    return (np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(two)).sum(axis=1)


def tally_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the summed differences of two lines' counts."""
    gap = np.zeros(len(a), np.int64)
    for k in range(16):
        d = (((a >> U(4 * k)) - (b >> U(4 * k))) & U(15)).astype(np.int64)
        gap += np.minimum(d, 16 - d)
    return gap


def segment(length: np.ndarray, errors: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of lines of the given lengths; the last are longest."""
    parts = errors + 1
    size, longer = length // parts, length % parts
    before = np.maximum(0, i - (parts - longer))
    return i * size + before, size + (i >= parts - longer)


def allowed(length: np.ndarray, errors: int, graded: bool) -> np.ndarray:
    """Edits allowed between a line of this length and a shorter one."""
    return np.minimum(errors, length // _CHARS_AN_EDIT) if graded else np.full(len(length), errors)


def entries(lines: list[str], errors: int, graded: bool = False) -> tuple[np.ndarray, ...]:
    """Keys of the lines' segments and probes: key, line number, whether it is a probe.

    The longer line of a pair sets the edits and so the segments; a line near the next step of
    edits is indexed under both.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum(lengths) - lengths
    up, down = powers(len(codes))
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(mix(codes.astype(U) + U(1)) * up, out=sums[1:])
    keys, which, probes = [], [], []

    def put(rows: np.ndarray, start: np.ndarray, size: np.ndarray, i: int, indexed: np.ndarray, probe: bool) -> None:
        lo = at[rows] + start
        text = (sums[lo + size] - sums[lo]) * down[lo]
        keys.append(mix(text + mix(((indexed * 64 + edits) * 64 + i).astype(U))))
        which.append(rows)
        probes.append(np.full(len(rows), probe))

    own = allowed(lengths, errors, graded)
    for edits in range(1 if graded else errors, errors + 1):
        some = np.flatnonzero((own <= edits) & (allowed(lengths + edits, errors, graded) >= edits))
        asking = np.flatnonzero(own == edits)
        for i in range(edits + 1):
            start, size = segment(lengths[some], edits, i)
            put(some, start, size, i, lengths[some], False)
            for extra in range(edits + 1):
                indexed = lengths[asking] - extra
                p, size = segment(indexed, edits, i)
                for shift in range(max(-i, extra - (edits - i)), min(i, extra + (edits - i)) + 1):
                    if not extra and not shift:  # the line's own segment
                        continue
                    fits = (p + shift >= 0) & (p + shift + size <= lengths[asking]) & (size > 0)
                    put(asking[fits], (p + shift)[fits], size[fits], i, indexed[fits], True)
    if not keys:
        keys, which, probes = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    return np.concatenate(keys), np.concatenate(which), np.concatenate(probes), _tallies(codes, at)


def anchors(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the least-hashed word sequences of every window: key, line number, place in the line."""
    found = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for begin, hashes, counts in words_by_doc(lines):
        for c, (least, most, size, window) in enumerate(_CLASSES):
            mine = (counts >= least) & (counts <= (most or counts.max(initial=0)))
            codes, lengths = hashes[np.repeat(mine, counts)], counts[mine]
            if not len(codes):
                continue
            key = np.full(len(codes) - size + 1, c + 1, U)
            for i in range(size):
                key = mix(key + codes[i : i + len(key)])
            windows = np.lib.stride_tricks.sliding_window_view(key, window)
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)[: len(windows)]
            whole = np.flatnonzero(np.arange(len(windows)) + size + window - 1 <= ends[owner])
            at = np.unique(windows[whole].argmin(axis=1) + whole)
            owner = np.searchsorted(ends, at, "right")
            found.append((key[at], begin + np.flatnonzero(mine)[owner], at - (ends - lengths)[owner]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


_ENTRY_DDL = "shard int, entries binary"
#: Bytes of a key that travel. Lines that only these bring together fall apart when compared.
_KEY_BYTES = 6


def _pack(ids: np.ndarray, ranks: np.ndarray, counts: np.ndarray, key: np.ndarray, at: np.ndarray) -> bytes:
    """Lines and the entries of each in turn as bytes, like bytes of all together as they compress better.

    A rank goes without its lowest byte: it only chooses which line of a block is met first.
    """
    turned = lambda x, t: np.ascontiguousarray(x.astype(t)).view(np.uint8).reshape(len(x), -1).T
    head = np.array([len(ids), len(key)], "<u4").tobytes()
    key = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
    return b"".join((head, ids.astype("<i8").tobytes(), turned(ranks, "<f4")[1:].tobytes(), turned(counts, "<u4").tobytes(), key.tobytes(), turned(at, "<i4").tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """Key, line, rank and place of each entry of :func:`_pack`."""
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + 8 * n

    def plane(t: str, rows: int, width: int = 4) -> np.ndarray:
        nonlocal at
        out = np.zeros((rows, 4), np.uint8)
        out[:, 4 - width :] = np.frombuffer(data, np.uint8, width * rows, at).reshape(width, rows).T
        at += width * rows
        return out.view(t).ravel()

    ids, ranks, counts = np.frombuffer(data, "<i8", n, 8), plane("<f4", n, 3), plane("<u4", n)
    key = np.zeros((m, 8), np.uint8)
    key[:, :_KEY_BYTES] = np.frombuffer(data, np.uint8, _KEY_BYTES * m, at).reshape(m, -1)
    at += _KEY_BYTES * m
    return key.view("<u8").ravel(), np.repeat(ids, counts), np.repeat(ranks, counts), plane("<i4", m)


def _deal(least: int, errors: int, graded: bool, shards: int):
    """Keys of a batch's lines by shard.

    ``at`` is the place of a sequence of words, or -1, doubled, and odd for keys that are dealt
    to several shards: of their lines one goes to the key's own shard.
    """

    def keyed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = [line.encode() for line in lines]
        key, which, at = anchors(data)
        wordy = _wordy(errors)
        short = [i for i, line in enumerate(data) if len(line) < 2 * wordy or len(line.split()) < wordy] if errors else []
        own, owner, _, _ = entries([lines[i] for i in short], errors, graded) if short else (key[:0], which[:0], None, None)
        return np.concatenate([key, own]), np.concatenate([which, np.array(short, np.int64)[owner]]), np.concatenate([at, np.full(len(own), -1)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank: dict[str, float] = {}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                now = math.inf if doc_id is None else float(doc_id)
                for line in _split(text):
                    if len(line) >= least and now < rank.get(line, math.nan) or line not in rank:
                        rank[line] = now
            lines = [line for line in rank if len(line) >= least]
            for lo, hi in _slices(np.fromiter(map(len, lines), np.int64, len(lines))):
                some = lines[lo:hi]
                key, which, at = keyed(some)
                ids, ranks = np.fromiter(map(line_id, some), np.int64, len(some)), np.array([rank[x] for x in some], np.float32)
                _, first, back, seen = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                hot = seen[back] > _HOT
                away = hot.copy()
                away[first] = False
                shard = (mix(key ^ U(0x9FB21C651E98DF25) ^ np.where(away, mix(ids[which].view(U)), U(0))) % U(shards)).astype(np.int64)
                spot = shard << 32 | which
                order = np.argsort(spot)
                spot, code, place = spot[order], key[order], (2 * at + hot)[order]
                starts = np.flatnonzero(np.diff(spot, prepend=-1))  # of each line of each shard
                counts, of, home = np.diff(starts, append=len(spot)), spot[starts] & 0xFFFFFFFF, spot[starts] >> 32
                cuts = np.flatnonzero(np.diff(home, prepend=-1))
                ends = np.append(starts, len(spot))
                packed = [_pack(ids[of[a:b]], ranks[of[a:b]], counts[a:b], code[ends[a] : ends[b]], place[ends[a] : ends[b]]) for a, b in zip(cuts, np.append(cuts, len(home))[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(home[cuts], pa.int32()), pa.array(packed, pa.binary())], names=["shard", "entries"])

    return deal


#: What a shard tells: two lines of a block, of which one is its first or commonest, or a line
#: of a block of more under its key, with its first and last place in the line.
STAR, MEMBER = 0, 1
_MET_DDL = "kind int, a long, b long, at int, upto int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a shard to what it tells of its blocks."""

    def tell(kind: int, a: np.ndarray, b: np.ndarray, at: np.ndarray, upto: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(at.astype(np.int32)), pa.array(upto.astype(np.int32))], names=[x.split()[0] for x in _MET_DDL.split(", ")])

    def blocks(key, ids, rank, at) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.append(False, same) | (at[order] & 1 == 1)]  # a key of one line tells nothing
        if not len(order):
            return
        key, ids, rank, at = (x[order] for x in (key, ids, rank, at))
        order = np.lexsort((at, ids, key))
        key, ids, rank, at = (x[order] for x in (key, ids, rank, at))
        line = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])) - 1
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        # a row a line of a block: its least rank, and how many batches hold it
        least, times = np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(key)))
        group = np.cumsum(np.concatenate([[True], key[starts][1:] != key[starts][:-1]])) - 1
        size, hot = np.bincount(group), np.bincount(group, weights=np.maximum.reduceat(at & 1, starts)) > 0
        pairs = []
        for rule in ((ids[starts], least), (least, -times)):
            order = np.lexsort((*rule, group))
            pivot = ids[starts][order[np.cumsum(size) - size]]
            a, b = pivot[group], ids[starts]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b])
        a, b = np.unique(np.hstack(pairs), axis=1)
        yield tell(STAR, a, b, np.full(len(a), -1), np.full(len(a), -1))
        held = ((size > 2) | hot)[group]
        yield tell(MEMBER, key[starts][held].view(np.int64), ids[starts][held], np.minimum.reduceat(at, starts)[held] >> 1, np.maximum.reduceat(at, starts)[held] >> 1)

    now, held = None, []
    for batch in batches:
        for i, shard in enumerate(batch["shard"].to_pylist()):
            if shard != now and held:
                yield from blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            now = shard
            held.append(_unpack(batch["entries"][i].as_py()))
    if held:
        yield from blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _may(errors: int, graded: bool, chars, words, tally, bag, planes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far apart in words the tallies hold lines ``a`` and ``b`` at least, or -1 if too far to be near."""
    n, m, p, q = np.maximum(chars[a], chars[b]), np.minimum(chars[a], chars[b]), np.maximum(words[a], words[b]), np.minimum(words[a], words[b])
    edits, swaps = allowed(n, errors, graded), p // _WORDS_AN_EDIT
    close, near = n - m <= edits, p - q <= swaps
    some = np.flatnonzero(close | near)
    gap = tally_gap(bag[a[some]], bag[b[some]])
    live = np.flatnonzero(gap <= np.maximum(3 * edits[some], 2 * swaps[some]))
    some, gap = some[live], gap[live]
    if planes is not None:
        gap = np.maximum(gap, fine_gap(planes[a[some]], planes[b[some]]))
    short = p[some] < _wordy(errors)
    own = np.zeros(len(some), np.int64)
    own[short] = tally_gap(tally[a[some[short]]], tally[b[some[short]]])
    ok = close[some] & (gap <= 3 * edits[some]) & (own <= 2 * edits[some]) | near[some] & (gap <= 2 * swaps[some])
    out = np.full(len(a), -1, np.int64)
    out[some[ok]] = gap[ok]
    return out


def _brief(batch: pa.RecordBatch, suffix: str = "") -> tuple[np.ndarray, ...]:
    chars, words = (np.asarray(batch[c + suffix]).astype(np.int64) for c in _BRIEF[:2])
    return chars, words, *(np.asarray(batch[c + suffix]).view(U) for c in _BRIEF[2:])


def _thin(errors: int, graded: bool):
    """Pairs with the facts of both lines to those that may be near, as they come."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [np.concatenate(x) for x in zip(_brief(batch, "_a"), _brief(batch, "_b"), strict=True)]
            at = np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(_may(errors, graded, *facts, None, at, at + batch.num_rows) >= 0))

    return thin


def _earlier(errors: int, graded: bool, greedy: bool):
    """Members of cells to pairs: each line that asks, second, with the earlier ones that may be near.

    Rows come sorted by cell; ``asks`` tells those that ask and ``held`` those that are asked. A
    greedy search takes of each cell only the one by whose tallies a line is nearest, and tells
    by ``more`` that there are others.
    """

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        cell, ids, at, upto, doc, row, place = (np.asarray(table[c]) for c in ("cell", "id", "at", "upto", "doc", "row", "place"))
        unknown, asks, held_here = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("unknown", "asks", "held"))
        facts = *_brief(table), np.stack([np.asarray(table[c]).view(U) for c in _PLANES], axis=1)
        words = facts[1]
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((place, row, doc, unknown))] = np.arange(len(ids))
        at, upto = at.astype(np.int64), upto.astype(np.int64)
        group = np.unique(cell, return_inverse=True)[1]
        reach = np.maximum(words // (_WORDS_AN_EDIT - 1) + 1, errors)  # no partner allows more word edits
        wide = upto > at  # a sequence at several places of a line
        found = [np.empty((3, 0), np.int64)]
        for asked, held, near in ((asks & ~wide, held_here & ~wide, True), (asks & ~wide, held_here & wide, False), (asks & wide, held_here, False)):
            asked, held = np.flatnonzero(asked), np.flatnonzero(held)
            spot = group * (1 << 32) + (at + 1 if near else 0)  # in a cell by place, where lines have one
            held = held[np.argsort(spot[held], kind="stable")]
            apart = reach[asked] if near else 0
            begin, end = np.searchsorted(spot[held], spot[asked] - apart), np.searchsorted(spot[held], spot[asked] + apart, "right")
            n = end - begin
            ends = np.cumsum(n)
            for lo in range(0, int(n.sum()), _PAIRS):
                flat = np.arange(lo, min(int(n.sum()), lo + _PAIRS))
                owner = np.searchsorted(ends, flat, "right")
                a, b = asked[owner], held[begin[owner] + flat - (ends - n)[owner]]
                off = lambda p, q, r, s: np.maximum(np.maximum(p - s, r - q), 0)
                shift = off(at[a], upto[a], at[b], upto[b]) + off(words[a] - upto[a], words[a] - at[a], words[b] - upto[b], words[b] - at[b])
                ok = (group[a] == group[b]) & (rank[b] < rank[a]) & (ids[a] != ids[b]) & ((at[a] < 0) | (shift <= np.maximum(np.maximum(words[a], words[b]) // _WORDS_AN_EDIT, errors)))
                a, b = a[ok], b[ok]
                gap = _may(errors, graded, *facts, a, b)
                a, b, gap = a[gap >= 0], b[gap >= 0], gap[gap >= 0]
                more = np.zeros(len(a), np.int64)
                if greedy:
                    order = np.lexsort((rank[b], gap, a))
                    a, b = a[order], b[order]
                    best = np.flatnonzero(np.diff(a, prepend=-1))
                    more = (np.diff(best, append=len(a)) > 1).astype(np.int64)
                    a, b = a[best], b[best]
                found.append(np.stack([ids[b], ids[a], more]))
        found = np.hstack(found)
        order = np.lexsort((-found[2], found[1], found[0]))
        a, b, more = found[:, order]
        new = (np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0)
        new[:1] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (a, b, more)], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.asarray(batch["cell"])
            cut = int(np.searchsorted(cell, cell[-1])) if cell[0] != cell[-1] else 0
            if size > 200_000 and (cut or held and held[-1]["cell"][-1].as_py() != cell[0]):
                yield from pairs([*held, batch.slice(0, cut)] if cut else held)
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from pairs(held)

    return run


def within(longer: list[str], shorter: list[str], errors: int) -> np.ndarray:
    """Whether each pair is within ``errors`` edits; ``longer`` is the longer of each.

    The columns of the edit table are differences in one 64-bit word a pair, of the band of
    diagonals that ``errors`` edits can reach; a step takes all pairs one character further.
    """
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (longer, shorter))
    width = int(n.max(initial=0)) + 2 * errors + 1
    x = np.zeros((len(longer), width + errors), np.uint32)
    y = np.zeros((len(longer), int(m.max(initial=0))), np.uint32)
    for at, (p, q) in enumerate(zip(longer, shorter, strict=True)):
        x[at, errors : errors + len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        y[at, : len(q)] = np.frombuffer(q.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    top, one = U(63), U(1)
    up = np.full(len(n), (2**64 - 1) << (63 - errors) & (2**64 - 1), U)  # the band above the start
    down = np.zeros(len(n), U)
    distance = np.full(len(n), errors, np.int64)
    last_row = np.full(len(n), U(1) << U(62))
    for j in range(y.shape[1]):
        live = j < m
        equal = np.zeros(len(n), U)
        for k in range(2 * errors + 1):  # pattern place j - errors + k is bit 63 - 2 * errors + k
            equal |= (x[:, j + k] == y[:, j]).astype(U) << U(63 - 2 * errors + k)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | ~(diagonal | up), diagonal & up
        along = live & (j < n - errors)
        distance += along & ((diagonal >> top) & one == 0)
        beside = live & ~along
        distance += beside & ((rise & last_row) != 0)
        distance -= beside & ((fall & last_row) != 0)
        last_row = np.where(beside, last_row >> one, last_row)
        slid = diagonal >> one
        up, down = fall | ~(slid | rise), slid & rise
    return (distance <= errors) & (n - m <= errors)


def words_within(longer: list[int], shorter: list[int], errors: int) -> bool:
    """Whether two lists of word hashes are within ``errors`` edits: the band of the table.

    Place k of a row is column j - errors + k. Inserts along a row are a running minimum.
    """
    same = lambda p, q: next((i for i, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), len(q))
    start = same(longer, shorter)
    longer, shorter = longer[start:][::-1], shorter[start:][::-1]
    end = same(longer, shorter)
    longer, shorter = longer[end:], shorter[end:]
    n, m = len(longer), len(shorter)
    if n - m > errors or not m:
        return n <= errors
    far = errors + 1
    x = np.zeros(n + 2 * errors + 1, U)  # what lies outside is cut off by its column
    x[errors : errors + n] = np.array(longer, U)
    k = np.arange(2 * errors + 1)
    row = np.where(k >= errors, k - errors, far)
    row[k - errors > n] = far
    for j, word in enumerate(shorter, 1):
        column = j - errors + k
        across = row + (x[j - 1 : j + 2 * errors] != U(word))
        above = np.append(row[1:], far) + 1
        row = np.where(column == 0, j, np.minimum(across, above))
        row[(column < 0) | (column > n)] = far
        row = np.minimum.accumulate(row - k) + k
        row[(column < 0) | (column > n)] = far
        row = np.minimum(row, far)
        if row.min() >= far:
            return False
    return bool(row[n - m + errors] <= errors)


def _verify_words(both: list[tuple[str, str]], keep: np.ndarray) -> None:
    """Mark the pairs not yet kept that are within their word edits, a word being one sign."""
    signs: dict[bytes, str] = {}
    waiting: dict[int, list[tuple[int, str, str]]] = {}
    for i in np.flatnonzero(~keep):
        p, q = sorted((x.encode().split() for x in both[i]), key=len, reverse=True)
        e = len(p) // _WORDS_AN_EDIT
        if e and len(p) == len(q) and sum(map(ne, p, q)) <= e:  # words replaced only
            keep[i] = True
            continue
        if not e or len(p) - len(q) > e or (Counter(p) - Counter(q)).total() > e:
            continue
        if e > 30 or len(signs) > 1_000_000:  # beyond the band of one 64-bit word, or of signs
            code = {w: c for c, w in enumerate(dict.fromkeys(p + q))}
            keep[i] = words_within([code[w] for w in p], [code[w] for w in q], e)
            continue
        spare = max(0, len(q) - e - 1)  # what both begin or end with costs nothing; the check needs some words
        start = next((k for k in range(spare) if p[k] != q[k]), spare)
        end = next((k for k in range(spare - start) if p[-1 - k] != q[-1 - k]), spare - start)
        p, q = p[start : len(p) - end], q[start : len(q) - end]
        p, q = ("".join([signs.setdefault(w, chr(len(signs))) for w in x]) for x in (p, q))
        waiting.setdefault(e, []).append((i, p, q))
    for e, some in waiting.items():
        some.sort(key=lambda x: len(x[1]))
        for lo, hi in _slices(np.array([len(p) for _, p, _ in some])):
            keep[[i for i, _, _ in some[lo:hi]]] = within([p for _, p, _ in some[lo:hi]], [q for _, _, q in some[lo:hi]], e)


def _verify(errors: int, graded: bool):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            both = [(a, b) if len(a) >= len(b) else (b, a) for a, b in zip(batch["line_a"].to_pylist(), batch["line_b"].to_pylist(), strict=True)]
            n, m = (np.fromiter((len(p[i]) for p in both), np.int64, len(both)) for i in (0, 1))
            edits = allowed(n, errors, graded)
            for e in range(errors + 1):
                order = np.flatnonzero((edits == e) & (n - m <= e))
                order = order[np.argsort(n[order], kind="stable")]
                lo = 0
                while lo < len(order):  # pairs of like length together, a bounded table of them
                    hi = lo + 1
                    while hi < len(order) and (hi - lo + 1) * n[order[hi]] <= _PAIRS:
                        hi += 1
                    some = order[lo:hi]
                    lo = hi
                    keep[some] = within([both[i][0] for i in some], [both[i][1] for i in some], e)
            _verify_words(both, keep)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), "text")


def duplicate_lines(docs: DataFrame, *, errors: int = 2, least: int | None = None) -> DataFrame:
    """One row per distinct (doc_id, text): row, doc_id, n_lines, removed, near.

    ``removed`` lists the places (from 0) of lines to drop, ``near`` those of them that equal
    no earlier line. Lines are what newlines separate, compared without blanks at both ends;
    blank ones are never dropped. A line goes if an earlier one equals it, or is within the
    edits or the word edits that the longer of both allows: one edit a 20 characters, up to
    ``errors``; one edit of words (what ASCII white space separates) a 20 words, without a
    limit. Given ``least``, lines of fewer characters are never dropped and drop none, and all
    others may have ``errors`` edits. Earlier means the lesser doc_id (null
    last, ties by hash of the row), then the lesser place. Each line is judged on the input,
    so a line also goes if only a dropped one is near it. Null texts have one empty line.
    Rows equal in id and text are one. An empty table gives no rows. Near lines are verified
    on their texts; that lines are equal, and that rows are, holds on 64-bit hashes.
    """
    graded = least is None
    least = 1 if least is None else least
    assert 0 <= errors <= 20 and (graded or least > errors)
    base = _base(docs)
    lines = save(base.mapInArrow(lean(lambda b: _lines(b, least), _ROWS), _LINES_DDL).dropDuplicates(["row"]), "lines")
    shards = max(1, math.ceil((lines.agg(F.sum("keys")).first()[0] or 0) / _ENTRIES_A_SHARD))
    dealt = base.select("doc_id", "text").mapInArrow(lean(_deal(least, errors, graded, shards), _ROWS), _ENTRY_DDL)
    met = save(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(_meet), _MET_DDL), "blocks")
    star, members = met.filter(F.col("kind") == STAR).select("a", "b"), met.filter(F.col("kind") == MEMBER)

    each = lines.select("row", "doc_id", F.posexplode("lines").alias("at", "id")).filter(F.col("id").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "at")).alias("first")
    firsts = save(each.groupBy("id").agg(first, F.count("*").alias("n")), "first-places")
    asked = star.select(F.col("a").alias("id")).union(star.select("b")).union(members.select("b"))
    may = wanted_filter(asked, "id")
    place = (F.col("first.unknown").alias("unknown"), F.coalesce("first.doc_id", F.lit(0)).alias("doc"), F.col("first.row").alias("row"), F.col("first.at").alias("place"))
    placed = save(thinned(firsts.select("id", *place), may, "id"), "places")
    may_row = wanted_filter(placed, "row")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines that are asked for, of texts that may be the first to have one, and their facts."""
        for batch in batches:
            batch = batch.filter(pa.array(may_row(np.asarray(batch["row"]))))
            own = [(row, line) for row, t in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True) if t for line in dict.fromkeys(_split(t)) if len(line) >= least]
            ids = np.fromiter((line_id(line) for _, line in own), np.int64, len(own))
            keep = np.flatnonzero(may(ids))
            found = [own[i][1] for i in keep]
            facts = _measure(found, errors)
            columns = [pa.array(ids[keep]), pa.array([own[i][0] for i in keep], pa.int64()), pa.array(found, pa.string()), *(pa.array(facts[c].astype(np.int32)) for c in _FACTS[:2]), *(pa.array(facts[c].view(np.int64)) for c in _FACTS[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _FACTS_DDL.split(", ")])

    found = base.select("row", "text").mapInArrow(lean(read, _ROWS), _FACTS_DDL)
    known = save(found.join(placed, ["id", "row"]).dropDuplicates(["id"]), "facts")  # a line's text is taken where it comes first
    facts = known.drop("line")

    def later(pairs: DataFrame, name: str) -> DataFrame:
        """``id`` of the second line of each pair, the later one, that is near on the texts."""
        found = both_sides(pairs, known.select("id", "line"), "id", "line").mapInArrow(lean(_verify(errors, graded), _ROWS), "a long, b long")
        return save(found.select(F.col("b").alias("id")).distinct(), name)

    side = lambda c: facts.select(F.col("id").alias(c), F.struct("unknown", "doc", "row", "place").alias(f"first_{c}"), *(F.col(x).alias(f"{x}_{c}") for x in _BRIEF))
    met_first = star.distinct().join(side("a"), "a").join(side("b"), "b")
    swapped = F.col("first_a") > F.col("first_b")
    met_first = met_first.select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b"), *(f"{x}_{c}" for x in _BRIEF for c in "ab"))
    nearest = save(met_first.mapInArrow(_thin(errors, graded), "a long, b long"), "later-candidates")
    gone = later(nearest, "later")
    discard(nearest)

    def still(placed: DataFrame, greedy: bool, name: str) -> DataFrame:
        """Lines of blocks with the earlier ones that may be near, of blocks with lines that are open."""
        sized = placed.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.col("open").cast("long")).alias("u")).filter("u > 0")
        pieces = lambda c: F.ceil(F.col(c) / BLOCK_LINES).cast("long")
        sized = save(sized.select("key", pieces("u").alias("ask_pieces"), pieces("m").alias("pieces")), f"{name}-blocks")
        members = placed.join(sized, "key").withColumn("h", F.xxhash64("id"))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
        cell = lambda p, q: F.xxhash64("key", p, q).alias("cell")
        # of a block of one cell, a row both asks and is asked
        asking = members.filter("open and pieces > 1").select("*", spread("pieces")).select(cell(F.pmod("h", "ask_pieces"), F.col("other")), "id", "at", "upto", F.lit(True).alias("asks"), F.lit(False).alias("held"))
        holding = members.select("*", spread("ask_pieces")).select(cell(F.col("other"), F.pmod("h", "pieces")), "id", "at", "upto", F.expr("open and pieces = 1").alias("asks"), F.lit(True).alias("held"))
        cells = asking.union(holding).join(facts, "id").repartition("cell").sortWithinPartitions("cell")
        pairs = cells.mapInArrow(lean(_earlier(errors, graded, greedy)), "a long, b long, more long").groupBy("a", "b").agg(F.max("more").alias("more"))
        pairs = save(pairs, f"{name}-candidates")
        discard(sized)
        return pairs

    placed_in = members.select(F.col("a").alias("key"), F.col("b").alias("id"), "at", "upto")
    stays = placed_in.join(gone.withColumn("gone", F.lit(True)), "id", "left").withColumn("open", F.col("gone").isNull()).drop("gone")
    open_once = save(stays, "second-members")
    closest = still(open_once, True, "second")
    second = later(closest, "second")
    # a line without other partners in any block is settled
    rest = closest.filter("more > 0").select(F.col("b").alias("id")).distinct().join(second, "id", "left_anti").withColumn("rest", F.lit(True))
    open_twice = save(open_once.drop("open").join(rest, "id", "left").withColumn("open", F.col("rest").isNotNull()).drop("rest"), "third-members")
    others = still(open_twice, False, "third")
    third = later(others.join(closest, ["a", "b"], "left_anti"), "third")

    near = gone.union(second).union(third).distinct().withColumn("near", F.lit(True))
    told = firsts.select("id", "n", "first").join(near, "id", "left").filter((F.col("n") > 1) | F.col("near"))
    told = save(told.select("id", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"), F.coalesce("near", F.lit(False)).alias("near")), "told")
    here = (F.col("row") == F.col("first_row")) & (F.col("at") == F.col("first_at"))
    where = lines.select("row", F.posexplode("lines").alias("at", "id")).filter(F.col("id").isNotNull())
    drop = where.join(told, "id").filter(~here | F.col("near")).select("row", "at", here.alias("here"))
    drop = drop.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("removed"), F.sort_array(F.collect_list(F.when(F.col("here"), F.col("at")))).alias("near"))
    none = F.array().cast("array<int>")
    out = save(lines.join(drop, "row", "left").select("row", "doc_id", F.size("lines").alias("n_lines"), F.coalesce("removed", none).alias("removed"), F.coalesce("near", none).alias("near")), "verdicts")
    discard(lines, met, firsts, placed, known, gone, open_once, closest, second, open_twice, others, third, told)
    return out


def drop_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``; all rows and columns stay.

    A null text stays null. Rows equal in id and text come out alike. Other columns are kept
    whatever their names.
    """
    row, places = free_name(docs, "row"), free_name(docs, "removed")
    gone = duplicate_lines(docs, **settings).filter(F.size("removed") > 0).select(F.col("row").alias(row), F.col("removed").alias(places))

    def rest(t: str | None, at: list[int] | None) -> str | None:
        drop = set(at or ())
        return "\n".join([line for i, line in enumerate(t.split("\n")) if i not in drop]) if drop else t

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array(map(rest, batch["text"].to_pylist(), batch[places].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch[c] for c in batch.schema.names], names=batch.schema.names)

    marked = docs.withColumn(row, F.xxhash64(F.col("doc_id"), F.col("text"))).join(gone, row, "left")
    return marked.mapInArrow(lean(cut, _CUT_ROWS), marked.schema).select(docs.columns)
