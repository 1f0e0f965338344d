"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are put into one automaton, whose states are the classes of word sequences
that end at the same places of items. Training text is streamed through it word by word; the
state and the length of the longest match say at each word which passages of items end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bites, free_name, lean, save

#: ASCII letters in lower case and digits; all else of ASCII parts words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
#: Rows that a scanning task holds at a time.
_ROWS = 512


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


class Automaton:
    """A generalised suffix automaton of items ``(name, words)``, marked for windows of ``window`` words.

    ``watch`` marks the states at which a window or a whole shorter item may end.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [0], [0]
        for _, item in items:
            at = 0
            for word in item:
                at = self._extend(at, word)
        by_size = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.at_window = [0] * len(self.size)  # the state of a match's last window, or 0
        for s in by_size:
            if self.size[s] >= window:
                self.at_window[s] = s if self.size[self.link[s]] < window else self.at_window[self.link[s]]
        self.items: dict[int, set[int]] = {}  # by state of a window
        self.short: dict[int, list[tuple[int, int]]] = {}  # (words, item) of whole shorter items, by state
        for k, (_, item) in enumerate(items):
            s = 0
            for place, word in enumerate(item):
                s = self.next[s][word]
                if place + 1 >= window:
                    self.items.setdefault(self.at_window[s], set()).add(k)
            if 0 < len(item) < window:
                self.short.setdefault(s, []).append((len(item), k))
        self.at_short = [0] * len(self.size)  # the nearest state with a shorter item: itself or by links
        for s in by_size:
            self.at_short[s] = s if s in self.short else self.at_short[self.link[s]]
        self.watch = bytearray(bool(w or t) for w, t in zip(self.at_window, self.at_short, strict=True))

    def _state(self, size: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The part of ``q`` that is reached from ``p``, as a state of its own if it is not all of it."""
        if self.size[q] == self.size[p] + 1:
            return q
        part = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while self.next[p].get(word) == q:
            self.next[p][word] = part
            if p == 0:
                break
            p = self.link[p]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while word not in self.next[p]:
            self.next[p][word] = new
            if p == 0:
                return new
            p = self.link[p]
        self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def read(self, text: list[bytes], state: int, length: int) -> tuple[list[tuple[int, int, int]], int, int]:
        """Stream words; the (place, state, match length) of watched states, and where it ends up."""
        following, link, size, watch = self.next, self.link, self.size, self.watch
        found = []
        for place, word in enumerate(text):
            to = following[state].get(word)
            if to is None:
                while state:
                    state = link[state]
                    to = following[state].get(word)
                    if to is not None:
                        break
                if to is None:
                    length = 0
                    continue
                length = size[state]
            length += 1
            state = to
            if watch[state]:
                found.append((place, state, length))
        return found, state, length

    def passages(self, state: int, length: int) -> tuple[int, set[int]]:
        """How many words back the passages that end in a match reach, and the items they are of."""
        back, items = 0, set()
        if length >= self.window:
            back, items = length, set(self.items.get(self.at_window[state], ()))
        t = self.at_short[state]
        while t:
            for n, k in self.short[t]:
                if n <= length:
                    back = max(back, n)
                    items.add(k)
            t = self.at_short[self.link[t]]
        return back, items

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words, maximal runs ``(start, length)`` of words in passages, names of items with one."""
        state = length = first = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for bite in bites(text.translate(_LETTERS)):
            some = bite.split()
            found, state, length = self.read(some, state, length)
            for place, s, matched in found:
                back, met = self.passages(s, matched)
                if not back:
                    continue
                items |= met
                end = first + place + 1
                start = end - back
                while spans and sum(spans[-1]) >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end - start))
            first += len(some)
        return first, spans, {self.names[k] for k in items}


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words that are in any of the spans."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(spans):
        if out and sum(out[-1]) >= start:
            out[-1] = (out[-1][0], max(sum(out[-1]), start + n) - out[-1][0])
        else:
            out.append((start, n))
    return out


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of the spans and what stands between them."""
    if not spans:
        return text
    whole = text.encode()
    places = [m.span() for m in _WORD.finditer(whole.translate(_LETTERS))]
    edges = [0, *(x for start, n in spans for x in (places[start][0], places[start + n - 1][1])), len(whole)]
    return b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of some ``block_words`` words; longer ones in pieces that share all but a window's first word."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    held, size = [], 0
    for row in named.toLocalIterator():
        item = words(row.text)
        for at in range(0, len(item) if len(item) > block_words else min(1, len(item)), block_words):
            piece = item[at : at + block_words + window - 1]
            if at and len(piece) < window:
                break
            held.append((row.item_id, piece))
            size += len(piece)
            if size >= block_words:
                yield held
                held, size = [], 0
    if held:
        yield held


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_words, spans and items under free names, which are returned as well."""
    spark = docs.sparkSession
    names = []
    for name, kind in (("n_words", "long"), ("spans", "array<struct<start: long, length: long>>"), ("items", "array<string>")):
        names.append(free_name(docs, name))
        docs = docs.withColumn(names[-1], F.lit(None).cast(kind))
    schema = docs.schema

    def scan(told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = told.value
            for batch in batches:
                out = [automaton.scan((t or "").encode()) for t in batch["text"].to_pylist()]
                before = zip(batch[names[1]].to_pylist(), batch[names[2]].to_pylist(), strict=True)
                merged = [(n, union([*((x["start"], x["length"]) for x in old or ()), *spans]), sorted({*(seen or ()), *items})) for (n, spans, items), (old, seen) in zip(out, before, strict=True)]
                new = {
                    names[0]: pa.array([n for n, _, _ in merged], pa.int64()),
                    names[1]: pa.array([[{"start": a, "length": b} for a, b in s] for _, s, _ in merged], pa.list_(_SPAN)),
                    names[2]: pa.array([i for _, _, i in merged], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], names=batch.schema.names)

        return run

    waiting = False
    blocks = _blocks(benchmark, window, block_words)
    block = next(blocks, [])
    while True:
        docs = save(docs, "scanned") if waiting else docs
        docs = docs.mapInArrow(lean(scan(spark.sparkContext.broadcast(Automaton(block, window))), _ROWS), schema)
        waiting = True
        block = next(blocks, None)
        if block is None:
            return docs, names


def find_passages(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, spans, items: the passages of benchmark items in each row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none,
    is one window. ``spans`` are the maximal runs ``(start, length)`` of a document's words in
    occurrences of windows, whatever the items; ``items`` are the sorted ids, as text, of the
    items with a window that occurs. Rows of the same item_id are one item, and a null id is
    ''. Null texts have no words; repeated rows are found alike; an empty benchmark finds
    nothing; an empty table gives no rows. Texts are read whole, a bite after the other.

    The benchmark is a stated set: it goes to the tasks in automata of ``block_words`` words
    each, however many these are, one scan of the documents for each.
    """
    rows, (n_words, spans, items) = _scanned(docs.select("doc_id", "text"), benchmark, window, block_words)
    return rows.select("doc_id", *(F.col(c) for c in (n_words, spans, items)))


def remove_passages(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_share: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """``docs``, all its columns, without passages of the benchmark.

    The spans of :func:`find_passages` are cut out of ``text``. A document of which they cover
    more than ``max_share`` of the words goes as a whole. Rows without a passage stay as they
    are, null texts included; extra columns are kept whatever their names.
    """
    rows, (n_words, spans, items) = _scanned(docs, benchmark, window, block_words)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["length"])
    stays = rows.filter(hit <= F.lit(max_share) * F.col(n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [cut(t, [(x["start"], x["length"]) for x in s]) for t, s in zip(batch["text"].to_pylist(), batch[spans].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else batch[c] for c in batch.schema.names], names=batch.schema.names)

    return stays.mapInArrow(lean(run, _ROWS), stays.schema).drop(n_words, spans, items)
