"""How far the words of sources lie apart: joint count histograms of pairs of sources.

Tasks count the terms of the documents they read. A language's terms with enough documents
stay, each with its counts by source. For a pair of sources what matters of a term is its two
counts only, so tasks tally the combinations of counts over their terms, and Spark adds the
tallies up. Combinations with a zero are never listed term by term: how many terms have a
count in one source, less those that have one in both, follows from the sources' own
histograms. The distance is then worked out once for a combination, times its terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bites, lean, save

#: ASCII letters in lower case; all else of ASCII parts terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_TALLY_DDL = "lang string, source string, term string, n long, df long"
_CELLS_DDL = "lang string, source string, other string, a long, b long, m long"
#: Terms that a task counts before it hands them on; combinations that a task holds.
_HELD, _CELLS = 400_000, 1_000_000
#: Terms whose combinations are listed at a time.
_TERMS = 2048


def _told(counts: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, df) in counts.items():
        columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
        terms = pa.array(list(n), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "df"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, by language and source."""
    counts, held = defaultdict(lambda: (Counter(), Counter())), 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            n, df = counts[lang, source]
            held -= len(n)
            met = set()
            for bite in bites(text.as_py().translate(_LETTERS)):
                words = bite.split()
                n.update(words)
                met.update(words)
            df.update(met)
            held += len(n)
            if held >= _HELD:
                yield from _told(counts)
                counts.clear()
                held = 0
    yield from _told(counts)


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term and its counts by source: terms of ``least`` documents of the language and more.

    A term's rows are one a source and task, whatever its frequency; they meet once, by
    language and term, and are added up there.
    """
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    met = rows.mapInArrow(lean(_tally), _TALLY_DDL).repartition("lang", "term")
    by_source = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return terms.filter(F.col("df") >= least).select("lang", "term", "counts")


def _fold(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Pair codes, both counts and a number: equal combinations become one, their numbers added."""
    *keys, m = columns
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.add.reduceat(m[order], at) if len(at) else m[:0]]


def _merge(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    return _fold([np.concatenate(x) for x in zip(*held, strict=True)])


def _joint(term: np.ndarray, group: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Tallied combinations of every two entries of one term: groups, counts, terms."""
    order = np.lexsort((group, term))
    term, group, n = term[order], group[order], n[order]
    held, size = [[np.zeros(0, np.int64)] * 5], 0
    for apart in range(1, len(term)):
        both = np.flatnonzero(term[apart:] == term[:-apart])
        if not len(both):
            break
        held.append([group[both], group[both + apart], n[both], n[both + apart], np.ones(len(both), np.int64)])
        size += len(both)
        if size >= _CELLS:
            held = [_merge(held)]
            size = 0
    return _merge(held)


def _with_zeros(cells: list[np.ndarray]) -> list[np.ndarray]:
    """Cells of terms that both have, and with them the corrections of the cells with a zero.

    The sources' own histograms are added to the cells with a zero in full; what both have is
    no such cell and is taken off here, and once more too much from the cell of two zeros.
    """
    one, other, a, b, m = cells
    none = np.zeros(len(m), np.int64)
    return _merge([cells, [one, other, a, none, -m], [one, other, none, b, -m], [one, other, none, none, m]])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallied combinations of the task's terms, pair by pair of a language's sources."""
    codes: dict[tuple[str, str], int] = {}
    held, size = [], 0

    def told() -> pa.RecordBatch:
        one, other, a, b, m = _with_zeros(_merge(held))
        names = list(codes)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        turned = rank[one] > rank[other]
        one, other, a, b = (np.where(turned, y, x) for x, y in ((one, other), (other, one), (a, b), (b, a)))
        langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([langs.take(pa.array(one)), sources.take(pa.array(one)), sources.take(pa.array(other)), *map(pa.array, (a, b, m))], names=["lang", "source", "other", "a", "b", "m"])

    for batch in batches:
        counts = batch["counts"]
        lengths = np.diff(counts.offsets.to_numpy())
        entries = counts.flatten()
        term = np.repeat(np.arange(len(lengths)), lengths)
        langs = np.repeat(np.array(batch["lang"].to_pylist(), object), lengths)
        group = np.fromiter((codes.setdefault(k, len(codes)) for k in zip(langs, entries.field("source").to_pylist(), strict=True)), np.int64, len(term))
        held.append(_joint(term, group, entries.field("n").to_numpy(zero_copy_only=False).astype(np.int64)))
        size += len(held[-1][0])
        if size >= _CELLS:
            held = [_merge(held)]
            size = 0
            if len(held[0][0]) >= _CELLS:
                yield told()
                held, codes = [], {}
    if held:
        yield told()


def _share(count: Column, n: Column, kept: Column, add: int, scale: int) -> Column:
    """1 + floor(scale * (count + add) / (n + add * kept)), exactly; only asked where terms are kept."""
    top = F.lit(scale).cast("decimal(18,0)") * (count + F.lit(add)).cast("decimal(20,0)")
    return F.call_function("div", top, F.greatest(n + F.lit(add) * kept, F.lit(1)).cast("decimal(20,0)")) + F.lit(1)


def source_divergence(docs: DataFrame, *, least: int = 30, add: int = 5, scale: int = 10**9, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the sources of a language apart.

    ``docs`` needs text, lang and source; null is ''. A term is a run of letters and bytes
    beyond ASCII, A-Z in lower case. A language keeps the terms of ``least`` of its rows and
    more. A kept term's share in a group is ``1 + floor(scale * (count + add) / (all + add *
    kept terms))``. Part ``pair`` has the summed distance of the shares to every other source
    of the language, ranked; part ``term`` the ``top`` terms whose share is most above the
    language's. Sources without a kept term have all counts 0; a language without one has
    pairs of distance 0 and no terms. Repeated rows count again; an empty table gives no rows.

    A language's pairs of sources are all in the result, so its sources have to be few enough
    for that; everything else is spread over terms, combinations and tasks.
    """
    named = docs.select("text", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).withColumn("text", F.coalesce("text", F.lit("")))
    terms = save(kept_terms(named, least), "kept-terms")
    own = terms.select("lang", "term", F.inline("counts"))
    sized = own.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, c: x + c["n"])).alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = named.select("lang", "source").distinct().join(sized, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = save(groups.select("lang", "source", *map(zero, ("n", "terms", "kept", "all"))), "groups")

    joint = terms.select("lang", "counts").mapInArrow(lean(_cells, _TERMS), _CELLS_DDL)
    partner = groups.select("lang", F.col("source").alias("other"), F.col("terms").alias("other_terms"))
    first = F.col("source") < F.col("other")
    ordered = [F.least("source", "other").alias("one"), F.greatest("source", "other").alias("two")]
    none = F.lit(0).cast("long")
    own_cells = own.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("m")).join(partner, "lang").filter("source != other")
    own_cells = own_cells.select("lang", *ordered, F.when(first, F.col("count")).otherwise(none).alias("a"), F.when(first, none).otherwise(F.col("count")).alias("b"), "m")
    empty_cells = groups.join(partner, "lang").filter(first).select("lang", F.col("source").alias("one"), F.col("other").alias("two"), none.alias("a"), none.alias("b"), (F.col("kept") - F.col("terms") - F.col("other_terms")).alias("m"))
    cells = joint.toDF("lang", "one", "two", "a", "b", "m").union(own_cells).union(empty_cells)
    tallied = cells.groupBy("lang", "one", "two", "a", "b").agg(F.sum("m").alias("m"))
    sides = [groups.select("lang", F.col("source").alias(side), F.col("n").alias(f"n_{side}"), *(["kept"] if side == "one" else [])) for side in ("one", "two")]
    shares = [_share(F.col(c), F.col(f"n_{side}"), F.col("kept"), add, scale) for c, side in (("a", "one"), ("b", "two"))]
    apart = tallied.join(sides[0], ["lang", "one"]).join(sides[1], ["lang", "two"]).groupBy("lang", "one", "two").agg(F.sum(F.col("m") * F.abs(shares[0] - shares[1])).alias("value"))
    both = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("one", "two"), ("two", "one")))))
    pairs = apart.select("lang", "value", both.alias("p")).select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")

    total = F.aggregate("counts", F.lit(0).cast("long"), lambda x, c: x + c["n"])
    met = terms.select("lang", F.col("term").alias("item"), total.alias("total"), F.inline("counts")).withColumnRenamed("n", "count").join(groups, ["lang", "source"])
    above = met.withColumn("value", _share(F.col("count"), F.col("n"), F.col("kept"), add, scale) - _share(F.col("total"), F.col("all"), F.col("kept"), add, scale)).filter("value > 0")
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by))
    leading = ranked(above.select("lang", "source", F.lit("term").alias("part"), "item", "value")).filter(F.col("rank") <= top)
    return ranked(pairs).union(leading)
