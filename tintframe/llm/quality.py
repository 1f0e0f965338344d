"""Quality scores: random Fourier features of document statistics, ridge, isotonic steps.

Each text becomes a few statistics; cosines of random projections of them approximate a
Gaussian kernel. Tasks add up their part of the normal equations, so that the driver solves
one system of fixed size. Labelled rows of another fold then calibrate the ridge score: it
is binned, and pooled adjacent violators make the share of good rows non-decreasing.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, lean, save

#: Texts that a pipeline's task scores at a time.
_ROWS = 512

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:", "!?", "|", "'\"-()", "#$%&*+/<=>@[\\]^_`{}~")
STATISTICS = (*(f"share of {c!r}" for c in _CLASSES), "share of other bytes", "log bytes", "log words", "bytes a word", "spread of word lengths", "log distinct / log words", "repeated neighbours", "words without letters", "log lines", "repeated lines", "commonest byte")
_CLASS_OF = np.full(256, len(_CLASSES))
for _at, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars.encode())] = _at
_SYMBOLS = bytes(b for b in range(128) if not chr(b).isalpha())


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, all finite; of an empty one, zeros."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    seen = np.bincount(raw, minlength=256)
    shares = np.bincount(_CLASS_OF, seen, len(_CLASSES) + 1) / len(raw)
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    distinct = set(words)
    bare = sum(not w.strip(_SYMBOLS) for w in distinct)
    return [
        *shares.tolist(), np.log1p(len(raw)), np.log1p(n), min(float(lengths.mean()), 100.0), min(float(lengths.std()), 100.0), np.log1p(len(distinct)) / np.log1p(n) if n else 0.0,
        sum(map(operator.eq, words, words[1:])) / max(1, n - 1), bare / max(1, len(distinct)), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), seen.max() / len(raw),
    ]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t or b"") for t in batch["text"].to_pylist()], np.float64).reshape(-1)
        at = pa.array(np.arange(batch.num_rows + 1) * len(STATISTICS), pa.int32())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["fold"], pa.ListArray.from_arrays(at, pa.array(x))], names=["row", "doc_id", "fold", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """row, doc_id, fold and the statistics ``x`` of every row; ``row`` numbers the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), fold(F.col("doc_id")).cast("int").alias("fold"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_describe, "row long, doc_id long, fold int, x array<double>")


class Scorer:
    """Statistics to a calibrated score. ``steps`` are the calibration's knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.steps = np.zeros(features + 1), (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, len(STATISTICS)))


def _normal_equations(scorer: Scorer):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(scorer.weights)
        total = np.zeros((n, n + 1))
        for batch in batches:
            z = scorer.features(_matrix(batch["x"]))
            total += z.T @ np.hstack([z, np.asarray(batch["label"])[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([0] * n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["line", "part", "sums"])

    return add


def _add_lines(table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(s.values) for s in table["sums"]], axis=0)
    return pa.table({"line": table["line"].slice(0, 1), "part": table["part"].slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})


def pool_violators(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.array([v for v, _, n in blocks for _ in range(n)])


def fit(described: DataFrame, labels: DataFrame, *, features: int = 256, ridge: float = 1.0, bins: int = 400, held_out_fold: int = 0, calibration_fold: int = 4, part_rows: int = 100_000, seed: int = 29) -> Scorer:
    """Learn from all labelled rows outside ``held_out_fold``; the last fold calibrates.

    ``labels`` has doc_id and quality (0 or 1; other rows are not used). Without labelled
    rows the score is 0.5 everywhere.
    """
    d = len(STATISTICS)
    row = described.agg(*(F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(d)), *(F.stddev_pop(F.col("x")[j]).alias(f"s{j}") for j in range(d))).first()
    mean = np.array([row[f"m{j}"] or 0.0 for j in range(d)])
    spread = np.array([row[f"s{j}"] or 0.0 for j in range(d)])
    scorer = Scorer(mean, np.where(spread > 1e-9, spread, 1.0), features, seed)
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    train = save(described.filter(F.col("fold") != held_out_fold).join(known, "doc_id").select("fold", "x", "label"), "labelled")
    n = train.count()
    if not n:
        return scorer
    fitting = train.filter(F.col("fold") != calibration_fold).repartition(max(1, -(-n // part_rows)))
    sums = fitting.mapInArrow(_normal_equations(scorer), "line long, part long, sums array<double>")
    sums = sums.withColumn("part", F.spark_partition_id().cast("long") % 64)
    for keys in (["line", "part"], ["line"]):
        sums = sums.groupBy(*keys).applyInArrow(_add_lines, "line long, part long, sums array<double>")
    lines = sorted(sums.select("line", "sums").collect())  # features + 1 rows, whatever the input
    system = np.array([r.sums for r in lines])
    scorer.weights = np.linalg.solve(system[:, :-1] + ridge * np.eye(features + 1), system[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.floor((scorer.raw(_matrix(batch["x"])) + 0.5) / 2 * bins), 0, bins - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch["label"]], names=["bin", "label"])

    held = train.filter(F.col("fold") == calibration_fold)
    counts = lambda df: sorted(df.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).collect())
    found = counts(held) or counts(train)
    at, good, total = (np.array(c, np.float64) for c in zip(*found, strict=True))
    scorer.steps = ((at + 0.5) / bins * 2 - 0.5, pool_violators(good / total, total))
    discard(train)
    return scorer


def score(described: DataFrame, scorer: Scorer) -> DataFrame:
    """row, doc_id, fold and the score of each described row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["fold"], pa.array(scorer.score(_matrix(batch["x"])), pa.float64())], names=["row", "doc_id", "fold", "score"])

    return described.mapInArrow(run, "row long, doc_id long, fold int, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """row, doc_id, fold and score (0 to 1) of every row of ``docs``.

    Only doc_id and text are read, doc_id for the fold and the labels alone. Null texts count
    as empty; repeated rows score alike; an empty table gives no rows.
    """
    described = save(describe(docs), "statistics")
    return score(described, fit(described, labels, **settings))


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.3, **settings) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns.

    Statistics and scores are computed in one pass over the texts once the scorer is fitted;
    nothing is joined back, so repeated rows and null ids need no key. Null and empty texts
    are scored as empty; texts are read whole. Other columns are kept whatever their names.
    """
    described = save(describe(docs), "statistics")
    scorer = fit(described, labels, **settings)
    discard(described)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or b"") for t in batch["text"].cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(scorer.score(x) >= least))

    return docs.mapInArrow(lean(good, _ROWS), docs.schema)


def predicted(score_column: Column, least: float = 0.3) -> Column:
    return (score_column >= least).cast("int")
