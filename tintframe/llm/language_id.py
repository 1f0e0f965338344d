"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded; filters of several widths run over windows of fixed length; each
filter's largest response, rectified, feeds a softmax. A text's languages are scored by the
mean log-probability of its windows, weighted by their bytes, so that whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold

UNDETERMINED = "und"
#: Windows that one matrix product takes: bounds a task's memory.
_TOGETHER = 128


class ByteConvNet:
    """Weights, forward pass and training. Widths share one padded filter matrix."""

    def __init__(self, classes: int, *, window: int = 192, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, embedding: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.window, self.reach, self.dim = window, max(widths), embedding
        self.embed = rng.normal(0, 0.5, (257, embedding)).astype(np.float32)
        self.embed[256] = 0  # padding
        self.mask = np.vstack([np.repeat([[at < w for w in widths for _ in range(filters)]], embedding, 0) for at in range(self.reach)]).astype(np.float32)
        n = self.mask.shape[1]
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def _patches(self, codes: np.ndarray) -> np.ndarray:
        padded = np.pad(codes, ((0, 0), (0, self.reach - 1)), constant_values=256)
        seen = self.embed[padded].reshape(len(codes), -1)
        views = np.lib.stride_tricks.sliding_window_view(seen, self.reach * self.dim, axis=1)[:, :: self.dim]
        return np.ascontiguousarray(views).reshape(-1, self.reach * self.dim)

    def _pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        patches = self._patches(codes)
        response = (patches @ self.conv).reshape(len(codes), self.window, -1)
        return patches, response, response.max(axis=1) + self.bias

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(codes), _TOGETHER):
            pooled = self._pooled(codes[at : at + _TOGETHER])[2]
            logits = np.maximum(pooled, 0) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.vstack(parts)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; only each filter's best place counts."""
        patches, response, pooled = self._pooled(x)
        hidden = np.maximum(pooled, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        inner = (p @ self.out.T) * (pooled > 0)
        best = response.argmax(axis=1)
        rows = (np.arange(len(x))[:, None] * self.window + best).reshape(-1)
        chosen = patches[rows].reshape(len(x), best.shape[1], -1)
        g_conv = np.einsum("bf,bfk->kf", inner, chosen) * self.mask
        padded = np.pad(x, ((0, 0), (0, self.reach - 1)), constant_values=256)
        g_patch = (inner[:, :, None] * self.conv.T[None]).reshape(len(x), best.shape[1], self.reach, self.dim)
        g_embed = np.zeros_like(self.embed)
        for j in range(self.reach):
            np.add.at(g_embed, np.take_along_axis(padded, best + j, 1), g_patch[:, :, j])
        g_embed[256] = 0
        return {"embed": g_embed, "conv": g_conv, "bias": inner.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0)}

    def train(self, codes: np.ndarray, labels: np.ndarray, *, epochs: int = 4, batch: int = 64, rate: float = 0.003, seed: int = 7) -> None:
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "out_bias")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for lo in range(0, len(order), batch):
                some, step = order[lo : lo + batch], step + 1
                for k, g in self.gradients(codes[some], labels[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    getattr(self, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter: digits, numerals and marks are not."""
    return any(map(str.isalpha, text))


def windows(text: bytes, length: int) -> np.ndarray:
    """All bytes of a text in rows of ``length``, the last one padded."""
    n = max(1, -(-len(text) // length))
    codes = np.full(n * length, 256, np.int16)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return codes.reshape(n, length)


def _spread(windows_a_text: int, length: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                whole = windows(text, length)
                picked = np.unique(np.linspace(0, len(whole) - 1, windows_a_text).astype(int))
                rows += [(lang, whole[at].tobytes()) for at in picked]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.binary()))], names=["lang", "codes"])

    return spread


def fit(docs: DataFrame, *, sample_docs: int = 4000, windows_a_text: int = 4, window: int = 192, epochs: int = 4, seed: int = 3) -> tuple[list[str], ByteConvNet] | None:
    """Train on a bounded sample of the rows with text and lang; None if there are none.

    ``sample_docs`` distinct texts at most are drawn, as many of each language, those of the
    least hashes; ``windows_a_text`` windows of each, spread over the whole text, come to the
    driver. Of more languages than ``sample_docs`` those with the most rows are learned.
    Copies of a text are one, however many there are.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("draw"))
    langs = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_docs)
    learned = [r.lang for r in langs.collect()]
    if not learned:
        return None
    each = sample_docs // len(learned)
    # the hash of each language's last drawn text, from the hashes alone; then those texts
    ranked = known.select("lang", "draw").distinct().withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("draw")))
    cuts = [(r.lang, r.cut) for r in ranked.filter(F.col("at") <= each).groupBy("lang").agg(F.max("draw").alias("cut")).collect() if r.lang in set(learned)]
    cut = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    picked = known.join(cut, "lang").filter(F.col("draw") <= F.col("cut")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    rows = picked.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_spread(windows_a_text, window), "lang string, codes binary").collect()
    rows.sort()
    langs = sorted({r.lang for r in rows})
    net = ByteConvNet(len(langs), window=window, seed=seed)
    codes = np.vstack([np.frombuffer(r.codes, np.int16) for r in rows])
    net.train(codes, np.array([langs.index(r.lang) for r in rows]), epochs=epochs)
    return langs, net


def predict(docs: DataFrame, model: tuple[list[str], ByteConvNet] | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text alone.

    ``docs`` has doc_id, held_out and text. A null text, one without a letter, and every text
    where nothing was learned are ``und`` with score 0. Repeated rows get the same; an
    empty table gives no rows. Long texts pass through the network a few windows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            preds, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            held: list[tuple[int, bytes]] = []

            def flush(held=held, preds=preds, scores=scores):
                langs, net = model
                codes = [windows(t, net.window) for _, t in held]
                said = net.log_probabilities(np.vstack(codes))
                weight = (np.vstack(codes) != 256).sum(axis=1)
                starts = np.cumsum([0, *map(len, codes)])[:-1]
                mean = np.add.reduceat(said * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for (at, _), k, q in zip(held, p.argmax(axis=1), p.max(axis=1), strict=True):
                    preds[at], scores[at] = langs[k], float(q)
                held.clear()

            size = 0
            for at, text in enumerate(texts):
                if model and text and has_letter(text):
                    held.append((at, text.encode()))
                    size += len(text)
                    if size > 1 << 18:
                        flush()
                        size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **settings) -> DataFrame:
    """Learn from the rows outside fold 0 and predict every row: doc_id, held_out, lang_pred, score.

    ``docs`` has doc_id, text and lang; other columns are not read, so their names can't
    clash. Null ids are in fold 0. Rows whose lang or text is null, or whose text has no
    letter, are not learned from; the latter two are predicted as ``und`` with score 0.
    Repeated rows get the same. Of languages with equal probability the first by name is
    predicted. An empty table gives no rows.
    """
    split = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return predict(split, fit(split.filter(~F.col("held_out")), **settings))
