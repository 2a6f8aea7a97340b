"""Language identification with a byte convolutional network.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows; each
filter's largest response in the window feeds a softmax. The network is trained in
numpy on a bounded sample of labelled windows (``ConvConfig.sample_docs`` documents,
``windows_per_doc`` windows each, dealt evenly over the whole text). Inference walks
every whole text in windows that overlap by the widest filter less one byte, so no
byte pattern is lost, and averages the windows' probabilities by their bytes.

A null text, or one without a letter, is ``und`` with score 0. Without any labelled
row every text is ``und``. Repeated rows get equal answers. The input's columns are
carried in the struct ``row``, so columns named like the results don't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batched, fold, sampled, table

UNKNOWN = "und"


@dataclass(frozen=True)
class ConvConfig:
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    window: int = 256
    sample_docs: int = 3000
    windows_per_doc: int = 3
    epochs: int = 6
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


class ByteConvNet:
    """tables[w][o, byte, k]: weight of filter k of width w for a byte at offset o."""

    def __init__(self, classes: list[str], config: ConvConfig):
        rng = np.random.default_rng(config.seed)
        self.classes, self.config = classes, config
        k = config.filters
        self.tables = [rng.normal(0, 0.5, (w, 256, k)).astype(np.float32) for w in config.widths]
        self.bias = np.zeros(k * len(config.widths), np.float32)
        self.out = rng.normal(0, 0.1, (k * len(config.widths), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, where = [], []
        for t in self.tables:
            w = len(t)
            y = t[0][x[:, : x.shape[1] - w + 1]]
            for o in range(1, w):
                y += t[o][x[:, o : x.shape[1] - w + 1 + o]]
            at = y.argmax(1)
            where.append(at)
            tops.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        return np.concatenate(tops, 1), where

    def train(self, x: np.ndarray, y: np.ndarray) -> "ByteConvNet":
        """Adam on the softmax's cross entropy; x: windows of bytes, y: class numbers."""
        c = self.config
        rng = np.random.default_rng(c.seed + 1)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, k = 0, c.filters
        for epoch in range(c.epochs):
            order = rng.permutation(len(x))
            rate = c.rate * (1 - epoch / c.epochs)
            for lo in range(0, len(x), c.batch):
                ids = order[lo : lo + c.batch]
                xb, yb, rows = x[ids], y[ids], np.arange(len(ids))
                top, where = self._pooled(xb)
                feat = np.tanh(top + self.bias)
                z = feat @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[rows, yb] -= 1
                p /= len(ids)
                back = (p @ self.out.T) * (1 - feat**2)
                grads = []
                for i, t in enumerate(self.tables):
                    g = np.zeros_like(t)
                    part = back[:, i * k : (i + 1) * k]
                    for o in range(len(t)):
                        np.add.at(g[o], (np.take_along_axis(xb, where[i] + o, 1), np.arange(k)[None]), part)
                    grads.append(g)
                grads += [back.sum(0), feat.T @ p, p.sum(0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
        return self

    def compiled(self) -> "ByteConvNet":
        """Tables of byte pairs, so that a width of 4 takes two look-ups."""
        if not hasattr(self, "pairs"):
            self.pairs = [[(t[o][:, None] + t[o + 1][None]).reshape(65536, -1) if o + 1 < len(t) else t[o] for o in range(0, len(t), 2)] for t in self.tables]
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows over all texts, the text of each, and its own bytes."""
        size, lap = self.config.window, max(self.config.widths) - 1
        step = size - lap
        counts = np.array([max(1, -(-max(len(t) - lap, 1) // step)) for t in texts])
        flat = np.frombuffer(b"".join(t.ljust(n * step + lap, b"\0") for t, n in zip(texts, counts.tolist(), strict=True)), np.uint8)
        base = np.concatenate([[0], np.cumsum(counts * step + lap)[:-1]])
        owner = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = base[owner] + within * step
        weight = np.clip(np.array([len(t) for t in texts])[owner] - within * step, 1, step)
        return np.lib.stride_tricks.sliding_window_view(flat, size)[starts], owner, weight

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        self.compiled()
        x, owner, weight = self.windows(texts)
        size, out = x.shape[1], np.zeros((len(texts), len(self.classes)))
        for lo in range(0, len(x), 256):
            part = x[lo : lo + 256]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            tops = []
            for t, look in zip(self.tables, self.pairs, strict=True):
                w = len(t)
                n = size - w + 1
                y = None
                for o, q in zip(range(0, w, 2), look, strict=True):
                    got = np.take(q, pair[:, o : o + n] if o + 1 < w else part[:, o : o + n], axis=0)
                    y = got if y is None else np.add(y, got, out=y)
                tops.append(y.max(1))
            z = np.tanh(np.concatenate(tops, 1) + self.bias) @ self.out + self.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            np.add.at(out, owner[lo : lo + 256], p / p.sum(1, keepdims=True) * weight[lo : lo + 256, None])
        return out / np.maximum(out.sum(1, keepdims=True), 1e-30)


def train_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", order_by: str = "doc_id", config: ConvConfig = ConvConfig()) -> ByteConvNet | None:
    """Fit on about ``sample_docs`` rows, chosen by the hash of ``order_by``."""
    n, size = config.windows_per_doc, config.window
    at = [f"substring({text}, int(1 + greatest(length({text}) - {size}, 0) * {i / max(n - 1, 1)}), {size})" for i in range(n)]
    known = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    picked = sampled(known, order_by, config.sample_docs).filter(F.col(text).rlike(r"\p{L}"))
    rows = picked.select(F.xxhash64(order_by, text).alias("_h"), F.col(lang).alias("_y"), *[F.expr(e).alias(f"_{i}") for i, e in enumerate(at)]).collect()
    sample = sorted(rows, key=lambda r: (r["_h"], r["_y"]))
    classes = sorted({r["_y"] for r in sample})
    if not classes:
        return None
    rng = np.random.default_rng(config.seed)
    xs, ys = [], []
    for r in sample:
        for piece in dict.fromkeys(r[f"_{i}"] for i in range(n)):
            raw = (piece or "").encode()[:size]
            cut = raw if rng.random() < 0.6 else raw[: rng.integers(8, size)]
            xs.append(cut.ljust(size, b"\0"))
            ys.append(classes.index(r["_y"]))
    x = np.frombuffer(b"".join(xs), np.uint8).reshape(-1, size)
    return ByteConvNet(classes, config).train(x, np.array(ys))


def identify_language(docs: DataFrame, model: ByteConvNet | None, text: str = "text") -> DataFrame:
    """``row`` (the input's columns), ``lang_pred`` and ``score`` of each input row; no shuffle."""
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        known = [i for i, t in enumerate(texts) if model is not None and any(map(str.isalpha, t))]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            p = model.probabilities([texts[i].encode() for i in known])
            for i, best, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                lang[i], score[i] = model.classes[best], min(1.0, s)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    return packed.mapInArrow(batched(work, "_text"), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``; learned from the folds that aren't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs.filter(fold("doc_id", 5) != 0))
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(fold("row.doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
