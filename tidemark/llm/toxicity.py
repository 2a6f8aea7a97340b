"""Toxic passages as maximum-scoring segments of token log-odds.

1. A token is a run of letters, digits or marks, lower-cased; its features are itself and
   its beginnings of four to seven letters, so inflected forms share their stem.
2. Log-odds of a feature between toxic and clean labelled documents, with an informative
   Dirichlet prior in proportion to the feature's frequency over both, and their standard
   errors. Features with a z-score and log-odds high enough form the lexicon. It is fitted
   on about ``sample_docs`` labelled rows; features are counted on the executors and only
   the significant ones, which that sample bounds, come to the driver.
3. A token scores its best feature's log-odds; any other token scores ``-drift``. A
   linear scan finds all maximal-scoring segments of a whole text.
4. Scores of segments in clean text follow an extreme-value law. Its scale comes from
   the clean rows' token score frequencies (the positive root of the moment equation);
   a segment is significant if fewer than ``chance`` as good are expected in a clean
   text of that length. A document's evidence is that of its best segment, in nats
   over chance, so long clean texts don't gather weak ones.
5. A logistic curve fitted on the same sample turns evidence into a probability.

A null or empty text has no segment and gets the curve's value at zero evidence. Without
labels of both kinds every score is 0. Repeated rows get equal answers. Very long texts
are scanned whole, in linear time. Input columns come back in ``row``, so none clashes. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batched, fold, sampled, save, table

_TOKEN = re.compile(r"\w+").findall


@dataclass(frozen=True)
class ToxicConfig:
    sample_docs: int = 20_000
    min_docs: int = 4
    min_z: float = 3.1
    #: Log-odds of a lexicon feature at least; long documents hold more of any word, which weighs less than this.
    min_odds: float = 3.0
    #: Documents that the prior counts for: a share of the sample, and the least.
    prior_share: float = 0.013
    least_prior: float = 25.0
    drift: float = 0.3
    chance: float = 0.2


@dataclass
class ToxicModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    drift: float = 0.3
    scale: float = 1.0
    constant: float = 0.1
    chance: float = 0.2
    slope: float = 0.0
    offset: float = -50.0


def features(token: str) -> list[str]:
    """A token and its stems, which end with a hyphen."""
    return [token, *[token[:n] + "-" for n in range(4, min(8, len(token)))]]


def token_score(lexicon: dict[str, float], token: str) -> float | None:
    got = [lexicon[f] for f in features(token) if f in lexicon]
    return max(got) if got else None


def maximal_segments(scored: list[tuple[int, float]], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, past last, score) of ``n`` tokens, in linear time.

    scored: positions and scores of the tokens that don't score ``-drift``. Segments that
    may still grow lie on a stack with the sums before and after them; a new one merges
    with the last that starts lower and ends lower than it.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for i, s in scored:
        total -= drift * (i - at)
        low, total, at = total, total + s, i + 1
        lo, left, right = i, low, total
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            lo, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((lo, at, left, right))
    return [(lo, hi, right - left) for lo, hi, left, right in stack]


class Scorer:
    """Scores texts with a cache of words."""

    def __init__(self, model: ToxicModel):
        self.model, self.cache = model, {}

    def segments(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments in tokens, with their evidence in nats over chance."""
        m, cache = self.model, self.cache
        tokens = _TOKEN((text or "").lower())
        scored = []
        for w in set(tokens).difference(cache):
            cache[w] = token_score(m.lexicon, w)
        if len(cache) > 300_000:
            self.cache = {}
        for i, s in enumerate(map(cache.get, tokens)):
            if s is not None:
                scored.append((i, s))
        floor = math.log(m.constant * max(1, len(tokens)) / m.chance)
        return [(lo, hi, m.scale * s - floor) for lo, hi, s in maximal_segments(scored, len(tokens), m.drift) if m.scale * s > floor]

    def evidence(self, text: str | None) -> float:
        return max((e for _, _, e in self.segments(text)), default=0.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.model.offset + self.model.slope * evidence))))


def _extreme_value(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(root * s)) = 1, for a falling walk."""
    p = weights / weights.sum()
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(np.minimum(hi * scores, 300))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * scores, 300))).sum() < 1 else (lo, mid)
    return hi


def train_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", id_col: str = "doc_id", config: ToxicConfig = ToxicConfig()) -> ToxicModel | None:
    """Fit on about ``sample_docs`` labelled rows, chosen by the hash of their ids.

    The chosen labels, whose number is bounded, are broadcast; the texts aren't shuffled.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col), F.col(label).cast("int").alias("y")).distinct()
    picked = F.broadcast(sampled(known, id_col, config.sample_docs))
    rows = save(docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, id_col).select("y", "text"), "op8-sample")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[y].update({f for w in set(_TOKEN(t.lower())) for f in features(w)} | {""})
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([seen[y][k] for k in keys], pa.int64()) for y in (0, 1)]], ["f", "c0", "c1"])

    counts = rows.select("y", "text").mapInArrow(batched(count), "f string, c0 long, c1 long").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    docs = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in docs}
    if not n.get(0) or not n.get(1):
        return None
    both = F.col("c0") + F.col("c1")
    strength = max(config.least_prior, config.prior_share * (n[0] + n[1]))
    prior = both * (strength / (n[0] + n[1]))
    y0, y1 = F.col("c0") + prior, F.col("c1") + prior
    odds = F.log(y1 / (n[1] + strength - y1)) - F.log(y0 / (n[0] + strength - y0))
    z = odds / F.sqrt(1 / y1 + 1 / y0)
    picked = counts.filter((F.col("f") != "") & (both >= config.min_docs) & (F.col("c1") > 0) & (both < n[0] + n[1])).select("f", odds.alias("odds"), z.alias("z"))
    picked = picked.filter((F.col("z") >= config.min_z) & (F.col("odds") >= config.min_odds)).collect()
    model = ToxicModel({r["f"]: float(r["odds"]) for r in picked}, config.drift, chance=config.chance)
    lexicon = model.lexicon

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        hist: Counter = Counter()
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if y == 0:
                for w in _TOKEN(t.lower()):
                    s = token_score(lexicon, w)
                    hist[-1 if s is None else int(s * 4)] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(hist.keys()), pa.int64()), pa.array(list(hist.values()), pa.int64())], ["s", "c"])

    freq = {r["s"]: r["c"] for r in rows.select("y", "text").mapInArrow(batched(tally), "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).collect()}
    quiet, loud = max(1, freq.pop(-1, 1)), {k: v for k, v in freq.items()}
    top = max(lexicon.values(), default=1.0)
    loud[int(top * 4)] = loud.get(int(top * 4), 0) + 1
    scores = np.array([-config.drift, *[(k + 0.5) / 4 for k in loud]])
    weights = np.array([quiet, *loud.values()], float)
    model.scale = _extreme_value(scores, weights)
    model.constant = max(1e-6, float(weights[1:].sum() / weights.sum()))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Scorer(model)
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array([s.evidence(t) for t in batch.column("text").to_pylist()], pa.float64())], ["y", "e"])

    got = rows.select("y", "text").mapInArrow(batched(weigh), "y int, e double").collect()
    x, y = np.array([r["e"] for r in got]), np.array([r["y"] for r in got], float)
    model.slope, model.offset = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a weak prior; x is scaled by its spread."""
    unit = max(float(x.std()), 1e-9)
    a = np.stack([x / unit, np.ones_like(x)], 1)
    w = np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(w[0] / unit)), float(w[1])


def find_toxic(docs: DataFrame, model: ToxicModel | None, text: str = "text") -> DataFrame:
    """``row`` (the other columns), ``score`` and ``passages`` (tokens lo to hi, evidence) of each input row; no shuffle."""
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("_text"))
    passage = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        scorer = Scorer(model) if model else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.segments(t) if scorer else [] for t in batch.column("_text").to_pylist()]
            score = [scorer.probability(max((e for *_, e in f), default=0.0)) if scorer else 0.0 for f in found]
            shown = pa.array([[{"lo": lo, "hi": hi, "evidence": e} for lo, hi, e in f] for f in found], passage)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64()), shown], ["row", "score", "passages"])

        yield from batched(work, "_text")(batches)

    kind = T.StructType().add("row", packed.schema["row"].dataType).add("score", "double").add("passages", T.ArrayType(T.StructType().add("lo", "long").add("hi", "long").add("evidence", "double")))
    return packed.mapInArrow(run, kind)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``; learned from the folds that aren't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    out = find_toxic(docs, train_toxicity(docs, labels))
    held = F.coalesce(fold("row.doc_id", 4) == 2, F.lit(True))
    return out.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
