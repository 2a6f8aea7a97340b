"""Personal data: exact patterns, and a character BiLSTM with CRF transitions.

1. Base spans: emails, IP addresses, card and phone numbers by pattern and check, each
   kind leftmost and non-overlapping over the whole text, in linear time.
2. The tagger reads characters in both directions (LSTM) and decodes tags (begin and
   inside for each kind, or none) with learned transitions. It is trained in numpy on
   windows of about ``sample_docs`` texts, labelled by their base spans and by variants
   of them (a phone number without its plus, with other separators, a second span right
   after the first), and on windows with digits or ``@`` but no span. Windows with a match
   that fails its check but may hide a span, like a phone and a card number in one run of
   digits and blanks, teach nothing: finding those is what the tagger adds.
3. Every span of these kinds holds a digit or ``@``, so only windows with one are decoded.
   Windows of ``window`` characters overlap by half; a character takes the tag of the
   window in whose middle half it lies, and spans are read off the stitched tags, so
   a span may cross windows.
4. A tagged span is added if it touches no base span, its characters' mean posterior is
   ``min_posterior`` or more and it passes its kind's check. Base spans stay.

The bounds of the training sample are parameters of ``PiiConfig``; all texts are searched
whole, however long. A null or empty text has no spans. Repeated rows get equal answers.
Input columns come back in ``row``, so none clashes. An empty table gives an empty result; without a base span to learn from, nothing is added.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batched, sampled, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
#: A run of digits matches from its first digit or not at all.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_IP_ALL = re.compile(r"[0-9]+(?:\.[0-9]+){3}").fullmatch
_CARD_ALL = re.compile(r"[0-9](?:[\x20-]?[0-9])+").fullmatch
_DIGIT = re.compile(r"[0-9]").search
_MARK = re.compile(r"[0-9@]").finditer


@dataclass(frozen=True)
class PiiConfig:
    #: Bounds of the training sample: texts, windows a text around spans and other marks, and windows drawn from them.
    sample_docs: int = 600
    spans_a_text: int = 4
    marks_a_text: int = 2
    windows: int = 1200
    #: Characters that are decoded at once.
    window: int = 64
    hidden: int = 20
    epochs: int = 6
    batch: int = 32
    rate: float = 0.02
    min_posterior: float = 0.95
    #: Chance that a span of the training windows is followed by another one.
    joined: float = 0.4
    seed: int = 11


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: a run of local characters must end at the ``@``."""
    out, end = [], 0
    p = text.find("@")
    while p >= 0:
        s = p
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < p and (m := _DOMAIN(text, p + 1)):
            end = m.end()
            out.append((s, end))
        p = text.find("@", max(p + 1, end))
    return out


def valid(kind: int, s: str) -> bool:
    """The check of a kind's match."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == 2:
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind == 0 or 9 <= len(_digits(s)) <= 15


def matches(text: str) -> list[Span]:
    """Kind number, start and end (code points) of the patterns' matches, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT(text):
        out += [(k, m.start(), m.end()) for k, find in ((1, _IP), (2, _CARD)) for m in find(text)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE(text)]
    return out


def base_spans(text: str) -> list[Span]:
    """The matches that pass their check."""
    return [(k, a, b) for k, a, b in matches(text) if valid(k, text[a:b])]


def encode(text: str) -> np.ndarray:
    """Symbols: printable ASCII each, 1 for other ASCII, 2 for the rest; 0 is padding."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw > 126, 2, np.where(raw < 32, 1, raw - 29)).astype(np.int16)


SYMBOLS = 98
TAGS = 1 + 2 * len(KINDS)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Tagger:
    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.params = {
            "x": rng.normal(0, 0.3, (2, SYMBOLS, 4 * h)).astype(np.float32),
            "r": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)).astype(np.float32),
            "b": np.tile(np.repeat([0, 1, 0, 0], h), (2, 1)).astype(np.float32),
            "o": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS)).astype(np.float32),
            "c": np.zeros(TAGS, np.float32),
            "t": np.zeros((TAGS, TAGS), np.float32),
        }

    def _lstm(self, x: np.ndarray, d: int) -> dict:
        p, h = self.params, self.h
        n, length = x.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        gates, cells, states = np.empty((length, n, 4 * h), np.float32), np.empty((length + 1, n, h), np.float32), np.empty((length + 1, n, h), np.float32)
        cells[0], states[0] = cell, state
        look = p["x"][d] + p["b"][d]
        for s in range(length):
            z = look[x[:, s]] + state @ p["r"][d]
            z[:, : 3 * h] = 1 / (1 + np.exp(-z[:, : 3 * h]))
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            state = z[:, 2 * h : 3 * h] * np.tanh(cell)
            gates[s], cells[s + 1], states[s + 1] = z, cell, state
        return {"gates": gates, "cells": cells, "states": states}

    def _emissions(self, x: np.ndarray) -> tuple[np.ndarray, list[dict], np.ndarray]:
        runs = [self._lstm(x, 0), self._lstm(x[:, ::-1], 1)]
        both = np.concatenate([runs[0]["states"][1:], runs[1]["states"][1:][::-1]], 2)
        return both @ self.params["o"] + self.params["c"], runs, both

    def _posterior(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores and the log partition."""
        t = self.params["t"]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        for s in range(1, len(e)):
            a[s] = _logsum(a[s - 1][:, :, None] + t, 1) + e[s]
        for s in range(len(e) - 2, -1, -1):
            b[s] = _logsum(t + (e[s + 1] + b[s + 1])[:, None, :], 2)
        return a, b, _logsum(a[-1], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        p, h = self.params, self.h
        n, length = x.shape
        e, runs, both = self._emissions(x)
        a, b, z = self._posterior(e)
        yt, rows = y.T, np.arange(n)
        gold = np.take_along_axis(e, yt[:, :, None], 2).sum() + p["t"][yt[:-1], yt[1:]].sum()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de = np.exp(a + b - z[:, None])
        for s in range(length):
            de[s][rows, yt[s]] -= 1
        for s in range(1, length):
            g["t"] += np.exp(a[s - 1][:, :, None] + p["t"] + (e[s] + b[s] - z[:, None])[:, None, :]).sum(0)
        np.add.at(g["t"], (yt[:-1], yt[1:]), -1)
        de /= n
        g["t"] /= n
        g["o"], g["c"] = np.tensordot(both, de, ([0, 1], [0, 1])), de.sum((0, 1))
        ds = de @ p["o"].T
        for d, run in enumerate(runs):
            own = ds[:, :, :h] if d == 0 else ds[::-1, :, h:]
            xs = x if d == 0 else x[:, ::-1]
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for s in range(length - 1, -1, -1):
                q, c0, th = run["gates"][s], run["cells"][s], np.tanh(run["cells"][s + 1])
                i, f, o, u = q[:, :h], q[:, h : 2 * h], q[:, 2 * h : 3 * h], q[:, 3 * h :]
                dh = dh + own[s]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], 1)
                np.add.at(g["x"][d], xs[:, s], dz)
                g["b"][d] += dz.sum(0)
                g["r"][d] += run["states"][s].T @ dz
                dh, dc = dz @ p["r"][d].T, dc * f
        return float((z.sum() - gold) / n), g

    def train(self, x: np.ndarray, y: np.ndarray, config: PiiConfig) -> "Tagger":
        rng = np.random.default_rng(config.seed + 1)
        m, v, step = {k: 0 * p for k, p in self.params.items()}, {k: 0 * p for k, p in self.params.items()}, 0
        for epoch in range(config.epochs):
            order = rng.permutation(len(x))
            rate = config.rate * (1 - epoch / config.epochs)
            for lo in range(0, len(x), config.batch):
                ids = order[lo : lo + config.batch]
                _, g = self.gradients(x[ids], y[ids])
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                step += 1
                for k, q in g.items():
                    q *= min(1.0, 5 / (norm + 1e-9))
                    m[k] += 0.1 * (q - m[k])
                    v[k] += 0.01 * (q * q - v[k])
                    self.params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (Viterbi) and their posteriors, by window and place."""
        e, _, _ = self._emissions(x)
        a, b, z = self._posterior(e)
        t = self.params["t"]
        score, back = e[0], np.empty(e.shape, np.int64)
        for s in range(1, len(e)):
            all_ = score[:, :, None] + t
            back[s] = all_.argmax(1)
            score = all_.max(1) + e[s]
        tags = np.empty(e.shape[:2], np.int64)
        tags[-1] = score.argmax(1)
        rows = np.arange(e.shape[1])
        for s in range(len(e) - 1, 0, -1):
            tags[s - 1] = back[s][rows, tags[s]]
        sure = np.exp(np.take_along_axis(a + b, tags[:, :, None], 2)[:, :, 0] - z)
        return tags.T, sure.T


def _variant(kind: int, s: str, rng: np.random.Generator) -> str:
    if kind == 3:
        s = s.lstrip("+") if rng.random() < 0.4 else s
        s = s.replace("-", rng.choice([".", "-", " "])) if rng.random() < 0.3 else s
    return "".join(chr(48 + rng.integers(10)) if "0" <= c <= "9" else c for c in s) if rng.random() < 0.5 else s


def train_tagger(docs: DataFrame, text: str = "text", order_by: str = "doc_id", config: PiiConfig = PiiConfig()) -> Tagger | None:
    """Fit on windows around digits and ``@`` of about ``sample_docs`` such texts, chosen by the hash of ``order_by``."""
    size = config.window

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(text).to_pylist():
            every, at = matches(t), [m.start() for m in _MARK(t)]
            spans = [(k, a, b) for k, a, b in every if valid(k, t[a:b])]
            hiding = [(a, b) for k, a, b in every if k > 1 and len(_digits(t[a:b])) >= 13 and not valid(k, t[a:b])]
            found = []
            for p in [s[1] for s in spans][: config.spans_a_text] + at[:: max(1, len(at) // config.marks_a_text)][: config.marks_a_text]:
                lo = max(0, p - size // 3)
                if any(a < lo + 2 * size and b > lo for a, b in hiding):
                    continue
                found.append({"text": t[lo : lo + 2 * size], "spans": [{"k": k, "lo": max(0, a - lo), "hi": min(2 * size, b - lo)} for k, a, b in spans if a < lo + 2 * size and b > lo]})
            out.append(found)
        kind = pa.list_(pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("k", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])))]))
        return pa.RecordBatch.from_arrays([pa.array(out, kind)], ["found"])

    sample = sampled(docs.filter(F.col(text).rlike("[0-9@]")), order_by, config.sample_docs).select(text).mapInArrow(batched(windows, text), "found array<struct<text:string,spans:array<struct<k:long,lo:long,hi:long>>>>")
    examples = sorted((w["text"], [(s["k"], s["lo"], s["hi"]) for s in w["spans"]]) for r in sample.collect() for w in r["found"])
    if not any(s for _, s in examples):
        return None
    pool = [(k, t[lo:hi]) for t, spans in examples for k, lo, hi in spans]
    rng = np.random.default_rng(config.seed)
    xs, ys = [], []
    for k in rng.integers(len(examples), size=config.windows):
        t, spans = examples[k]
        parts, tags, at = [], [], 0
        for kind, lo, hi in sorted(spans, key=lambda s: s[1]):
            if lo < at:
                continue
            own = _variant(kind, t[lo:hi], rng)
            parts += [t[at:lo], own]
            tags += [0] * (lo - at) + [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1)
            while rng.random() < config.joined:
                more, other = pool[rng.integers(len(pool))]
                gap, other = str(rng.choice([" ", " ", " ", ", ", "\n"])), _variant(more, other, rng)
                parts += [gap, other]
                tags += [0] * len(gap) + [1 + 2 * more] + [2 + 2 * more] * (len(other) - 1)
            at = hi
        parts.append(t[at:])
        x, y = encode("".join(parts)), np.array(tags + [0] * (len(t) - at))
        lo = int(rng.integers(0, max(1, min(size // 2, len(x) - size // 2))))
        x, y = x[lo : lo + size], y[lo : lo + size]
        xs.append(np.pad(x, (0, size - len(x))))
        ys.append(np.pad(y, (0, size - len(y))))
    return Tagger(config.hidden, config.seed).train(np.array(xs), np.array(ys), config)


def added_spans(tagger: Tagger, text: str, base: list[Span], config: PiiConfig) -> list[Span]:
    """Spans of the stitched tags that meet the conditions and touch no base span."""
    size, half, quarter = config.window, config.window // 2, config.window // 4
    blocks = sorted({m.start() // half for m in _MARK(text)})
    near = sorted({b + o for b in blocks for o in (-1, 0, 1) if 0 <= b + o <= len(text) // half})
    if not near:
        return []
    symbols = np.concatenate([np.zeros(quarter, np.int16), encode(text), np.zeros(size + half, np.int16)])
    tags, sure = np.zeros(len(text) + size, np.int64), np.zeros(len(text) + size)
    for lo in range(0, len(near), 512):
        ids = np.array(near[lo : lo + 512])
        got, post = tagger.decode(symbols[(ids * half)[:, None] + np.arange(size)])
        for k, b in enumerate(ids.tolist()):
            tags[b * half : (b + 1) * half] = got[k, quarter : quarter + half]
            sure[b * half : (b + 1) * half] = post[k, quarter : quarter + half]
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    out, at = [], 0
    hot = np.flatnonzero(tags[: len(text)])
    for s in hot.tolist():
        if s < at or tags[s] % 2 == 0:
            continue
        kind, e = int(tags[s] - 1) // 2, s + 1
        while e < len(text) and tags[e] == 2 + 2 * kind:
            e += 1
        at = e
        own = text[s:e]
        fits = [own.count("@") == 1 and "." in own.partition("@")[2], bool(_IP_ALL(own)), bool(_CARD_ALL(own)), not own.isdigit()][kind] and valid(kind, own)
        whole = not ((s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()))
        if fits and whole and sure[s:e].mean() >= config.min_posterior and not taken[s:e].any():
            out.append((kind, s, e))
    return out


def find_pii(docs: DataFrame, tagger: Tagger | None, text: str = "text", config: PiiConfig = PiiConfig()) -> DataFrame:
    """``row`` (the other columns), ``base`` and ``spans`` (kind, lo, hi in code points) of each input row; no shuffle."""
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("_text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shown = lambda spans: [{"kind": KINDS[k], "lo": a, "hi": b} for k, a, b in spans]
        base, every = [], []
        for t in batch.column("_text").to_pylist():
            own = base_spans(t or "")
            more = added_spans(tagger, t, own, config) if tagger and t else []
            base.append(shown(own))
            every.append(shown(sorted(own + more)))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(base, span), pa.array(every, span)], ["row", "base", "spans"])

    kind = T.ArrayType(T.StructType().add("kind", "string").add("lo", "long").add("hi", "long"))
    return packed.mapInArrow(batched(work, "_text"), T.StructType().add("row", packed.schema["row"].dataType).add("base", kind).add("spans", kind))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_pii(docs, train_tagger(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    return out.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
