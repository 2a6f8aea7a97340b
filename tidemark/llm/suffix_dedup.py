"""Exact removal of repeated byte strings with two-stage suffix sorting.

Every byte that a ``length``-byte string covers which also starts anywhere else, in
the same text or another, is removed; matches never cross texts.

1. Each start of a ``length``-byte window is keyed by the window's smallest k-gram
   hash. Equal windows have equal keys, whatever text they are in, and consecutive
   starts whose leftmost such k-gram is the same form a run; a text has about one run
   for every 120 bytes. Two equal windows of one text are in different runs.
2. Keys that occur once can't hold a repeat. Of the others, runs with equal bytes form
   a class, and a class enters the sort with at most two of its runs: two copies show
   that each of its windows repeats, and more copies can't change that. So a passage
   in a third of all texts costs two runs.
3. Runs are dealt by key. A task sorts a few megabytes of whole keys at a time:
   suffixes smaller than their successors are sorted directly, the others are induced
   by scanning the buckets, and adjacent common prefixes mark the starts that repeat.
4. A key with more than ``max_classes`` classes isn't gathered in one task: its classes
   are taken as texts of their own and keyed anew by longer k-grams, and finally by the
   whole window, where a key has one class. No window is lost on the way.
5. Repeats of a class hold for all its runs; ranges go back to their texts.

Classes are told apart by a cryptographic hash of the run's bytes (BLAKE2, 128 bits) and
the length, so no two different runs stand for each other. Rolling hashes only choose
keys: texts that they confuse meet in the sort and are compared there.

A null text is empty; a text under ``length`` bytes stays whole. Repeated rows (equal
ids too) count as separate texts. Very long texts are walked whole. Extra columns are
carried in ``row``, so none clashes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batched, mix, save, table

RUN = ["h", "r1", "r2", "n"]


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 400
    #: Bytes of the k-gram that keys a window, for one level after another, as shares of ``length``.
    levels: tuple[float, ...] = (0.4, 0.8, 1.0)
    max_classes: int = 3000
    batch_bytes: int = 500_000


_BASE = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of any byte range, from prefix sums modulo 2**64; powers are kept between texts."""

    powers: tuple[np.ndarray, ...] = ()

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if not self.powers or len(self.powers[0]) < n:
            both = []
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                each = np.full(max(n, 1 << 19), b, np.uint64)
                each[0] = 1
                both.append(np.cumprod(each))
            Rolling.powers = tuple(both)
        power, self.inverse = self.powers
        self.sums = np.zeros(n, np.uint64)
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= power[: n - 1]
        np.cumsum(values, out=self.sums[1:])

    def of(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        at = self.inverse[: len(self.sums)]
        return mix((self.sums[hi] - self.sums[lo]) * at[lo])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    if w == 1:
        return x
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs over texts that lie end to end: start in ``data``, number of windows, key."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if len(data) < length:
        return none
    grams = Rolling(data).of(slice(0, len(data) - k + 1), slice(k, None))
    low = sliding_min(grams, length - k + 1)
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(low) + 1, np.int8)
    whole = ends - begins >= length
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(starts):
        return none
    key = low[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (np.diff(starts) > 1) | (grams[starts[:-1]] == key[:-1])
    new |= np.isin(starts, begins)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), key[at].view(np.int64)


def _key_work(length: int, k: int):
    """The keys of all runs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column("raw").to_pylist()]
        *_, h = runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), length, k)
        return pa.RecordBatch.from_arrays([pa.array(h)], ["h"])

    return batched(work, "raw", most=400_000)


def _run_work(length: int, k: int):
    """All runs with their text, start, key and hash."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column("raw").to_pylist()]
        ends, data = np.cumsum([len(t) for t in texts]), b"".join(texts)
        s, n, h = runs(np.frombuffer(data, np.uint8), ends, length, k)
        owner = np.searchsorted(ends, s, "right")
        begin = np.concatenate([[0], ends[:-1]])[owner]
        each = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True)]
        r = np.frombuffer(b"".join(each), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("uid").take(pa.array(owner)), pa.array((s - begin).astype(np.int32)), pa.array(h), pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(n.astype(np.int32))],
            ["uid", "start", "h", "r1", "r2", "n"],
        )

    return batched(work, "raw", most=400_000)


def _cut_work(length: int):
    """The bytes of the picked runs of each text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw, parts in zip(batch.column("raw").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            rows += [(p["h"], p["r1"], p["r2"], p["n"], p["hot"], raw[p["start"] : p["start"] + p["n"] + length - 1]) for p in parts]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.binary())], [*RUN, "hot", "bytes"])

    return batched(work, "raw", most=1_000_000)


def two_stage_order(data: bytes, spans: list[tuple[int, int]], length: int) -> np.ndarray:
    """Starts of all ``length``-byte windows of the spans, ordered by their bytes.

    Of equal letters a bucket holds first the suffixes greater than their successors,
    then those smaller. The latter are sorted directly; scanning the buckets upwards
    puts each of the former where its successor's place asks for.
    """
    text = np.frombuffer(data, np.uint8)
    lo, hi = np.array(spans, np.int64).reshape(-1, 2).T
    step = np.zeros(len(text), np.int16)
    step[:-1] = np.diff(text.astype(np.int16))
    step[hi - 1] = -1
    every = np.arange(len(text))

    def upcoming(mask: np.ndarray) -> np.ndarray:
        return np.minimum.accumulate(np.where(mask, every, len(text))[::-1])[::-1]

    smaller = step[upcoming(step != 0)] > 0
    final = hi - length
    last = upcoming(smaller)[final]
    open_end = last >= hi
    last[open_end] = hi[open_end] - 1
    edges = np.zeros(len(text) + 1, np.int32)
    edges[lo] += 1
    edges[last + 1] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    direct, induced = inside & smaller, inside & ~smaller
    seeds = last[open_end]
    own = np.flatnonzero(direct)
    stop = np.minimum(own + length, hi[np.searchsorted(hi, own, "right")])
    keys = [data[x:y] for x, y in zip(own.tolist(), stop.tolist(), strict=True)]
    first = own[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    counts_l = np.bincount(text[induced], minlength=256)
    counts_s = np.bincount(text[direct], minlength=256)
    begin = np.concatenate([[0], np.cumsum(counts_l + counts_s)[:-1]])
    order = np.empty(int((counts_l + counts_s).sum()), np.int64)
    letters = text[first]
    order[np.arange(len(first)) - np.searchsorted(letters, np.arange(256))[letters] + (begin + counts_l)[letters]] = first
    heads = begin.copy()

    def push(found: np.ndarray) -> None:
        if not len(found):
            return
        c = text[found]
        by = np.argsort(c, kind="stable")
        found, c = found[by], c[by]
        new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        size = np.diff(np.append(new, len(c)))
        order[heads[c] + np.arange(len(c)) - np.repeat(new, size)] = found
        heads[c[new]] += size

    from_next = induced.copy()
    from_next[seeds] = False

    def before(part: np.ndarray) -> np.ndarray:
        p = part[part > 0] - 1
        return p[from_next[p]]

    push(seeds)
    for c in np.flatnonzero(counts_l + counts_s).tolist():
        at = int(begin[c])
        while at < heads[c]:
            at, part = int(heads[c]), order[at : heads[c]]
            push(before(part))
        push(before(order[begin[c] + counts_l[c] : begin[c] + counts_l[c] + counts_s[c]]))
    return order[order <= final[np.searchsorted(hi, order, "right")]]


def adjacent_prefixes(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix, up to ``length``, of each start in ``order`` with the one before it."""
    out = np.zeros(len(order), np.int32)
    if len(order) < 2:
        return out
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    for lo in range(1, len(order), 8192):
        differ = view[order[lo - 1 : lo - 1 + len(order[lo : lo + 8192])]] != view[order[lo : lo + 8192]]
        at = differ.argmax(1)
        out[lo : lo + 8192] = np.where(differ[np.arange(len(at)), at], at, length)
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text, the maximal ranges of starts whose window starts elsewhere in the texts too."""
    data = b"".join(texts)
    spans, at = [], 0
    for t in texts:
        spans.append((at, at + len(t)))
        at += len(t)
    order = two_stage_order(data, spans, length)
    same = adjacent_prefixes(data, order, length) >= length
    hit = np.zeros(len(data) + 1, bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    out = []
    for lo, hi in spans:
        edge = np.flatnonzero(np.diff(hit[lo:hi].view(np.int8), prepend=0, append=0)).tolist()
        out.append(list(zip(edge[::2], edge[1::2], strict=True)))
    return out


def _sort_tasks(length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[dict] = []
        size = 0

        def flush(rows: list[dict]) -> pa.RecordBatch:
            found = repeated_starts([r["bytes"] for r in rows], length)
            keep = {(r["h"], r["r1"], r["r2"], r["n"]): f for r, f in zip(rows, found, strict=True) if f}
            cols = list(zip(*keep, strict=True)) or [(), (), (), ()]
            ranges = pa.array([[{"lo": a, "hi": b} for a, b in f] for f in keep.values()], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.int32()), ranges], [*RUN, "ranges"])

        for batch in batches:
            for r in batch.to_pylist():
                if size >= most and pending[-1]["h"] != r["h"]:
                    yield flush(pending)
                    pending, size = [], 0
                pending.append(r)
                size += len(r["bytes"])
        if pending:
            yield flush(pending)

    return run


def _cover(starts: list[int], ranges: list[list[dict]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the ranges of window starts cover."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted((s + r["lo"], s + r["hi"] - 1 + length) for s, own in zip(starts, ranges, strict=True) for r in own):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return spans


def repeats(source: DataFrame, config: SuffixConfig, depth: int = 0) -> DataFrame:
    """``uid``, ``start`` and ``ranges`` of the runs of (uid, raw) that hold windows found elsewhere."""
    length, levels = config.length, [max(1, round(x * config.length)) for x in config.levels]
    kind = source.schema["uid"].dataType.simpleString()
    found = source.mapInArrow(_run_work(length, levels[depth]), f"uid {kind}, start int, h long, r1 long, r2 long, n int")
    twice = save(source.select("raw").mapInArrow(_key_work(length, levels[depth]), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "op2-keys")
    members = save(found.join(twice, "h", "left_semi"), "op2-runs")
    place = F.struct("uid", "start")
    classes = members.groupBy(*RUN).agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("a"), F.max(place).alias("b"))
    hot = None
    if depth + 1 < len(levels):
        hot = save(classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > config.max_classes).select("h", F.lit(True).alias("hot")), "op2-hot")
        hot = None if hot.isEmpty() else hot
    classes = classes.withColumn("hot", F.lit(False)) if hot is None else classes.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    picks = classes.select(*RUN, "hot", F.explode(F.when(F.col("c") == 1, F.array("a")).otherwise(F.array("a", "b"))).alias("p"))
    picks = picks.groupBy("p.uid").agg(F.collect_list(F.struct("p.start", *RUN, "hot")).alias("runs"))
    pieces = source.join(picks, "uid").mapInArrow(_cut_work(length), "h long, r1 long, r2 long, n int, hot boolean, bytes binary")
    pieces = pieces if hot is None else save(pieces, "op2-pieces")
    cold = pieces.filter("NOT hot").select(*RUN, "bytes").repartition("h").sortWithinPartitions("h")
    marked = save(cold.mapInArrow(_sort_tasks(length, config.batch_bytes), "h long, r1 long, r2 long, n int, ranges array<struct<lo:int,hi:int>>"), "op2-marks")
    if hot is not None:
        keyed = save(pieces.filter("hot").select(*RUN, F.col("bytes").alias("raw"), F.monotonically_increasing_id().alias("uid")), "op2-deeper")
        inner = repeats(keyed.select("uid", "raw"), config, depth + 1).select("uid", F.explode("ranges").alias("r"), "start")
        moved = F.struct((F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi")).alias("hi"))
        inner = inner.join(keyed.select("uid", *RUN), "uid").groupBy(*RUN).agg(F.collect_set(moved).alias("ranges"))
        marked = marked.unionByName(inner)
    return members.join(marked, RUN).select("uid", "start", "ranges")


def remove_repeats(docs: DataFrame, text: str = "text", config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """``row`` (the other columns), ``kept`` (remaining bytes), ``n_bytes`` and ``spans`` of each input row.

    Rows are told apart by 128 hashed bits of their text and 64 of the other columns;
    rows equal in all of them get the same answer, and each counts as a text of its own.
    """
    length = config.length
    others = [c for c in docs.columns if c != text]
    body = F.col(f"`{text}`")
    uid = F.unhex(F.concat(F.md5(F.coalesce(body, F.lit("")).cast("binary")), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in others], body))))
    keyed = docs.select(uid.alias("uid"), body.cast("binary").alias("raw"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    found = repeats(keyed.select("uid", "raw"), config)
    per_text = found.groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("ranges").alias("ranges"))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, spans = [], [], []
        for t, s, r in zip(batch.column("raw").to_pylist(), batch.column("starts").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw = t or b""
            own = _cover(s, r, length) if s else []
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *[y for _, y in own]], [*[x for x, _ in own], len(raw)], strict=True)))
            sizes.append(len(raw))
            spans.append([{"lo": a, "hi": b} for a, b in own])
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["row", "kept", "n_bytes", "spans"])

    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in keyed.schema["row"].dataType.fields)
    return keyed.join(per_text, "uid", "left").mapInArrow(batched(apply, "raw"), f"row struct<{row}>, kept binary, n_bytes long, spans array<struct<lo:long,hi:long>>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that no 400-byte repeat covers."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every 400-byte string by its start, in hexadecimal; overlapping or touching ones are one run.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, p, h[800 * p + 1:800 * p + 1598] AS h FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 799) // 800)) AS p FROM d)),
each AS (SELECT doc_id, 400 * p + unnest(range(0, len(h) // 2 - 399)) AS i, unnest(list_transform(range(0, len(h) // 2 - 399), lambda i: md5(h[2 * i + 1:2 * i + 800]))) AS m FROM pieces),
again AS (SELECT doc_id, i FROM each WHERE m IN (SELECT m FROM each GROUP BY m HAVING count(*) > 1)),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS begins, lo AS ends FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(s.hi), 0), any_value(len(d.h)) // 2 FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), kept AS (SELECT g.doc_id, string_agg(d.h[2 * begins + 1:2 * ends], '' ORDER BY begins) AS h FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
counted AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id
"""
