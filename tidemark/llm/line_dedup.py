"""Line deduplication by pairwise alignment.

1. Each text is cut at line feeds and its lines are hashed (64 bits).
2. A block can only go if it holds a run of lines that reaches ``min_chars`` characters.
   The shortest such runs from each line on, and up to each line, are a document's keys:
   any line of a common block lies in a key that both documents hold.
3. Each later holder of a key is first paired with the key's earliest holder, so a line
   in a third of all documents costs one pair a document. Documents are ordered by id,
   then by their text's hash. A holder of frequent keys is copied, and its pairs are
   dealt over the copies.
4. Keys with a line that still stands then meet further earlier holders, in hashed order
   and batches that grow, until no such key has an earlier holder that it hasn't met. The
   result is that of an alignment with every earlier document that shares a line.
5. Patience diff aligns the two line sequences: lines that occur once in both, in
   longest increasing order, are anchors; matches grow from them and between them. A gap
   without such a line has its longest common run of lines (most lines that aren't blank)
   as anchor, so repeated passages align too.
6. Aligned common blocks (consecutive in both documents) of ``min_chars`` characters or
   more are deleted from the later document. A partner is skipped when earlier ones
   have already taken all lines that paired it.

The earliest holder of a line keeps it, so no content vanishes from the corpus. A blank
line pairs no documents, but may be part of a block. A null text stays null, and a
text without a deleted line stays as it is, to the byte. A text that loses all its lines
becomes empty. Rows with a null id are not compared. Rows equal in id and text are one
document. Ids may have any type that has an order. A very long text is one row with its
partners' lines, at most about ``partners_a_row`` of them. Extra columns are carried in
``row``, so none clashes. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table


@dataclass(frozen=True)
class LineConfig:
    min_chars: int = 20
    #: Later holders of a line that meet one copy of its earliest holder.
    pairs_a_copy: int = 1024
    #: Further holders of a standing key in the first batch, and growth of the batches.
    batch: int = 4
    growth: int = 8
    #: Partners of a document that one row gathers.
    partners_a_row: int = 256


def longest_run(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the common run with most lines that aren't blank; a suffix automaton of ``a`` reads ``b``."""
    follow: list[dict[int, int]] = [{}]
    link, size, end = [-1], [0], [0]
    last = 0
    for i, h in enumerate(a):
        new, p = len(follow), last
        follow.append({})
        size.append(i + 1)
        end.append(i + 1)
        link.append(0)
        while p >= 0 and h not in follow[p]:
            follow[p][h] = new
            p = link[p]
        if p >= 0:
            q = follow[p][h]
            if size[q] > size[p] + 1:
                twin = len(follow)
                follow.append(dict(follow[q]))
                size.append(size[p] + 1)
                end.append(end[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(h) == q:
                    follow[p][h] = twin
                    p = link[p]
                link[q] = q = twin
            link[new] = q
        last = new
    filled = [0]
    best, found, state, n = (0, 0), (0, 0, 0), 0, 0
    for j, h in enumerate(b, 1):
        filled.append(filled[-1] + (h != 0))
        while state and h not in follow[state]:
            state = link[state]
            n = size[state]
        if h in follow[state]:
            state, n = follow[state][h], n + 1
        if (filled[j] - filled[j - n], n) > best:
            best, found = (filled[j] - filled[j - n], n), (end[state] - n, j - n, n)
    return found


def matched_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions that patience diff aligns, or the longest common run where no line is unique."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        place = {h: y for y, h in enumerate(b[j:n], j) if once_b[h] == 1}
        common = [(x, place[h]) for x, h in enumerate(a[i:m], i) if once_a[h] == 1 and h in place]
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(common)
        for k, (_, y) in enumerate(common):
            p = bisect_left(tails, y)
            back[k] = ends[p - 1] if p else -1
            tails[p : p + 1], ends[p : p + 1] = [y], [k]
        k, chain = (ends[-1] if ends else -1), []
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        if not chain:
            x, y, size = longest_run(a[i:m], b[j:n])
            if size:
                x, y = x + i, y + j
                out.extend((x + k, y + k) for k in range(size))
                todo += [(i, x, j, y), (x + size, m, y + size, n)]
            continue
        x0, y0 = i, j
        for x, y in [*chain[::-1], (m, n)]:
            todo.append((x0, x, y0, y))
            if x < m:
                out.append((x, y))
            x0, y0 = x + 1, y + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranges of positions in ``b`` of maximal aligned blocks."""
    blocks: list[list[int]] = []
    last = (-2, -2)
    for x, y in matched_lines(a, b):
        if (x - 1, y - 1) == last:
            blocks[-1][1] = y + 1
        else:
            blocks.append([y, y + 1])
        last = (x, y)
    return [(lo, hi) for lo, hi in blocks]


def deletions(lines: list[int], sizes: list[int], partners: list[tuple[list[int], list[int]]], min_chars: int) -> list[bool]:
    """Which lines go; partners: the shared lines and the earlier document's lines, rarest first."""
    gone = [False] * len(lines)
    before = np.concatenate([[0], np.cumsum(sizes)])
    where: dict[int, list[int]] = {}
    for i, h in enumerate(lines):
        where.setdefault(h, []).append(i)
    for shared, earlier in partners:
        if all(gone[i] for h in shared for i in where[h]):
            continue
        for lo, hi in common_blocks(earlier, lines):
            if before[hi] - before[lo] >= min_chars:
                gone[lo:hi] = [True] * (hi - lo)
    return gone


_PRIME, _BASE = (1 << 61) - 1, 1_000_003_579


def runs(lines: list[int], sizes: list[int], min_chars: int) -> dict[int, list[tuple[int, int]]]:
    """Ranges of the shortest runs of ``min_chars`` characters from and up to each line, by the run's hash; blank lines add none."""
    n, need = len(lines), max(1, min_chars)
    total, code, power = [0], [0], [1]
    for h, size in zip(lines, sizes, strict=True):
        total.append(total[-1] + (size if h else 0))
        code.append((code[-1] * _BASE + h) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    found = set()
    hi = 0
    for lo in range(n):
        while hi < n and total[hi] - total[lo] < need:
            hi += 1
        if total[hi] - total[lo] >= need:
            found.add((lo, hi))
    lo = n
    for hi in range(n, 0, -1):
        while lo > 0 and total[hi] - total[lo] < need:
            lo -= 1
        if total[hi] - total[lo] >= need:
            found.add((lo, hi))
    out: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in sorted(found):
        key = lines[lo] if hi == lo + 1 else hash((hi - lo, (code[hi] - code[lo] * power[hi - lo]) % _PRIME))
        out.setdefault(key, []).append((lo, hi))
    return out


def keys(lines: list[int], sizes: list[int], min_chars: int) -> list[tuple[int, list[tuple[int, int]], bool]]:
    """Key, ranges that it covers, and whether it asks for partners.

    Blanks of a block may differ between documents and count by the later one's size. So
    where they have characters, every line asks for all its holders, of which those with a
    blank line have keys of their short lines too.
    """
    found = runs(lines, sizes, min_chars)
    out = [(k, cover, True) for k, cover in found.items()]
    if 0 in lines:
        asks = any(size and not h for h, size in zip(lines, sizes, strict=True))
        out += [(h, [(0, len(lines))], asks) for h in sorted({h for h in lines if h and h not in found})]
        if asks:
            out = [(k, [(0, len(lines))], True) for k, _, _ in out]
    return out


def _keys(min_chars: int):
    cover_type = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, key, ends, lo, hi, asks = [], [], [0], [], [], []
        for i, (lines, sizes) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("sizes").to_pylist(), strict=True)):
            for k, cover, ask in keys(lines, sizes, min_chars):
                at.append(i)
                key.append(k)
                asks.append(ask)
                for a, b in cover:
                    lo.append(a)
                    hi.append(b)
                ends.append(len(lo))
        ranges = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"])
        cover = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ranges).cast(cover_type)
        return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), pa.array(key, pa.int64()), cover, pa.array(asks, pa.bool_())], ["doc", "h", "cover", "ask"])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                yield work(b.slice(lo, 500))

    return run


def _align(min_chars: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lines, sizes, partners in zip(*[batch.column(c).to_pylist() for c in ("lines", "sizes", "partners")], strict=True):
            ranked = sorted(partners, key=lambda p: (p["rarity"], p["first"]["id"], p["first"]["th"]))
            shared = [({h for lo, hi in {(r["lo"], r["hi"]) for r in p["cover"]} for h in lines[lo:hi]}, p["earlier"]) for p in ranked]
            out.append(deletions(lines, sizes, shared, min_chars))
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.list_(pa.bool_()))], ["doc", "gone"])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                yield work(b.slice(lo, 200))

    return run


def _paired(asks: DataFrame) -> DataFrame:
    """One row for each document and partner."""
    return asks.groupBy("doc", "first").agg(F.min("c").alias("rarity"), F.flatten(F.collect_list("cover")).alias("cover"))


def remove_shared_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", config: LineConfig = LineConfig()) -> DataFrame:
    """``row`` (the input's columns), ``kept`` (the remaining text), ``n_lines`` and ``n_dropped`` of each input row."""
    body = F.col(f"`{text}`")
    doc = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("th"))
    kind = docs.schema[id_col].dataType.simpleString()
    key_type = f"struct<id:{kind},th:bigint>"
    lines = F.split(body, "\n", -1)
    hashed = docs.filter(F.col(f"`{id_col}`").isNotNull() & body.isNotNull()).select(doc.alias("doc"), lines.alias("all"))
    seq = hashed.select("doc", F.transform("all", lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("lines"), F.transform("all", lambda x: F.length(x)).alias("sizes"))
    seq = save(seq, "op5-lines")
    held = save(seq.mapInArrow(_keys(config.min_chars), f"doc {key_type}, h bigint, cover array<struct<lo:int,hi:int>>, ask boolean"), "op5-keys")
    first = held.groupBy("h").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("c"), F.max("ask").alias("asked")).filter("c > 1 AND asked").drop("asked")
    first = save(first, "op5-shared")
    asks = save(held.filter("ask").drop("ask").join(first, "h").filter("doc > first"), "op5-asks")
    one = seq.dropDuplicates(["doc"])
    copies = lambda c: F.ceil(F.col(c) / config.pairs_a_copy)
    firsts = first.groupBy("first").agg(F.max("c").alias("most")).select("first", F.explode(F.sequence(F.lit(0).cast("long"), copies("most") - 1)).alias("copy"))
    lines_of = one.select(F.col("doc").alias("first"), F.col("lines").alias("earlier"))
    either = lambda a, b: F.zip_with(a, b, lambda x, y: x | y)

    def aligned(pairs: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
        """Which lines of each document go; rows of at most about ``partners_a_row`` partners are aligned one by one."""
        many = pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("p")).filter(F.col("p") > config.partners_a_row)
        many = save(many.select("doc", F.ceil(F.col("p") / config.partners_a_row).alias("slots")), "op5-many")
        dealt = pairs.join(many, "doc", "left").withColumn("slot", F.pmod(F.xxhash64("first"), F.coalesce("slots", F.lit(1)))).join(lines, by)
        lists = dealt.groupBy("doc", "slot").agg(F.collect_list(F.struct("rarity", "first", "cover", "earlier")).alias("partners")).drop("slot")
        parts = one.join(lists, "doc").mapInArrow(_align(config.min_chars), f"doc {key_type}, gone array<boolean>")
        merged = parts.groupBy("doc").agg(F.collect_list("gone").alias("lists"))
        return merged.select("doc", F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], either).alias("gone"))

    stands = F.exists("cover", lambda r: F.exists(F.slice("gone", r["lo"] + 1, r["hi"] - r["lo"]), lambda g: ~g))
    pairs = _paired(asks).withColumn("copy", F.pmod(F.xxhash64("doc"), copies("rarity")))
    gone = save(aligned(pairs, firsts.join(lines_of, "first"), ["first", "copy"]), "op5-gone")
    left, low, high = asks.filter("c > 2"), 0, config.batch
    while True:
        left = save(left.join(gone, "doc").filter(stands).drop("gone"), "op5-left")
        if left.isEmpty():
            break
        # A key's next holders are picked before they meet what stands.
        place = F.pmod(F.xxhash64("other"), F.lit(1 << 30)) * F.col("n") / float(1 << 30)
        open_ = save(left.select("h", F.col("c").alias("n")).distinct(), "op5-open")
        others = held.select("h", F.col("doc").alias("other")).join(open_, "h").filter((place >= low) & (place < high)).drop("n")
        met = left.join(others, "h").filter((F.col("other") < F.col("doc")) & (F.col("other") != F.col("first")))
        met = _paired(met.drop("first").withColumnRenamed("other", "first"))
        more = aligned(save(met, "op5-met"), lines_of, ["first"]).withColumnRenamed("gone", "more")
        gone = save(gone.join(more, "doc", "left").select("doc", F.when(F.col("more").isNull(), F.col("gone")).otherwise(either("gone", "more")).alias("gone")), "op5-gone")
        low, high = high, high * config.growth
        left = left.filter(F.col("c") > low)
    gone = gone.filter(F.exists("gone", lambda g: g)).select(F.col("doc.id").alias("_id"), F.col("doc.th").alias("_th"), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = docs.select(row, F.col(f"`{id_col}`").alias("_id"), F.xxhash64(body).alias("_th")).join(gone, ["_id", "_th"], "left")
    text_col = F.col("row")[text]
    cut = both.withColumn("_lines", F.split(text_col, "\n", -1))
    left = F.array_join(F.filter("_lines", lambda x, i: ~F.get(F.col("gone"), i)), "\n")
    return cut.select(
        "row",
        F.when(F.col("gone").isNull(), text_col).otherwise(left).alias("kept"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0)).cast("long").alias("n_dropped"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` that aligned blocks of earlier documents repeat."""
    out = remove_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.length("kept").cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
