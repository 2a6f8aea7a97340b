"""Packing tokenized documents into sequences with a configuration linear program.

1. Each whole text is tokenized and closed with an end token; longer ones are cut into
   pieces of ``capacity`` tokens. White space always parts tokens of the tokenizer used
   here, so texts are tokenized word by word with a bounded cache of words.
2. Only the histogram of piece lengths, at most ``capacity`` rows, comes to the driver.
3. Lengths of ``small`` tokens or more are rounded up to classes. The linear program
   over configurations (multisets of classes that fit a sequence) that covers all
   classes with the fewest sequences is solved by multiplicative weights: each round,
   knapsack dynamic programming prices the configuration that covers most weight, it is
   added as far as its scarcest class allows, and the weights of its classes shrink.
4. Of the solution 0.9 are rounded down to whole sequences and filled with real lengths,
   but for the smallest place of each, which the rounded lengths would fill badly. What
   is left, and the small lengths, go best fit in falling order of length, into the
   space left in those sequences first and then into new ones. Sequences with equal
   contents are handled as one range, so the work depends on ``capacity`` and not on
   the number of documents.
5. A piece's rank among those of its length, from counts by input partition, gives its
   place: the ranges that say where ranks of each length go are the only thing sent to
   the executors, some tens of thousands at any input size.

A null text is empty: one end token. Repeated rows are packed each. An empty table gives
an empty result. Only the id and text columns are used.
"""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save, table


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 4096
    end_token: int = 1
    tokenizer: str = ""
    #: Lengths below go only into space that is left.
    small: int = 256
    classes: int = 512
    rounds: int = 800
    step: float = 0.25
    #: Leave the place of a configuration's smallest item to best fit by real lengths.
    open_end: bool = True
    #: Share of the program's solution that is rounded to whole sequences.
    share: float = 0.9
    cached_words: int = 1_200_000
    with_ids: bool = False


#: str.split() also parts at these, which the tokenizer reads as symbols.
_CONTROL = re.compile("[\x1c-\x1f]").search
_PARTS = re.compile(r"[^ \t\n\r]+").findall


#: Precomposed Latin letters, whose lower case and normal form don't depend on context, and closing punctuation.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,;:!?]*)").fullmatch


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit integers, exactly as the whole text's.

    The tokenizer parts letters from other signs, so a word of plain letters goes to its
    byte-pair model directly, in lower case, and closing punctuation by itself. Words are
    kept until ``most`` are known.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.own, self.most, self.cache, self.stems = Tokenizer.from_file(path), most, {}, {}
        self.model = self.own.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _full(self, words: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.own.encode_batch_fast(words, add_special_tokens=False)]

    def _mapped(self, letters: str) -> str:
        return letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.signs)

    def _learn(self, words: set[str]) -> None:
        odd, plain = [], []
        for w in words:
            if m := _PLAIN(w):
                letters, end = m.groups()
                plain.append((w, letters.lower(), end))
            else:
                odd.append(w)
        stems, tokenize = self.stems, self.model.tokenize
        for letters in {x for _, x, _ in plain}.difference(stems):
            stems[letters] = self._bytes([t.id for t in tokenize(self._mapped(letters))])
        ends = list({e for _, _, e in plain})
        shown = dict(zip(ends, self._full(ends), strict=True)) if ends else {}
        self.cache.update((w, stems[x] + shown[e]) for w, x, e in plain)
        for lo in range(0, len(odd), 4096):
            self.cache.update(zip(odd[lo : lo + 4096], self._full(odd[lo : lo + 4096]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [_PARTS(t) if _CONTROL(t) else t.split() for t in texts]
        if len(self.cache) + len(self.stems) > self.most:
            self.cache.clear()
            self.stems.clear()
        self._learn(set().union(*split).difference(self.cache))
        look = self.cache.__getitem__
        return [b"".join(map(look, words)) for words in split]


def _tokenizer(path: str, most: int) -> WordTokenizer:
    """One for each worker process; its cache of words outlives a task."""
    kept = sys.modules.setdefault("_tidemark_tokenizers", ModuleType("_tidemark_tokenizers")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path, most)
    return kept[path]


def _pieces(config: PackConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = config.tokenizer
        if not path:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        tokenizer = _tokenizer(path, config.cached_words)
        end = np.array([config.end_token], "<u4").tobytes()
        part, seen, size = TaskContext.get().partitionId(), defaultdict(int), config.capacity * 4
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                cols: list[list] = [[] for _ in range(8)]
                for doc, raw in zip(rows.column("id").to_pylist(), tokenizer.ids([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), size)):
                        own = raw[at : at + size]
                        n = len(own) // 4
                        for c, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(own), part, seen[n], own if config.with_ids else None), strict=True):
                            c.append(v)
                        seen[n] += 1
                kinds = (rows.column("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    return run


def knapsack(units: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of items that fits: item number to copies."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(units, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if u := usable[c]:
            got = best[c - units[:u]] + worth[:u]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], take[c] = got[k], k
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
            continue
        out[int(take[c])] += 1
        c -= int(units[take[c]])
    return out


def configuration_program(units: np.ndarray, need: np.ndarray, capacity: int, rounds: int, step: float) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional multiplicities that cover ``need`` of each item."""
    weight = np.ones(len(units))
    found: dict[tuple, float] = defaultdict(float)
    covered = np.zeros(len(units))
    for _ in range(rounds):
        config = knapsack(units, weight / need, capacity)
        if not config:
            break
        ids, copies = np.array(list(config)), np.array(list(config.values()))
        much = step * (need[ids] / copies).min()
        found[tuple(sorted(config.items()))] += much
        covered[ids] += much * copies
        weight[ids] *= np.exp(-much * copies / need[ids])
        weight /= weight.max()
    if not found:
        return []
    scale = (need * units).sum() / (covered * units).sum()
    return [(dict(k), v * scale) for k, v in found.items()]


class Sequences:
    """Sequences in ranges of equal contents, by free space, and where ranks of each length go."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left, self.next_rank, self.capacity = dict(histogram), defaultdict(int), capacity
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.count = 0
        #: length, first rank, ranks, first sequence, offset
        self.placed: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, much: int, first: int, free: int) -> None:
        self.placed.append((length, self.next_rank[length], much, first, self.capacity - free))
        self.next_rank[length] += much
        self.left[length] -= much
        if not self.left[length]:
            del self.left[length]

    def fill(self, config: list[tuple[list[int], int]], much: int) -> None:
        """``much`` new sequences; config: the lengths (longest first) and copies of each class."""
        ranges = [(self.count, much, self.capacity)]
        self.count += much
        for lengths, copies in config:
            for _ in range(copies):
                after = []
                for first, n, free in ranges:
                    while n:
                        length = next((x for x in lengths if x in self.left), None)
                        if length is None:
                            after.append((first, n, free))
                            break
                        m = min(n, self.left[length])
                        self.put(length, m, first, free)
                        after.append((first, m, free - length))
                        first, n = first + m, n - m
                ranges = after
        for first, n, free in ranges:
            self.free[free].append((first, n))

    def best_fit(self) -> None:
        """The rest in falling order of length, into the least space that is enough."""
        spaces = sorted(f for f, r in self.free.items() if r)
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                i = bisect.bisect_left(spaces, length)
                if i == len(spaces):
                    each = self.capacity // length
                    new = max(1, self.left[length] // each)
                    self.free[self.capacity].append((self.count, new))
                    self.count += new
                    bisect.insort(spaces, self.capacity)
                    i = bisect.bisect_left(spaces, self.capacity)
                space = spaces[i]
                first, n = self.free[space].pop()
                m = min(n, self.left[length])
                if n > m:
                    self.free[space].append((first + m, n - m))
                if not self.free[space]:
                    spaces.pop(i)
                self.put(length, m, first, space)
                rest = space - length
                if not self.free[rest]:
                    bisect.insort(spaces, rest)
                self.free[rest].append((first, m))


def plan(histogram: dict[int, int], config: PackConfig = PackConfig()) -> Sequences:
    cap = config.capacity
    out = Sequences(histogram, cap)
    if cap in histogram:
        out.fill([([cap], 1)], histogram[cap])
    unit = max(1, cap // config.classes)
    groups: dict[int, list[int]] = defaultdict(list)
    for length in sorted((x for x in histogram if config.small <= x < cap), reverse=True):
        groups[-(-length // unit)].append(length)
    units = np.array(sorted(groups))
    if len(units):
        need = np.array([float(sum(histogram[x] for x in groups[u])) for u in units.tolist()])
        solved = configuration_program(units, need, cap // unit, config.rounds, config.step)
        for found, much in sorted(solved, key=lambda x: -x[1]):
            classes = sorted(((int(units[k]), copies) for k, copies in found.items()), reverse=True)
            classes = [*classes[:-1], (classes[-1][0], classes[-1][1] - 1)] if config.open_end else classes
            classes = [c for c in classes if c[1]]
            if not classes:
                continue
            most = min(sum(out.left.get(x, 0) for x in groups[u]) // copies for u, copies in classes)
            if whole := min(int(much * config.share), most):
                out.fill([(groups[u], copies) for u, copies in classes], whole)
    out.best_fit()
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", config: PackConfig = PackConfig()) -> DataFrame:
    """One row for each piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` (if asked for), ``sequence_id``, ``offset``."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    pieces = save(source.mapInArrow(_pieces(config), f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long, ids binary"), "op6-pieces")
    counts = save(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c")), "op6-counts")
    planned = plan({r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}, config)
    placed = np.array(sorted(planned.placed), np.int64).reshape(-1, 5)
    keys = (placed[:, 0] << 48) + placed[:, 1]
    w = Window.partitionBy("length").orderBy("part")
    base = counts.select("part", "length", (F.sum("c").over(w) - F.col("c")).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << 48) + rank, "right") - 1
            cols = [b.column(c) for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(placed[at, 3] + rank - placed[at, 1]), pa.array(placed[at, 4])], [*[c for c in b.schema.names if c != "rank"], "sequence_id", "offset"])

    extra = ["ids"] if config.with_ids else []
    ranked = pieces.join(base, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", *extra, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if extra else ''}sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 4096 tokens."""
    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
