"""Near-duplicate grouping with SuperMinHash signatures.

1. A text's set holds the hashes (64 bits) of its distinct ``shingle``-word shingles.
   SuperMinHash gives each element a random permutation of the signature's slots: its
   j-th slot gets the rank j plus a fraction, and a slot keeps its least value. Ranks of
   one element are without replacement, which lowers the variance, and a text is done
   with the first rank after which every slot is filled with lower ones. Long texts end
   after one or two of 96 ranks.
2. Texts with equal sets are one class; only its smallest id goes on, so any number of
   copies costs one row.
3. Signatures are cut into bands of ``rows`` slots. At the threshold of 0.8 a linked
   pair shares none of 24 bands of 4 with probability 3e-6.
4. Shingles that no other candidate holds can't be shared, so they bound the similarity
   of every pair of their text: texts that can't reach the threshold with anyone, and
   pairs that can't with each other, are left out without loss. A bitmap of the
   candidates' hashed ids keeps most other texts out of the shuffle that fetches them.
5. In each band's bucket, all meet the text with the smallest share of such shingles (of
   edited copies, the original); these pairs are verified on their full sets. Links are
   closed to components. Only buckets that still hold several components go on; they
   are cut into blocks of ``block`` texts, and each pair of blocks is compared at once by
   a product of incidence matrices on the full sets. A component as large as a block has
   blocks of its own, which aren't compared with each other: a bucket of N texts costs
   N times the number of texts outside its great components. Links are all that comes
   out, a task holds two blocks, and no link is lost.
6. Components by alternating stars: rounds of joins on links, each written to the shared
   folder, until nothing changes; the distributed form of union-find with the smallest
   id as root. Nothing is collected.

Null, empty and blank texts have an empty set, are linked with nothing and stay. Rows
that share an id are linked like any equal ids: they are one document. Rows with a null
id are alone and stay, with a null component. Ids may have any type that has an order.
Very long texts are read whole; a set is one row. Only the id and text columns are used,
so extra columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batched, mix, save, slices, table


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 24
    rows: int = 4
    #: Texts on one side of a block when the rest of a bucket is compared.
    block: int = 1024


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of the bitmap of candidates' ids: 4 MB.
BITS = 1 << 25


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words, with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = xxhash.xxh3_64_intdigest
    h = np.fromiter((each(w) for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(size, len(words))))
    for o in range(min(size, len(words))):
        out = mix(out * _ODD + h[o : o + n])
    return np.unique(out)


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of sets that lie end to end in ``elements``; sets are not empty."""
    sig = np.full((len(counts), slots), np.inf)
    owner = np.repeat(np.arange(len(counts)), counts)
    perm = None
    for j in range(slots):
        with np.errstate(over="ignore"):
            draw = mix(elements + np.uint64(j + 1) * _ODD)
        rank = j + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = j + (mix(draw) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            row = np.arange(len(elements))
            slot = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, j]
        np.minimum.at(sig.reshape(-1), owner * slots + slot, rank)
        go = (sig.max(1) > j + 1)[owner]
        if not go.any():
            break
        if j == 0:
            elements, owner, pick = elements[go], owner[go], pick[go]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
            perm[np.arange(len(elements)), pick] = 0
        elif not go.all():
            elements, owner, perm = elements[go], owner[go], perm[go]
    return sig


def _signature_work(config: NearConfig):
    slots = config.bands * config.rows

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, config.shingle) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        bands = np.zeros((len(sets), config.bands), np.uint64)
        lo = hi = np.zeros(0, np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            flat, counts = np.concatenate([sets[i] for i in full]), sizes[full]
            begin = np.cumsum(counts) - counts
            with np.errstate(over="ignore"):
                lo, hi = np.add.reduceat(mix(flat), begin), np.add.reduceat(mix(flat ^ _ODD), begin)
            sig = np.concatenate([superminhash(flat[begin[a] : begin[b - 1] + counts[b - 1]], counts[a:b], slots) for a, b in slices(counts.tolist(), 100_000)])
            bits = sig.view(np.uint64).reshape(len(full), config.bands, config.rows)
            h = np.broadcast_to(np.arange(1, config.bands + 1, dtype=np.uint64), bits.shape[:2])
            for r in range(config.rows):
                h = mix(h * _ODD + bits[:, :, r])
            bands[full] = h
        low, high = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        low[full], high[full] = lo, hi
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * config.bands
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))],
            ["id", "size", "lo", "hi", "bands"],
        )

    return work


def _sets_work(size: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    return work


def cell_links(ids: list, roots: list, items: list[np.ndarray], percent: int) -> list[tuple]:
    """Linked pairs with different roots among a block of sets, from products of their incidence matrices."""
    if len(set(roots)) < 2:
        return []
    sizes = np.array([len(x) for x in items])
    _, inverse, counts = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    held = counts[inverse] > 1
    owner, column = np.repeat(np.arange(len(ids)), sizes)[held], column[inverse][held]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(ids), 4096), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    r, n = (np.unique(np.array(x), return_inverse=True)[1] for x in (roots, ids))
    good = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (r[:, None] != r) & (n[:, None] < n)
    return [(ids[x], ids[y]) for x, y in zip(*np.nonzero(good), strict=True)]


def _cell_links(percent: int):
    """Streams rows sorted by cell and emits the links of each cell."""

    def run(batches):
        key, ids, roots, items = None, [], [], []
        for batch in batches:
            lists = batch.column("items")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            found = []
            for n, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("band", "i", "j", "id", "root")], strict=True)):
                if row[:3] != key:
                    found += cell_links(ids, roots, items, percent) if ids else []
                    key, ids, roots, items = row[:3], [], [], []
                ids.append(row[3])
                roots.append(row[4])
                items.append(values[offsets[n] : offsets[n + 1]].copy())
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["a", "b"])
        if ids:
            found = cell_links(ids, roots, items, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["a", "b"])

    return run


def components(links: DataFrame, tag: str) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every id in ``links`` (a, b) that isn't a root itself."""
    edges = save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-links")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = save(small, f"{tag}-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")


def block_pairs(grouped: DataFrame, block: int) -> DataFrame:
    """``band``, ``i``, ``j``, ``id`` and ``root``: each text once for every pair of blocks that it is compared in.

    A band's blocks are numbered from 0: first those of texts in small components, mixed by
    hash, then those of each component of ``block`` texts or more. Two blocks of one
    such component, or one with itself, are no pair.
    """
    sizes = grouped.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c")).withColumn("own", F.when(F.col("c") >= block, F.ceil(F.col("c") / block)).cast("int"))
    bands = sizes.groupBy("band").agg(F.ceil(F.sum(F.when(F.col("own").isNull(), F.col("c")).otherwise(0)) / block).cast("int").alias("mixed"), F.coalesce(F.sum("own"), F.lit(0)).cast("int").alias("rest"))
    order = Window.partitionBy("band").orderBy("root")
    great = sizes.filter("own IS NOT NULL").select("band", "root", "own", (F.sum("own").over(order) - F.col("own")).cast("int").alias("before"))
    placed = grouped.select("band", "id", "root").join(bands, "band").join(great, ["band", "root"], "left").withColumn("first", F.col("mixed") + F.col("before"))
    hashed = F.xxhash64("id")
    placed = placed.withColumn("at", F.coalesce(F.col("first") + F.pmod(hashed, F.col("own")), F.pmod(hashed, F.greatest("mixed", F.lit(1)))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("mixed") + F.col("rest") - 1), lambda y: F.col("own").isNull() | (y < F.col("first")) | (y >= F.col("first") + F.col("own")))
    met = placed.select("band", "id", "root", "at", F.explode(others).alias("with"))
    return met.select("band", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "id", "root")


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id has its bit set in a bitmap of the hashes of ``wanted`` ids: all those, and a few more.

    The broadcast bitmap has ``BITS`` bits at any size of the input; what a crowded one lets
    through is left to the join that follows.
    """
    spot, size = F.pmod(F.xxhash64("id"), F.lit(BITS)), 32768
    bucket, at = (spot / size).cast("int"), (spot % size).cast("int")
    bits = wanted.select(bucket.alias("bucket"), at.cast("long").alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket").filter(F.getbit(byte, at % 8) == 1).select(rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", config: NearConfig = NearConfig()) -> DataFrame:
    """``id``, ``size`` (of the set) and ``component`` of each input row."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = save(source.mapInArrow(batched(_signature_work(config)), f"id {kind}, size long, lo long, hi long, bands array<long>"), "op3-signatures")
    known = signed.filter("id IS NOT NULL AND size > 0")
    key = ["size", "lo", "hi"]
    heads = known.groupBy(*key).agg(F.min_by(F.struct("id", "bands"), "id").alias("head"))
    heads = save(heads.select(*key, "head.*"), "op3-classes")
    rows = heads.select(F.explode("bands").alias("band"), "id", "size")
    # What is counted by key is written first: a join of two plain shuffles can be split where a key is hot.
    shared = save(rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band"), "op3-shared")
    buckets = save(rows.join(shared, "band", "left_semi"), "op3-buckets")
    wanted = save(buckets.select("id").distinct(), "op3-wanted")
    # Not a semi-join, which the optimizer would move before the bitmap.
    sets = save(likely(source, wanted).join(wanted, "id").mapInArrow(batched(_sets_work(config.shingle)), f"id {kind}, items array<long>"), "op3-sets")
    lone = sets.select("id", F.explode("items").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1")
    lone = save(lone.groupBy("id").agg(F.count(F.lit(1)).alias("lone")), "op3-lone")
    p = config.percent

    def verified(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        b = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        common = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
        return common.filter(100 * F.col("both") >= p * (F.col("sum") - F.col("both"))).select("a", "b")

    def can(size_a: str, own_a: str, size_b: str, own_b: str):
        return F.expr(f"100 * least({own_a}, {own_b}) >= {p} * ({size_a} + {size_b} - least({own_a}, {own_b}))")

    owned = buckets.join(lone, "id", "left").select("band", "id", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("own"))
    owned = save(owned.filter(can("size", "own", "own", "own")), "op3-owned")
    pivot = owned.groupBy("band").agg(F.min(F.struct((1 - F.col("own") / F.col("size")).alias("rate"), F.col("id").alias("pivot"), F.col("size").alias("n"), F.col("own").alias("m"))).alias("p")).select("band", "p.pivot", "p.n", "p.m")
    pivot = save(pivot, "op3-pivots")
    first = owned.join(pivot, "band").filter("id <> pivot").filter(can("size", "own", "n", "m")).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = save(verified(first), "op3-first")
    roots = components(links, "op3-a")
    grouped = owned.join(roots, "id", "left").select("band", "id", "size", "own", F.coalesce("root", "id").alias("root"))
    open_ = save(grouped.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("band"), "op3-several")
    grouped = save(grouped.join(open_, "band", "left_semi"), "op3-open")
    cells = block_pairs(grouped, config.block)
    cells = cells.join(sets, "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    second = save(cells.select("band", "i", "j", "id", "root", "items").mapInArrow(_cell_links(p), f"a {kind}, b {kind}").distinct(), "op3-second")
    if not second.isEmpty():
        roots = components(links.union(second), "op3-b")
    classes = heads.join(roots, "id", "left").select(*key, F.coalesce("root", "id").alias("component"))
    joined = signed.select("id", *key).join(classes, key, "left")
    alone = F.col("id").isNull() | (F.col("size") == 0)
    return joined.select("id", "size", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under two-word shingles and a similarity of 0.8 or more."""
    out = near_duplicates(table(spark, sf_dir, "documents"), config=NearConfig(shingle=2))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


#: All pairs that share a shingle, counted in full; components by closing the links.
OP3_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS items FROM d
), e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS k
  FROM e x JOIN e y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (m + n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, CAST(least(s.doc_id, coalesce(l.b, s.doc_id)) AS BIGINT) AS component_id, least(s.doc_id, coalesce(l.b, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN least_id l ON l.a = s.doc_id
"""
