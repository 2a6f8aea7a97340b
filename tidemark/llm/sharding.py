"""Sharding by balanced label propagation, with DataFrame functions only.

Documents with equal texts are linked. The law is ``bytes``: shards of near equal size,
a document's size being its text's UTF-8 bytes plus 1, with few links between shards.

1. Documents of one text are dealt by the hash of their id over ``parts`` cells, and
   cells start in shards by hash. Cells are the nodes, so a text that a third of all
   rows hold is ``parts`` nodes and not one.
2. Each round, the cells of a text vote with their bytes; the rest want to move to the
   shard with the most. A shard admits movers, in hashed order, up to its quota: an even
   share less what it holds. Rounds end when nobody can move, or after ``rounds``, as
   the next step places all that is left. Loads by shard, and by shard and hash bucket,
   are all that comes to the driver: at most 16 and 16 * 1024 rows.
3. Texts whose cells are still in several shards, or beyond an even share, are placed
   whole: the few large ones each in the shard with most room, the others in hashed order
   up to where the shards' remaining shares end. Only a text that fits in no shard stays
   split. A text placed last in a shard may exceed its share, by 1/``large`` of it at most.
4. Unlinked documents, and cells of texts that stay split beyond an even share, fill the
   shards: put in hashed order, they are cut where the shards' remaining shares end. So
   each shard's size is within one document of an even share if these suffice.
5. Slots are counted by shard and hash bucket, then within it, so no task holds a shard.
   A shard has as many buckets as its own rows ask for.

A null text counts as empty. Rows with equal or null ids are kept, each with its slot; a
text of any length is one row. Only the id and text columns are used, so extra columns
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save, table

_GROUP = ["g1", "g2", "size"]


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 16
    parts: int = 64
    rounds: int = 8
    buckets: int = 1024
    #: A text over this part of an even share is placed on the driver: at most shards * large of them.
    large: int = 64
    rows_per_bucket: int = 2000
    #: Rows of a shard that one window numbers.
    slots_per_bucket: int = 256
    most_buckets: int = 65536


def _bucket(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _within(load: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """For each shard the first bucket whose bytes, with those before it, exceed the room; buckets below it fit."""
    out = []
    for s, most in enumerate(room):
        own = sorted((b, v) for (t, b), v in load.items() if t == s)
        sums = accumulate(v for _, v in own)
        out.append(next((b for (b, _), total in zip(own, sums, strict=True) if total > most), 1 << 30))
    return out


def _of(values: list[int], index: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(index))


def propagate(cells: DataFrame, share: int, config: ShardConfig) -> DataFrame:
    """Move the linked cells (group, part, bytes, label, bucket) until quotas or votes stop them."""
    for _ in range(config.rounds):
        held = {r["label"]: r["b"] for r in cells.groupBy("label").agg(F.sum("bytes").alias("b")).collect()}
        votes = cells.groupBy(*_GROUP, "label").agg(F.sum("bytes").alias("v"))
        best = votes.groupBy(*_GROUP).agg(F.max(F.struct("v", F.xxhash64(*_GROUP, "label").alias("tie"), "label")).alias("best"))
        wish = save(cells.join(best.select(*_GROUP, F.col("best.label").alias("goal")), _GROUP), "op10-wishes")
        asked = {(r["goal"], r["bucket"]): r["b"] for r in wish.filter("goal <> label").groupBy("goal", "bucket").agg(F.sum("bytes").alias("b")).collect()}
        if not asked:
            break
        stop = _within(asked, [share - held.get(s, 0) for s in range(config.shards)])
        if not any(b < stop[s] for s, b in asked):
            break
        cells = wish.withColumn("label", F.when(F.col("bucket") < _of(stop, "goal"), F.col("goal")).otherwise(F.col("label"))).drop("goal")
    return save(cells, "op10-cells")


def _before(df: DataFrame, size: str, *order: str) -> DataFrame:
    """Add ``at``: the sum of ``size`` over the rows before, by bucket and then in order."""
    sums = df.groupBy("bucket").agg(F.sum(size).alias("b"))
    base = sums.select("bucket", (F.sum("b").over(Window.orderBy("bucket")) - F.col("b")).alias("base"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before).join(F.broadcast(base), "bucket").withColumn("at", F.col("base") + F.col("before")).drop("base", "before")


def _shard_at(room: list[int]) -> Column:
    """The shard in whose room ``at`` falls."""
    return F.least(sum((F.when(F.col("at") >= F.lit(e), 1).otherwise(0) for e in accumulate(room)), F.lit(0)), F.lit(len(room) - 1))


def gather(cells: DataFrame, share: int, config: ShardConfig) -> tuple[DataFrame, list[int]]:
    """Cells (group, part, label) with no text split that fits in a shard, and the shards' room; a null label is to be filled in."""
    load = {(r["label"], r["bucket"]): r["b"] for r in cells.groupBy("label", "bucket").agg(F.sum("bytes").alias("b")).collect()}
    stop = _within(load, [share] * config.shards)
    cells = cells.withColumn("label", F.when(F.col("bucket") < _of(stop, "label"), F.col("label")))
    per = cells.groupBy(*_GROUP).agg(F.sum("bytes").alias("b"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("label").isNull()).alias("out"))
    loose = save(per.filter("out OR lo <> hi").select(*_GROUP, "b"), "op10-loose")
    held = cells.join(loose.select(*_GROUP, "b"), _GROUP, "left").groupBy("label").agg(F.sum(F.when(F.col("b").isNull(), F.col("bytes"))).alias("whole")).filter("label IS NOT NULL").collect()
    room = [share - {r["label"]: r["whole"] or 0 for r in held}.get(s, 0) for s in range(config.shards)]
    big = sorted(loose.filter(F.col("b") * config.large > share).collect(), key=lambda r: (-r["b"], *[r[c] for c in _GROUP]))
    own, torn = [], []
    for r in big:
        s = max(range(config.shards), key=lambda s: room[s])
        if r["b"] <= room[s]:
            room[s] -= r["b"]
            own.append((*[r[c] for c in _GROUP], s))
        else:
            torn.append(tuple(r[c] for c in _GROUP))
    spark, kinds = cells.sparkSession, "g1 long, g2 int, size long"
    small = loose.filter(F.col("b") * config.large <= share)
    count = max(1, min(config.most_buckets, -(-small.count() // config.rows_per_bucket)))
    small = _before(small.withColumn("bucket", _bucket(count, *_GROUP)), "b", *_GROUP).withColumn("home", _shard_at([max(0, x) for x in room]))
    small = save(small.select(*_GROUP, "b", F.col("home").cast("int").alias("home")), "op10-small")
    for r in small.groupBy("home").agg(F.sum("b").alias("b")).collect():
        room[r["home"]] -= r["b"]
    homes = small.drop("b").unionByName(spark.createDataFrame(own, f"{kinds}, home int")).withColumn("torn", F.lit(False))
    homes = homes.unionByName(spark.createDataFrame([(*t, None, True) for t in torn], f"{kinds}, home int, torn boolean"))
    cells = save(cells.join(homes, _GROUP, "left").withColumn("label", F.coalesce("home", "label")), "op10-gathered")
    if torn:
        load = {(r["label"], r["bucket"]): r["b"] for r in cells.filter("torn AND label IS NOT NULL").groupBy("label", "bucket").agg(F.sum("bytes").alias("b")).collect()}
        stop = _within(load, [max(0, x) for x in room])
        for (t, k), v in load.items():
            room[t] -= v if k < stop[t] else 0
        cells = cells.withColumn("label", F.when(F.coalesce("torn", F.lit(False)) & (F.col("bucket") >= _of(stop, "label")), F.lit(None)).otherwise(F.col("label")))
    return cells.select(*_GROUP, "part", "label"), [max(0, x) for x in room]


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", config: ShardConfig = ShardConfig()) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of each input row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("g1"), F.hash(body).alias("g2"))
    rows = save(rows.withColumn("part", _bucket(config.parts, "id")), "op10-rows")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    share = -(-(total or 0) // config.shards)
    cells = rows.groupBy(*_GROUP, "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("c"))
    linked = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_GROUP)
    cells = cells.join(linked, _GROUP).select(*_GROUP, "part", "bytes", _bucket(config.shards, *_GROUP, "part").alias("label"), _bucket(config.buckets, "part", *_GROUP).alias("bucket"))
    cells = propagate(save(cells, "op10-start"), share, config)
    cells, room = gather(cells, share, config)
    buckets = max(1, min(config.most_buckets, -(-n // config.rows_per_bucket)))
    known = save(rows.join(cells, [*_GROUP, "part"], "left").select("id", "size", "text_crc32", "g1", "label", _bucket(buckets, "id", "g1").alias("bucket")), "op10-known")
    fill = known.filter("label IS NULL")
    placed = _before(fill, "size", "g1", "id").withColumn("shard", _shard_at(room))
    cols = ["id", "size", "text_crc32"]
    final = known.filter("label IS NOT NULL").select(*cols, F.col("label").alias("shard")).unionByName(placed.select(*cols, "shard"))
    final = save(final, "op10-shards")
    per_shard = {r["shard"]: r["c"] for r in final.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    cuts = [max(1, min(config.most_buckets, -(-per_shard.get(s, 0) // config.slots_per_bucket))) for s in range(config.shards)]
    final = final.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), _of(cuts, "shard")))
    counts = final.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("c"))
    start = counts.select("shard", "bucket", (F.sum("c").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("c")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32")) - 1
    out = final.withColumn("nth", nth).join(start, ["shard", "bucket"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 16 shards of near equal bytes, equal texts together."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
