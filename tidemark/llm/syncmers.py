"""Document fingerprints from closed syncmers, with DataFrame functions only.

1. A text's tokens are its words (split at white space); a stretch of more than
   ``longest`` characters without white space is read character by character, so texts
   without blanks have tokens that an edit leaves in place, too. Single characters of all texts would cost several
   times the arrays that words do, in functions that run element by element.
2. The token sequence is closed with ``k - 1`` end marks on both sides. A k-mer is ``k``
   consecutive tokens; its inner substrings are pairs of tokens. It is a closed syncmer
   if its smallest hashed pair is the first or the last one, which depends on nothing
   outside the k-mer, so an edit changes only the anchors that it touches. Pairs of end
   marks count as greatest, so the first and the last k-mer are always chosen, and any text
   with a token has anchors. Of others about 2 of every ``k - 1`` are chosen.
3. A fingerprint is the list of all anchors with their places: a long whose upper half
   holds the k-mer's hash (31 bits) and whose lower half the place of its first token,
   counted from the first end mark.
4. ``likeness`` is the Jaccard similarity of two texts' anchors, exact on all of them.
   ``passages`` matches places: anchors that both texts hold equally far apart.

Equal texts have equal fingerprints. A null text is empty, and an empty or blank text has
no anchor: it is like another such (1) and unlike the rest (0). Fingerprints of very long
texts grow with them. Input columns come back in the struct ``row``, so none clashes.
Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

_SPACE = "[\\x20\\x09-\\x0D]+"
_SOLID = "[^\\x20\\x09-\\x0D]"
_END, _GREATEST = 0, (1 << 63) - 1


@dataclass(frozen=True)
class SyncmerConfig:
    k: int = 6
    #: Characters of a word; longer stretches are read by character.
    longest: int = 32
    #: Documents in one window partition when pairing neighbours, and the most partitions.
    rows_per_bucket: int = 1024
    most_buckets: int = 65536
    #: Sampled ids for each bound between partitions.
    oversample: int = 8


def _tokens(text: Column, longest: int) -> Column:
    inside = f"((?<={_SOLID}{{{longest}}})(?={_SOLID})|(?<={_SOLID})(?={_SOLID}{{{longest}}}))(?![\\uDC00-\\uDFFF])"
    spread = F.when(text.rlike(f"{_SOLID}{{{longest + 1}}}"), F.regexp_replace(text, inside, " ")).otherwise(text)
    return F.array_remove(F.split(spread, _SPACE), "")


def fingerprints(docs: DataFrame, text: str = "text", config: SyncmerConfig = SyncmerConfig()) -> DataFrame:
    """``row`` (the input's columns) and ``anchors`` (hash and place, in order) of each input row."""
    k = config.k
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ends = F.array_repeat(F.lit(_END).cast("long"), k - 1)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.transform(_tokens(body, config.longest), lambda w: F.xxhash64(w)).alias("tokens"))
    df = df.select("row", F.concat(ends, "tokens", ends).alias("tokens"))
    pair = lambda a, b: F.when((a == _END) & (b == _END), F.lit(_GREATEST)).otherwise(F.xxhash64(a, b))
    df = df.select("row", F.transform(F.sequence(F.lit(0), F.size("tokens") - 2), lambda i: pair(F.get("tokens", i), F.get("tokens", i + 1))).alias("pairs"))
    at = lambda i, o: F.get("pairs", i + o)

    def chosen(i: Column) -> Column:
        low = F.least(*[at(i, o) for o in range(k - 1)])
        code = F.shiftrightunsigned(F.xxhash64(*[at(i, o) for o in dict.fromkeys([*range(0, k - 1, 2), k - 2])]), 33)
        return F.when((low < _GREATEST) & ((low == at(i, 0)) | (low == at(i, k - 2))), F.shiftleft(code, 32).bitwiseOR(i.cast("long")))

    every = F.transform(F.sequence(F.lit(0), F.size("pairs") - (k - 1)), chosen)
    return df.select("row", F.filter(every, lambda x: x.isNotNull()).alias("anchors"))


def hashes(anchors: str | Column) -> Column:
    """The anchors' hashes without their places."""
    return F.transform(anchors, lambda x: F.shiftrightunsigned(x, 32))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity, 0 to 1, of two columns of anchors."""
    union = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(hashes(a), hashes(b))) / union)


def passages(pairs: DataFrame, key: str, a: str, b: str, config: SyncmerConfig = SyncmerConfig()) -> DataFrame:
    """Places that two texts share: ``key``, ``shift``, ``n`` (anchors), ``start`` and ``end`` (tokens of the first text).

    pairs: one row for each pair of texts, with an unique ``key`` and two columns of
    anchors. Anchors are matched at their first place in each text, so a repetitive text
    costs no more than another; those whose places differ by the same ``shift`` are one passage.
    """

    def first(c: str) -> DataFrame:
        each = pairs.select(F.col(f"`{key}`").alias("key"), F.explode_outer(f"`{c}`").alias("x"))
        return each.groupBy("key", F.shiftrightunsigned("x", 32).alias("anchor")).agg((F.min(F.col("x").bitwiseAND(F.lit((1 << 32) - 1))) - (config.k - 1)).alias(f"at_{c}"))

    met = first(a).join(first(b), ["key", "anchor"])
    return met.groupBy("key", (F.col(f"`at_{b}`") - F.col(f"`at_{a}`")).alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.min(f"`at_{a}`"), F.lit(0)).alias("start"), (F.max(f"`at_{a}`") + config.k).alias("end"))


def with_next(docs: DataFrame, id_col: str = "doc_id", config: SyncmerConfig = SyncmerConfig()) -> DataFrame:
    """``row`` (the input's columns) and ``next``: the row with the next smaller id, for the last one the first.

    Ids are cut into buckets of similar row counts by a sample of them, which comes to the
    driver sorted (``oversample`` * ``most_buckets`` ids at most). Each bucket also gets a
    copy of the greatest row below it, so the order needs one shuffle and no single task.
    Ids may have any type that has an order and a JSON form. Null ids count as smallest;
    rows with one id follow the order of their hashed columns.
    """
    ident = F.col(f"`{id_col}`")
    kind = docs.schema[id_col].dataType.simpleString()
    n = docs.count()
    count = max(1, min(config.most_buckets, -(-n // config.rows_per_bucket)))
    share = int(min(1.0, count * config.oversample / max(n, 1)) * (1 << 40))
    sample = docs.filter(ident.isNotNull() & (F.pmod(F.xxhash64(F.lit(23), ident), F.lit(1 << 40)) < share)).select(ident.alias("i")).distinct() if count > 1 else None
    ids = sorted(r["i"] for r in sample.collect()) if sample is not None else []
    bounds = ids[config.oversample :: config.oversample]
    wide = max(1, math.isqrt(len(bounds)))
    steps = [bounds[i : i + wide] for i in range(0, len(bounds), wide)] or [[]]
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x, default=str)), kind)
    step = F.size(F.filter(constant([s[0] for s in steps[1:]], f"array<{kind}>"), lambda b: b <= F.col("id")))
    below = F.size(F.filter(F.get(constant(steps, f"array<array<{kind}>>"), F.col("step")), lambda b: b <= F.col("id")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("id"))
    cells = docs.select(ident.alias("id")).withColumn("step", step).select("id", (F.col("step") * wide + below).alias("place"))
    rows = rows.withColumn("step", step).select("row", "id", F.when(F.col("id").isNull(), -1).otherwise(F.col("step") * wide + below).alias("place"), F.lit(0).alias("ghost"))
    tops = cells.select("id", F.when(F.col("id").isNull(), -1).otherwise(F.col("place")).alias("place")).groupBy("place").agg(F.max("id").alias("top"))
    follow = tops.select("top", F.coalesce(F.lead("place").over(Window.orderBy("place")), F.min("place").over(Window.partitionBy())).alias("to"))
    ghosts = rows.join(F.broadcast(follow), F.col("id").eqNullSafe(F.col("top"))).select("row", "id", F.col("to").alias("place"), F.lit(1).alias("ghost"))
    w = Window.partitionBy("place").orderBy(F.col("ghost").desc(), F.col("id").asc_nulls_first(), F.xxhash64("row"))
    return rows.unionByName(ghosts).select("row", F.lag("row").over(w).alias("next"), "ghost").filter("ghost = 0").drop("ghost")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts, with their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = fingerprints(docs).select("row.doc_id", "row.text", "anchors")
    n = F.length("row.text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("row.text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut))
    both = with_next(own).select("row.doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("row.anchors").alias("own"), likeness("row.anchors", "next.anchors").alias("near_next"))
    out = fingerprints(both, "edited")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.shiftrightunsigned(x, 32).cast("string"), F.lit(":"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("string"))), " ")
    return out.select(
        "row.doc_id",
        "row.n_chars",
        F.sha2("row.edited", 256).alias("edited_sha256"),
        shown("row.own").alias("fingerprint"),
        shown("anchors").alias("edited_fingerprint"),
        likeness("row.own", "anchors").alias("near_edited"),
        "row.near_next",
    )
