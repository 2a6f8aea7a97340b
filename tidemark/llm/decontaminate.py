"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

1. Items and texts are read as words. An item's windows are its runs of ``window``
   consecutive words; an item of fewer is one window.
2. The items' words are counted over all texts, and each window's words ordered by
   rarity. A text that holds all of a window holds any of its words, so the prefix that
   has to be joined is a window's rarest word; its second rarest, at a fixed distance, is
   the first bound. A window with a word that no text has can't occur.
3. Texts' words join the prefix words where they are read. The word's place says where the
   window would start. Starts and ends outside the text (positional and length bound)
   and places without the second word are dropped.
4. What is left is compared word by word with the text: containment is exact. All this
   happens in the task that reads the text, so only verified occurrences are shuffled.
5. A text's hit words are the union of its verified windows.

The tables of items' words and of prefix words grow with the benchmark only. They are
broadcast in blocks of about ``block_bytes``, each with a pass over the texts, so a
benchmark of any size fits in memory. Occurrences are gathered by text, of which they are
at most one for each word and window length.

A null text has no words and is clean; an item without words has no window. Repeated
items count as one by their id; equal windows of several items count for each. An item
without an id hits words and is in no list of ids. Rows equal in id and text get the same
answer, also where the id is null; rows are told apart by id and 64 hashed bits of
the text. Ids may have any type. Extra columns are carried in ``row``, so none clashes.
Very long texts cost in proportion. Empty tables give clean texts or an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table

_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class LeakConfig:
    window: int = 10
    #: Bytes of words in a block that is broadcast.
    block_bytes: int = 16_000_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; lower() does that where all letters are ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _GAPS), "")


def windows(items: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """``item``, ``w`` (the window's words) and ``n`` of each distinct window of each item."""
    got = items.select(F.col(f"`{id_col}`").alias("item"), words(F.col(f"`{text}`")).alias("all")).filter(F.size("all") > 0)
    every = F.when(F.size("all") < size, F.array("all")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))), lambda i: F.slice("all", i, size)))
    return got.select("item", F.explode(every).alias("w")).distinct().withColumn("n", F.size("w"))


def _blocks(small: DataFrame, size: Column, most: int) -> list[DataFrame]:
    """Parts of a table of about ``most`` bytes each, to be broadcast one at a time."""
    total = small.agg(F.sum(size)).first()[0] or 0
    n = -(-total // most)
    if n <= 1:
        return [F.broadcast(small)]
    return [F.broadcast(small.filter(F.pmod(F.xxhash64(*small.columns), F.lit(n)) == i)) for i in range(n)]


def occurrences(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text", config: LeakConfig = LeakConfig()) -> DataFrame:
    """``_id``, ``_th``, ``start`` and ``w`` of each place in each row where a window of ``found`` occurs."""
    body = F.col(f"`{text}`")
    unique = found.select("w", "n").distinct()
    vocabulary = save(unique.select(F.explode("w").alias("word")).distinct(), "op7-words")
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(body).alias("_th"), words(body).alias("_words"))
    # The outer form adds no filter that would split the text a second time.
    spread = read.select("_id", "_th", "_words", F.posexplode_outer("_words").alias("pos", "word"))
    met = [spread.select("word").join(v, "word", "left_semi") for v in _blocks(vocabulary, F.octet_length("word") + 8, config.block_bytes)]
    counts = save(reduce(DataFrame.unionAll, met).groupBy("word").agg(F.count(F.lit(1)).alias("c")), "op7-counts")
    ranked = unique.select("w", "n", F.posexplode("w").alias("at", "word")).join(counts, "word")
    order = F.sort_array(F.collect_list(F.struct("c", "word", "at")))
    prefix = ranked.groupBy("w", "n").agg(order.alias("p")).filter(F.size("p") == F.col("n"))
    first, second = F.col("p")[0], F.get("p", F.least(F.lit(1), F.col("n") - 1))
    prefix = save(prefix.select("w", "n", first["word"].alias("word"), first["at"].alias("at"), second["word"].alias("word2"), second["at"].alias("at2")), "op7-prefix")
    start = F.col("pos") - F.col("at")
    bound = (start >= 0) & (start + F.col("n") <= F.size("_words")) & (F.get("_words", start + F.col("at2")) == F.col("word2"))
    same = F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("w")
    size = F.octet_length(F.array_join("w", " ")) + F.octet_length("word") + F.octet_length("word2") + 16
    return reduce(DataFrame.unionAll, [spread.join(p, "word").filter(bound & same).select("_id", "_th", start.alias("start"), "w") for p in _blocks(prefix, size, config.block_bytes)])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & a["_th"].eqNullSafe(b["_th"])


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", config: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows whose text holds no window of any item."""
    found = save(windows(items, item_id, item_text, config.window), "op7-windows")
    leaks = save(occurrences(docs, found, id_col, text, config).select("_id", "_th").distinct(), "op7-leaks")
    keyed = docs.withColumns({"_id": F.col(f"`{id_col}`"), "_th": F.xxhash64(F.col(f"`{text}`"))})
    return keyed.join(leaks, _same(keyed, leaks), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", config: LeakConfig = LeakConfig()) -> DataFrame:
    """``row`` (the other columns), ``n_words``, ``n_hit``, ``hits`` (start and window of each occurrence) and ``items`` (sorted ids as text) of each input row."""
    body = F.col(f"`{text}`")
    found = save(windows(items, item_id, item_text, config.window), "op7-windows")
    met = save(occurrences(docs, found, id_col, text, config), "op7-occurrences")
    reach = F.flatten(F.transform("hits", lambda m: F.sequence(m["start"], m["start"] + F.size(m["w"]) - 1)))
    hits = met.groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "w")).alias("hits")).select("_id", "_th", "hits", F.size(F.array_distinct(reach)).cast("long").alias("hit"))
    ids = met.select("_id", "_th", "w").distinct().join(found, "w").groupBy("_id", "_th").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_text = save(hits.join(ids, _same(hits, ids)).select(hits["_id"], hits["_th"], "hits", "hit", "items"), "op7-texts")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    rows = docs.select(others, F.col(f"`{id_col}`").alias("_id"), F.xxhash64(body).alias("_th"), F.size(words(body)).cast("long").alias("n_words"))
    none = lambda c: F.array().cast(per_text.schema[c].dataType)
    return rows.join(per_text, _same(rows, per_text), "left").select("row", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hits", none("hits")).alias("hits"), F.coalesce("items", none("items")).alias("items"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside windows of ``benchmark`` items."""
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Counted over the whole tables by window, without a prefix filter.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, sizes WHERE len(words) >= n)
), occ AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON win.w = g.w AND win.n = g.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM occ), unnest(generate_series(i, i + n - 1)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
