"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from types import SimpleNamespace

import pytest

from tidemark.llm.common import work_root
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.language_id import ConvConfig, identify_language, train_language_model
from tidemark.llm.line_dedup import remove_shared_lines
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import PiiConfig, find_pii, train_tagger
from tidemark.llm.sharding import shard
from tidemark.llm.suffix_dedup import SuffixConfig, remove_repeats
from tidemark.llm.syncmers import fingerprints, likeness, with_next
from tidemark.llm.toxicity import find_toxic, train_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, h string, row string, kept string, label int, a int, words string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def row(i, text, lang="en"):
    return (i, text, lang, None, None, 0.5, 7, "x", "y", "z", 1, 2, "w")


ROWS = [
    row(1, "One two three four five six seven eight nine ten.\nmail me at a.b@c.example or +1 (425) 555-0735"),
    row(2, None),
    row(3, ""),
    row(4, " \n\t "),
    row(5, LONG),
    row(6, LONG),
    row(6, LONG),
    row(None, "One two three four five six seven eight nine ten.\nsomething else"),
    row(None, None, None),
    row(8, "éàü ñ 日本語 \x1c  𝄞", "de"),
    row(9, "$$$ 12 %%"),
    row(10, "x" * 50_000, None),
]

ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, "..."), (None, "lorem ipsum"), (1, "one two three four five six seven eight nine ten")]


@pytest.fixture(params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def ids(df, col):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select(col).collect())


def expected(docs):
    return ids(docs, "doc_id")


def test_language(docs):
    model = train_language_model(docs, config=ConvConfig(epochs=1))
    out = identify_language(docs, model)
    assert ids(out, "row.doc_id") == expected(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.select("row.doc_id", "lang_pred", "score").collect()}
    for i in (2, 3, 4, 9):
        assert got.get(i, ("und", 0.0)) == ("und", 0.0)
    assert identify_language(docs, None).filter("lang_pred <> 'und'").count() == 0


def test_suffix(docs):
    out = remove_repeats(docs, config=SuffixConfig(length=40))
    assert ids(out, "row.doc_id") == expected(docs)
    got = {r["doc_id"]: (r["n_bytes"], len(r["kept"])) for r in out.select("row.doc_id", "n_bytes", "kept").collect()}
    if got:
        assert got[6] == (len(LONG), 0) and got[2] == (0, 0) and got[3] == (0, 0) and got[10] == (50_000, 0)


def test_near(docs):
    out = near_duplicates(docs)
    assert ids(out, "id") == expected(docs)
    got = {r["id"]: r["component"] for r in out.collect()}
    if got:
        assert got[6] == 5 and got[2] == 2 and got[None] is None and got[10] == 10


def test_fingerprints(docs):
    out = with_next(fingerprints(docs).select("row.*", "anchors"))
    assert ids(out, "row.doc_id") == expected(docs)
    rows = out.collect()
    if rows:
        prints = {(r["row"]["doc_id"], r["row"]["text"]): r["row"]["anchors"] for r in rows}
        assert prints[2, None] == prints[3, ""] == prints[4, " \n\t "] == [] and all(p for (i, _), p in prints.items() if i in (1, 5, 6, 8, 9, 10))
        assert prints[5, LONG] == prints[6, LONG]
        assert {r["row"]["doc_id"]: r["next"]["text"] for r in rows}[10] == ROWS[10][1]
        near = out.select("row.doc_id", likeness("row.anchors", "next.anchors").alias("n")).collect()
        assert {r["doc_id"]: r["n"] for r in near}[3] == 1 and all(0 <= r["n"] <= 1 for r in near)


def test_lines(docs):
    out = remove_shared_lines(docs)
    assert ids(out, "row.doc_id") == expected(docs)
    got = {r["doc_id"]: r["kept"] for r in out.select("row.doc_id", "kept").collect()}
    if got:
        assert got[5] == LONG and got[6] == "" and got[2] is None and got[3] == "" and got[1] == ROWS[0][1]


def test_packing(docs):
    out = pack(docs).collect()
    assert {r["id"] for r in out} == {r["doc_id"] for r in docs.collect()}
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert ends[r["sequence_id"]] <= 4096
    assert all(r["length"] == 1 for r in out if r["id"] in (2, 3, 4))


@pytest.mark.parametrize("items", [ITEMS, []])
def test_leaks(spark, docs, items):
    out = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert ids(out, "row.doc_id") == expected(docs)
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in out.select("row.doc_id", "n_hit", "items").collect()}
    if got and items:
        assert got[1] == (10, ["1"]) and got[2] == (0, []) and got[5] == (8000, [])
    else:
        assert all(v == (0, []) for v in got.values())


def test_leaks_of_rows_without_id(spark):
    rows = [(None, ROWS[0][1]), (None, "clean"), (1, ROWS[0][1]), (None, None)]
    out = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.select("row.doc_id", "n_words", "n_hit", "items").collect()]
    assert len(got) == 4 and [g for g in got if g[2]] == [g for g in got if g[1] > 1] and all(g[2:] == (10, ["1"]) for g in got if g[1] > 1)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    out = find_toxic(docs, train_toxicity(docs, labels))
    assert ids(out, "row.doc_id") == expected(docs)
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert train_toxicity(docs, labels.filter("toxic = 0")) is None
    assert all(r["score"] == 0 for r in find_toxic(docs, None).collect())


def test_pii(docs):
    config = PiiConfig(windows=32, epochs=1)
    out = find_pii(docs, train_tagger(docs, config=config), config=config)
    assert ids(out, "row.doc_id") == expected(docs)
    got = {r["doc_id"]: [(s["kind"], s["lo"]) for s in r["base"]] for r in out.select("row.doc_id", "base").collect()}
    if got:
        assert got[1] == [("email", 61), ("phone", 78)] and got[2] == [] and got[3] == []


def test_a_cluster_needs_a_shared_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert work_root(session("local[2]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            work_root(session(master))


def test_shards(docs):
    out = shard(docs).collect()
    assert sorted((r["id"] is not None, r["id"] or 0) for r in out) == expected(docs)
    for s in range(16):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in out if r["id"] in (2, 3))
