"""The pipeline against a plain version of each stage's decision."""

from collections import defaultdict

import corpus_pipeline as pipeline
from conftest import MIDDLE
from test_operators import aligned_with_all_earlier

from tidemark.llm.common import save
from tidemark.llm.language_id import train_language_model


def test_stages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns = docs.columns
    bench = [r["text"] for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, save(stage(spark, docs, MIDDLE), f"test-{name}")
        seen[name] = (before, docs)
        if name != "pack":
            assert docs.columns == columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]

    before, after = seen["language_id"]
    net = train_language_model(before)
    rows = before.collect()
    named = [r for r in rows if any(map(str.isalpha, r["text"] or ""))]
    best = net.probabilities([r["text"].encode() for r in named]).max(1)
    least = pipeline.least_score(len(net.classes))
    clear = [(r, p) for r, p in zip(named, best, strict=True) if abs(p - least) > 1e-4]
    kept = {r["doc_id"] for r in after.collect()}
    assert len(clear) > 0.99 * len(rows) and all((r["doc_id"] in kept) == (p >= least) for r, p in clear)
    assert not kept & ({r["doc_id"] for r in rows} - {r["doc_id"] for r in named})

    before, after = seen["line_dedup"]
    texts = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = dict(zip([i for i, _ in texts], aligned_with_all_earlier([t for _, t in texts]), strict=True))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (want[i], len(want[i])) for i, t in texts if want[i] or not t}

    before, after = seen["near_dedup"]
    kept, sets, holders = {r["doc_id"] for r in after.collect()}, {}, defaultdict(set)
    for r in before.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for e in sets[r["doc_id"]]:
            holders[e].add(r["doc_id"])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j in {j for e in s for j in holders[e] if j > i}:
            n = len(s & sets[j])
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert kept == {i for i in sets if find(i) == i}

    before, after = seen["decontaminate"]

    def words(t):
        out, w = [], ""
        for c in t + " ":
            c = c.lower() if c.isascii() else c
            if c.isascii() and not c.isalnum():
                out += [w] if w else []
                w = ""
            else:
                w += c
        return out

    windows = set()
    for t in bench:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = set()
    for r in before.collect():
        w = words(r["text"])
        if not any(tuple(w[i : i + 10]) in windows for i in range(len(w))):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == clean

    before, after = seen["pack"]
    assert {r["doc_id"] for r in after.collect()} == clean


def test_language_stage_rejects_by_the_number_of_languages(spark, monkeypatch):
    assert [round(pipeline.least_score(n), 3) for n in (1, 2, 4, 10)] == [0, 0.6, 0.4, 0.28]
    known = [(i, t, lang) for i in range(40) for t, lang in [("the cat and the dog are in the garden", "en"), ("der hund und die katze sind im garten", "de")]]
    docs = spark.createDataFrame([*known, (99, "the hund and die garden im und the", None)], "doc_id long, text string, lang string")
    net = train_language_model(docs)
    best = net.probabilities([b"the hund and die garden im und the"]).max()
    stage = dict(pipeline.STAGES)["language_id"]
    for share in (0.0, 0.2, min(1.0, 2 * best - 1 + 1e-3)):
        monkeypatch.setattr(pipeline, "MIN_LANGUAGE", share)
        kept = {r["doc_id"] for r in stage(spark, docs, MIDDLE).collect()}
        assert kept == set(range(40)) | ({99} if best >= pipeline.least_score(2) else set())
    one = docs.filter("lang = 'en' OR lang IS NULL")
    assert stage(spark, one, MIDDLE).count() == 41


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, MIDDLE), f"empty-{name}")
    assert docs.count() == 0


def test_leaks_without_id_are_dropped(spark):
    leak = spark.read.parquet(f"{MIDDLE}/benchmark.parquet").first()["text"]
    rows = [(None, leak), (None, "clean"), (None, None), (1, leak), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(pipeline.STAGES)["decontaminate"](spark, docs, MIDDLE).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, ""), (0, "clean"), (2, "clean")]


def test_odd_rows_pass_all_stages(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [(1, "the cat and the dog are in the garden\nwith one more line of text"), (2, None), (3, ""), (4, " \n "), (5, long), (6, long), (6, long), (None, "a text that has no id at all"), (None, None), (7, "$ 12 %"), (8, "the cat and the dog are in the garden\nwith another line of text")]
    rows = [(i, t, "en" if t else None, None, 5, 0.5, "r", 7, "k", 9) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, id long, kept string, _th long")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, MIDDLE), f"odd-{name}")
        seen[name] = docs
        assert name == "pack" or docs.columns == columns
    found = {name: sorted((r["doc_id"] or 0) for r in df.collect()) for name, df in seen.items() if name != "pack"}
    assert found["language_id"] == [0, 1, 5, 6, 6, 8] and found["line_dedup"] == found["near_dedup"] == found["decontaminate"] == [0, 1, 5, 8]
    assert {r["doc_id"]: r["text"] for r in seen["decontaminate"].collect()}[8] == "with another line of text"
    pieces = seen["pack"].collect()
    assert {r["doc_id"] for r in pieces} == {None, 1, 5, 8} and len([r for r in pieces if r["doc_id"] == 5]) > 10
