"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import MIDDLE, SMALL
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, near_dedup, packing, pii, sharding, suffix_dedup, syncmers, toxicity
from tidemark.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}


def result(spark, name, folder=MIDDLE):
    return queries()[name](spark, folder).collect()


def test_language_is_learned(spark, docs):
    rows = [r for r in result(spark, "op1_language_id") if r["held_out"]]
    assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in rows]) > 0.97


def repeated(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


def test_two_stage_sort():
    rng = random.Random(3)
    for trial in range(300):
        length = rng.choice([2, 3, 5, 8])
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 6))]
        found = suffix_dedup.repeated_starts(texts, length)
        assert [{i for a, b in f for i in range(a, b)} for f in found] == [{i for i, x in enumerate(own) if x} for own in repeated(texts, length)]


@pytest.mark.parametrize(("length", "classes"), [(400, 3000), (40, 1)])
def test_suffix_removal(spark, length, classes):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, config=suffix_dedup.SuffixConfig(length, max_classes=classes, batch_bytes=5000))
    got = {r["doc_id"]: (bytes(r["kept"]), [(s["lo"], s["hi"]) for s in r["spans"]]) for r in out.select("row.doc_id", "kept", "spans").collect()}
    texts = [r["text"].encode() for r in rows]
    for r, raw, hits in zip(rows, texts, repeated(texts, length), strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for i in np.flatnonzero(hits):
            gone[i : i + length] = True
        kept, spans = got[r["doc_id"]]
        assert kept == bytes(c for c, g in zip(raw, gone) if not g)
        assert all(gone[a:b].all() and not gone[b] and (a == 0 or not gone[a - 1]) for a, b in spans)


def test_runs_with_equal_rolling_hashes_are_told_apart(spark):
    # Of this sequence and its complement all polynomial hashes modulo 2**64 with an odd base are equal.
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    assert len({int(suffix_dedup.Rolling(np.frombuffer(t.encode(), np.uint8)).of(slice(0, 1), slice(1024, None))[0]) for t in (x, y)}) == 1
    df = spark.createDataFrame([(1, x), (2, x), (3, y)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, config=suffix_dedup.SuffixConfig(1024, levels=(1.0,)))
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in out.select("row.doc_id", "kept").collect()} == {1: "", 2: "", 3: y}


def test_near_duplicates_of_string_ids(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [("c", " ".join(words)), ("b", " ".join([*words[:-1], "x"])), ("a", "something else that is alone here"), ("d", " ".join(words))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), config=near_dedup.NearConfig(block=2)).collect()
    assert {r["id"]: r["component"] for r in out} == {"a": "a", "b": "b", "c": "b", "d": "b"}


def test_near_duplicates(spark, docs):
    sets = {}
    for i, r in docs.items():
        w = r["text"].encode().lower().split()
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for e in s:
            holders[e].append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for r in result(spark, "op3_near_dedup"):
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)


def test_block_pairs_meet_all_other_components(spark):
    sizes = {1: [200, 1, 1, 5, 40], 2: [3, 2, 1], 3: [64, 64], 4: [2]}
    rows = [(band, 10_000 * band + 1000 * r + k, 10_000 * band + 1000 * r) for band, own in sizes.items() for r, c in enumerate(own) for k in range(c)]
    grouped = spark.createDataFrame(rows, "band long, id long, root long")
    cells, roots = defaultdict(set), {i: r for _, i, r in rows}
    for r in near_dedup.block_pairs(grouped, 32).collect():
        assert r["i"] <= r["j"] and r["id"] not in cells[r["band"], r["i"], r["j"]]
        cells[r["band"], r["i"], r["j"]].add(r["id"])
    met = {(a, b) for own in cells.values() for a in own for b in own if roots[a] < roots[b]}
    assert met == {(a, b) for x, a, r in rows for y, b, t in rows if x == y and r < t}
    assert all(len({roots[i] for i in own}) > 1 for (band, i, j), own in cells.items() if i != j)
    # Times that each text is sent: the blocks of its band less those of its own great component.
    assert sum(map(len, cells.values())) == (200 * 3 + 40 * 8 + 7 * 10) + 6 + (64 + 64) * 2 + 2


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = base[:900], base[100:]
    sig = near_dedup.superminhash(np.concatenate([a, b, base[:3]]), np.array([900, 900, 3]), 256)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08


def test_cells_and_components(spark):
    rng = np.random.default_rng(1)
    items = [np.unique(rng.integers(0, 30, rng.integers(40, 70))) for _ in range(40)]
    got = set(near_dedup.cell_links(list(range(40)), list(range(40)), items, 80))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * len(set(items[a]) & set(items[b])) >= 80 * len(set(items[a]) | set(items[b]))}
    assert got == want and want
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (60, 50), (70, 70)], "a long, b long")
    roots = {r["id"]: r["root"] for r in near_dedup.components(links, "test").collect()}
    assert roots == {i: 0 for i in range(1, 31)} | {i: 50 for i in (51, 52, 60)}


def plain_anchors(text, k=6, longest=32):
    """Closed syncmers one by one; stretches without white space as the module's docstring says."""
    tokens = []
    for w in re.split("[\x20\x09-\x0D]+", text):
        at = 0
        for p in range(1, len(w)):
            if len(w) > longest and (p >= longest or len(w) - p >= longest):
                tokens.append(w[at:p])
                at = p
        tokens += [w[at:]] if w else []
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*longs):
        seed = 42
        for x in longs:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
        return seed

    own = [0] * (k - 1) + [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens] + [0] * (k - 1)
    pairs = [(1 << 63) - 1 if a == b == 0 else signed(chain(a, b)) for a, b in zip(own, own[1:])]
    out = []
    for i in range(len(pairs) - k + 2):
        mer = pairs[i : i + k - 1]
        if min(mer) < (1 << 63) - 1 and min(mer) in (mer[0], mer[-1]):
            out.append((chain(mer[0], mer[2], mer[4]) >> 33, i))
    return out


def test_fingerprints(spark, docs):
    order = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in result(spark, "op4_syncmers")}
    prints = {i: plain_anchors(docs[i]["text"]) for i in docs}
    shown = lambda x: " ".join(f"{h}:{at}" for h, at in x)

    def alike(x, y):
        x, y = {h for h, _ in x}, {h for h, _ in y}
        return len(x & y) / len(x | y) if x | y else 1.0

    assert len(rows) == len(docs)
    for k, i in enumerate(order):
        j = order[(k + 1) % len(order)]
        t, n, r = docs[i]["text"], docs[j]["text"], rows[i]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        changed = plain_anchors(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(prints[i]), shown(changed))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(alike(prints[i], changed)), pytest.approx(alike(prints[i], prints[j])))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_order_of_neighbours_over_buckets(spark, kind):
    ids = [i * i for i in range(400)] + [10**15]
    shown = ids if kind == "long" else [f"{i:016d}" for i in ids]
    df = spark.createDataFrame([(x, f"t{n}", "clash") for n, x in enumerate(shown)], f"doc_id {kind}, text string, next string")
    config = syncmers.SyncmerConfig(rows_per_bucket=7)
    out = syncmers.with_next(df, "doc_id", config).collect()
    assert len(out) == len(ids) and all(r["next"]["text"] == f"t{(int(r['row']['text'][1:]) - 1) % len(ids)}" for r in out)


def test_shared_passages_have_places(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    df = spark.createDataFrame([(1, f"{a} {b}", f"{c} {b} {a}"), (2, a, c), (3, "", a)], "doc_id long, x string, y string")
    got = syncmers.fingerprints(df, "x").select("row.*", F.col("anchors").alias("p"))
    got = syncmers.fingerprints(got, "y").select("row.doc_id", "row.p", F.col("anchors").alias("q"))
    found = {(r["key"], r["shift"]): (r["start"], r["end"]) for r in syncmers.passages(got, "doc_id", "p", "q").collect() if r["n"] > 5}
    assert set(found) == {(1, 160), (1, 0)}
    assert found[1, 160][0] < 6 and 74 < found[1, 160][1] <= 81 and 79 < found[1, 0][0] < 86 and 154 < found[1, 0][1] <= 160
    near = {r["doc_id"]: r["n"] for r in got.select("doc_id", syncmers.likeness("p", "q").alias("n")).collect()}
    assert near[1] > 0.6 and near[2] == 0 and near[3] == 0


def plain_blocks(a, b):
    """Patience diff by piles, and the longest common run by trying all; aligned blocks of ``b``."""
    pairs = []

    def align(i, m, j, n):
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i >= m or j >= n:
            return
        unique = [(x, j + b[j:n].index(h)) for x, h in enumerate(a[i:m], i) if a[i:m].count(h) == 1 and b[j:n].count(h) == 1]
        piles, before = [], {}
        for x, y in unique:
            k = next((k for k, p in enumerate(piles) if p[-1][1] >= y), len(piles))
            before[x, y] = piles[k - 1][-1] if k else None
            piles[k:] = [[*(piles[k] if k < len(piles) else []), (x, y)], *piles[k + 1 :]]
        if piles:
            chain, at = [], piles[-1][-1]
            while at:
                chain.insert(0, at)
                at = before[at]
            for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)]):
                align(x0 + 1, x1, y0 + 1, y1)
            pairs.extend(chain)
            return
        best = ((0, 0), 0, 0, 0)
        for end in range(j + 1, n + 1):
            for size in range(end - j, 0, -1):
                x = next((x for x in range(i, m - size + 1) if a[x : x + size] == b[end - size : end]), None)
                if x is not None:
                    score = (sum(h != 0 for h in b[end - size : end]), size)
                    best = (score, x, end - size, size) if score > best[0] else best
                    break
        _, x, y, size = best
        if size:
            pairs.extend((x + k, y + k) for k in range(size))
            align(i, x, j, y)
            align(x + size, m, y + size, n)

    align(0, len(a), 0, len(b))
    pairs.sort()
    blocks = []
    for k, (x, y) in enumerate(pairs):
        if k and pairs[k - 1] == (x - 1, y - 1):
            blocks[-1] = (blocks[-1][0], y + 1)
        else:
            blocks.append((y, y + 1))
    return blocks


def test_a_repeat_is_found_whatever_else_is_there(spark):
    texts = ["alpha beta\nother text of the first", "gamma delta\nother text of the second", "alpha beta\ngamma delta", "alpha beta\ngamma delta\nown text"]
    for many in (texts[2:], texts):
        df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
        got = {r["doc_id"]: r["kept"] for r in line_dedup.remove_shared_lines(df).select("row.doc_id", "kept").collect()}
        assert got[len(many) - 1] == "own text" and [got[i] for i in range(len(many) - 1)] == many[:-1]


def aligned_with_all_earlier(texts):
    out, seen = [], []
    for text in texts:
        own = text.split("\n")
        code, sizes = [hash(x) if x.strip(" ") else 0 for x in own], [len(x) for x in own]
        gone = [False] * len(own)
        for other in seen:
            if (set(code) & set(other)) - {0}:
                for lo, hi in plain_blocks(other, code):
                    if sum(sizes[lo:hi]) >= 20:
                        gone[lo:hi] = [True] * (hi - lo)
        seen.append(code)
        out.append("\n".join(x for x, g in zip(own, gone) if not g))
    return out


def test_lines_meet_every_earlier_holder(spark):
    rng = random.Random(7)
    pool = [f"passage number {k} of twenty or more characters" for k in range(6)] + ["short a", "short b", "nine chars", "", " ", " " * 12]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    config = line_dedup.LineConfig(pairs_a_copy=16, batch=4, growth=4, partners_a_row=4)
    got = {r["doc_id"]: r["kept"] for r in line_dedup.remove_shared_lines(df, config=config).select("row.doc_id", "kept").collect()}
    assert [got[i] for i in range(len(texts))] == aligned_with_all_earlier(texts)


def test_documents_meet_every_earlier_holder(spark, docs):
    rows = {r["doc_id"]: r["kept_sha256"] for r in result(spark, "op5_line_dedup")}
    order = sorted(docs)
    want = aligned_with_all_earlier([docs[i]["text"] for i in order])
    assert [rows[i] for i in order] == [hashlib.sha256(t.encode()).hexdigest() for t in want]


def test_copies_of_a_holder_change_nothing(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    many = df.union(spark.range(1000, 1200).select("id", F.concat(F.lit("one line that all of these documents hold\n"), F.col("id").cast("string")).alias("text")))
    out = [sorted(line_dedup.remove_shared_lines(many, config=line_dedup.LineConfig(pairs_a_copy=n)).select("row.doc_id", "kept", "n_dropped").collect()) for n in (3, 1024)]
    assert out[0] == out[1] and sum(r["n_dropped"] for r in out[0]) >= 199


def test_patience_blocks():
    assert line_dedup.common_blocks([1, 2, 3, 4, 5, 9], [7, 2, 3, 8, 5, 9, 9]) == [(1, 3), (4, 5), (6, 7)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = line_dedup.matched_lines(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))


def test_repeated_passages_align():
    assert line_dedup.longest_run([1, 2, 3, 1, 2, 4], [9, 1, 2, 4, 1, 2]) == (3, 1, 3)
    assert line_dedup.longest_run([1], [2]) == (0, 0, 0)
    # The earlier document holds the passage 5 6 twice, or the later one does.
    assert line_dedup.common_blocks([1, 5, 6, 2, 5, 6, 3], [7, 5, 6, 8]) == [(1, 3)]
    assert line_dedup.common_blocks([7, 5, 6, 8], [1, 5, 6, 2, 5, 6, 3]) == [(1, 3)]
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        x, y, n = line_dedup.longest_run(a, b)
        every = [b[j : j + k] for j in range(len(b)) for k in range(1, len(b) - j + 1) if any(a[i : i + k] == b[j : j + k] for i in range(len(a)))]
        assert a[x : x + n] == b[y : y + n]
        assert (sum(map(bool, b[y : y + n])), n) == max(((sum(map(bool, r)), len(r)) for r in every), default=(0, 0))
        assert bool(line_dedup.matched_lines(a, b)) == bool(set(a) & set(b))


def test_packing_is_exact_and_tight(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = result(spark, "op6_packing")
    want = {}
    for i, r in docs.items():
        ids = [*own.encode(r["text"], add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[i, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    assert len(ends) == -(-sum(n for _, n, _ in want.values()) // 4096)


def test_words_are_tokenized_as_in_the_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, fast = Tokenizer.from_file(path), packing.WordTokenizer(path, 100)
    texts = ["İstanbul ﬁne ÀÉÎ ß ÿ Œuvre's don't I'LL. 've x'd", "日本語 12,345.67 ΣΟΦΟΣ \x1c a\x1db <|endoftext|> end...,!?\xa0Ça?! é ŉo ſs", "", *[chr(c) + "a " + chr(c) + "." for c in range(33, 0x180)]]
    for t in texts:
        assert fast.ids([t])[0] == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_configuration_program():
    rng = np.random.default_rng(4)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1, 20_000).astype(int) + 1)
    hist = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    done = packing.plan(dict(hist))
    assert not done.left and done.count <= -(-lengths.sum() // 4096) * 1.002 + 1
    used = Counter()
    for length, _, n, first, offset in done.placed:
        assert offset + length <= 4096
        for s in range(first, first + n):
            used[s] += length
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 4096
    assert packing.knapsack(np.array([3, 5]), np.array([1.0, 2.0]), 11) in ({0: 2, 1: 1}, {1: 2}, {1: 1, 0: 2})


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op3_near_dedup", "op7_decontamination"])
def test_whole_tables_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MIDDLE}/{t}.parquet')")
    want = con.execute(oracle_sql()[name]).df()
    rows = result(spark, name)
    assert sorted(map(tuple, rows)) == sorted(want[list(rows[0].asDict())].itertuples(index=False, name=None))
    assert name != "op7_decontamination" or any(r["contaminated"] for r in rows)


def test_maximal_segments():
    def brute(x, lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a, hi):
                s = sum(x[a : b + 1])
                if s > 1e-9 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) < 1e-9 and b + 1 - a < best[1] - best[0])):
                    best = (a, b + 1, s)
        return [] if best is None else [*brute(x, lo, best[0]), best, *brute(x, best[1], hi)]

    rng = random.Random(1)
    for _ in range(300):
        drift = rng.choice([0.31, 0.77])
        x = [rng.choice([1.013, 2.171]) if rng.random() < 0.4 else -drift for _ in range(rng.randint(1, 14))]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(x) if v != -drift], len(x), drift)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute(x, 0, len(x))]


def test_toxicity_on_held_out(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in result(spark, "op8_toxicity", folder) if r["held_out"] and r["doc_id"] in labels]
    y, p = np.array([labels[r["doc_id"]] for r in rows]), np.array([r["predicted"] for r in rows])
    assert y[p == 1].mean() > 0.8 and p[y == 1].mean() > 0.85  # 0.85 and 0.90 from 3000 labels; 0.97 and 1.0 from 15000


def test_toxicity_scores_by_hand(spark, docs):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learn = spark.createDataFrame([(i, y) for i, y in known.items() if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, learn)
    assert model.lexicon
    for r in result(spark, "op8_toxicity"):
        best = total = 0.0
        tokens = re.findall(r"\w+", docs[r["doc_id"]]["text"].lower())
        for w in tokens:
            odds = [model.lexicon[f] for f in [w, *[w[:n] + "-" for n in range(4, min(8, len(w)))]] if f in model.lexicon]
            total = max(0.0, total) + (max(odds) if odds else -model.drift)
            best = max(best, total)
        e = max(0.0, model.scale * best - np.log(model.constant * max(1, len(tokens)) / model.chance)) if best else 0.0
        want = 1 / (1 + np.exp(-max(-50, min(50, model.offset + model.slope * e))))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


_BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, pattern in enumerate(_BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_patterns_match_plain_ones():
    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice("a1234.@@+- (é.1") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("4" * 200_000 + "x" * 200_000 + "@") == []


def test_tagger_gradients():
    tagger = pii.Tagger(4, 1)
    tagger.params = {k: v.astype(np.float64) for k, v in tagger.params.items()}
    x, y = np.random.default_rng(0).integers(0, 97, (3, 7)), np.random.default_rng(1).integers(0, pii.TAGS, (3, 7))
    _, grads = tagger.gradients(x, y)
    for k, p in tagger.params.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), p.shape)
        p[at] += 1e-3
        up, _ = tagger.gradients(x, y)
        p[at] -= 2e-3
        down, _ = tagger.gradients(x, y)
        p[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-3


def test_pii(spark, docs):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    tagger = pii.train_tagger(df)
    texts = [r["text"] for r in docs.values()]
    base = [(t, set(pii.base_spans(t))) for t in texts]
    want = sum(len(b) for _, b in base)
    found = sum(len(b & set(pii.added_spans(tagger, t, [], pii.PiiConfig(min_posterior=0.5)))) for t, b in base if b)
    assert want and found > 0.85 * want
    for r in result(spark, "op9_pii"):
        own = plain_spans(docs[r["doc_id"]]["text"])
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in own)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))
    for t, want in [
        ("thon ly +1 (743) 555-3824 4785380592391139 and the", [(2, 26, 42), (3, 8, 25)]),
        ("thon ly 4785380592391139 4785380592391139 and the", [(2, 8, 24), (2, 25, 41)]),
        ("thon ly 2123465659789240, version 10.2 of 1.234.567 and 1999-2004 the", []),
    ]:
        assert pii.base_spans(t) == [] and sorted(pii.added_spans(tagger, t, [], pii.PiiConfig())) == want


def test_shards(spark, docs):
    rows = result(spark, "op10_sharding")
    sizes, homes = Counter(), defaultdict(set)
    for r in rows:
        raw = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        homes[raw].add(r["shard"])
    mean, most = sum(sizes.values()) / 16, max(r["size"] for r in rows)
    assert len(rows) == len(docs) and max(sizes.values()) - mean <= most and mean - min(sizes.values()) <= most
    assert all(len(h) == 1 for h in homes.values())
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_a_text_held_by_most_rows_is_split_evenly(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in out]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 16


@pytest.mark.parametrize("hot", [0, 3])
def test_equal_texts_stay_together_on_skewed_data(spark, hot):
    n = 12_000
    text = F.format_string("%08d", (F.col("id") / 2).cast("long"))
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.when(F.col("id") < n // hot, "the same").otherwise(text) if hot else text).alias("text"))
    rows = sharding.shard(df).join(df.withColumnRenamed("doc_id", "id"), "id").collect()
    homes, sizes = defaultdict(set), Counter()
    for r in rows:
        homes[r["text"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(rows) == n and [t for t, h in homes.items() if len(h) > 1] == (["the same"] if hot else [])
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(b - mean) for b in sizes.values()) < 0.02 * mean


def test_network_by_hand():
    config = language_id.ConvConfig(window=16, filters=3)
    net = language_id.ByteConvNet(["a", "b", "c"], config)
    texts = [b"short", bytes(range(60, 101)), b"x", b"the quick brown fox jumps over it"]
    for t, got in zip(texts, net.probabilities(texts), strict=True):
        step, sums, begin = 16 - 3, np.zeros(3), 0
        while begin == 0 or begin + 3 < len(t):
            win = t[begin : begin + 16].ljust(16, b"\0")
            top = [max(sum(tab[o, win[at + o], f] for o in range(len(tab))) for at in range(16 - len(tab) + 1)) for tab in net.tables for f in range(3)]
            z = np.tanh(np.array(top) + net.bias) @ net.out + net.out_bias
            p = np.exp(z - z.max())
            sums += p / p.sum() * min(max(len(t) - begin, 1), step)
            begin += step
        assert np.allclose(got, sums / sums.sum(), atol=1e-5)


def test_windows_of_long_texts():
    net = language_id.ByteConvNet(["a", "b"], language_id.ConvConfig(window=32))
    x, owner, weight = net.windows([b"x" * 100, b"", b"y" * 31])
    assert (owner == [0, 0, 0, 0, 1, 2]).all() and x.shape == (6, 32) and weight.min() > 0
    grams = {bytes(r[i : i + 4]) for r in net.windows([bytes(range(1, 101))])[0] for i in range(29)}
    assert all(bytes(range(i, i + 4)) in grams for i in range(1, 98))
