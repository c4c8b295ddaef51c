"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import gzip
import hashlib
import io
import random
import re
import tarfile
import time
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscope.llm import chat, components, decontam, langid, linededup, media, mixing, neardup, queries, secrets, substring, warc, words
from poolscope.llm.scratch import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, texts, first=0):
    rows = [(first + i, t, ["en", "de", None][i % 3], [None, "b", "a", "é"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample_texts(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd Ef gh ij kl mn op qr st uv wx yz é ü ñ".split()) + str(rng.randrange(8))
    run = lambda k: " ".join(word() for _ in range(k))
    base, passage, line = run(120), run(50), "A shared Line that is surely over forty characters long " + run(3)
    out = [None, "", " \t\n ", "one", "One", "two words", "\n\n", "a a " * 40, run(6000)]
    for i in range(n):
        w = base.split()
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w) if i % 3 == 0 else f"{run(rng.randrange(1, 80))} {passage} {run(5)}" if i % 3 == 1 else f"{run(9)}\n {line.upper() if i % 2 else line}\t\n{run(4)}")
    return out + out[9:12] * 3 + [base] * 5


def brute_near(texts, k=5, percent=75):
    sets = []
    for t in texts:
        w = [lower(x) for x in WORDS.findall(t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    to = list(range(len(texts)))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                to[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)  # several tiles in a group of a few dozen
    monkeypatch.setattr(neardup, "TILE_SHINGLES", 500)
    monkeypatch.setattr(neardup, "FIRST", 1)
    texts = sample_texts(1)
    df = table(spark, texts).withColumn("kept", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    for i, (n, c) in enumerate(brute_near(texts)):
        assert got[i] == (n, c, i == c)


def test_small_sets_lose_no_link(spark):
    """Texts of few words, just at the threshold, and just below it."""
    rows, want = [], {}
    for k in range(1500):
        w = [f"{k}w{i}" for i in range(26)]
        more, less = ((8, 7), (12, 10), (9, 8), (24, 19))[k % 4]  # 3 of 4 shingles, 6 of 8, 4 of 5, 15 of 20
        rows += [(3 * k, " ".join(w[:more])), (3 * k + 1, " ".join(w[:less])), (3 * k + 2, " ".join(w[: less - 1]))]
        linked = 100 * (less - 5) >= 75 * (less - 4)
        want |= {3 * k: 3 * k, 3 * k + 1: 3 * k, 3 * k + 2: 3 * k if linked or 100 * (less - 5) >= 75 * (more - 4) else 3 * k + 2}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_templates_are_not_compared(spark, monkeypatch):
    """Pages of one template with a body of their own meet in buckets, and go before any pair is compared; copies among them are found."""
    rng = random.Random(9)
    page = [f"t{i}" for i in range(120)]
    bodies = [[f"b{k}x{i}" for i in range(40)] for k in range(150)]
    texts = [" ".join(page + b) for b in bodies] + [" ".join(page + bodies[k][:37] + ["y"] * 3) for k in range(0, 150, 10)]
    rng.shuffle(texts)
    made = []
    monkeypatch.setattr(neardup, "TILE", 16)
    kept = Scratch.keep

    def keep(self, df, name):
        out = kept(self, df, name)
        if name in ("mixed-able", "split"):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(brute_near(texts))}
    assert len({c for _, c in got.values()}) < len(texts)
    assert dict(made)["mixed-able"] <= 60, made


@pytest.mark.parametrize("local", [500_000, 40])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(60)] + [(100, int(x)) for x in rng.integers(100, 400, 80)] + [(500, 500)] + [(int(a), int(b)) for a, b in rng.integers(600, 900, (150, 2))]
    to = {x: x for p in links if p[0] != p[1] for x in p}
    for _ in to:
        for a, b in links:
            if a != b:
                to[a] = to[b] = min(to[a], to[b])
    scratch = Scratch(spark, "components-test")
    got = components.connected(scratch, scratch.keep(spark.createDataFrame(links, "u long, v long").repartition(8), "links"), "c").collect()
    assert {r["node"]: r["component"] for r in got} == to and len(got) == len(to)
    none = components.connected(scratch, spark.createDataFrame([], "u long, v long"), "none")
    assert none.collect() == []


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []
    rows = [(None, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (2, None, None, None, None)]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 0, 2, True), ("None", 2, None, True)]


def test_very_long_documents(spark):
    """Near copies of 200,000 words, one of which shares its last fifth with a short text."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near, far = list(w), w[:120_000] + [f"v{i}" for i in range(80_000)]
    for i in range(0, len(near), 100):
        near[i] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(w[-40_000:])), (5, " ".join(w[-40_000:] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    left = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substring.remove_repeats(df).collect()}
    assert left == {1: 400, 2: 2000, 3: 80_000, 4: 0, 5: 1}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.95):
        h = words.mix(rng.integers(0, 2**63, 4000).astype(np.uint64))
        both = int(1000 * share)
        a, b = h[:1000], h[1000 - both : 2000 - both]
        sets = [np.sort(a), np.sort(b)]
        k = neardup.setsketch(np.concatenate(sets), np.array([0, 1000, 2000]))
        union = neardup.setsketch(np.unique(np.concatenate(sets)), np.array([0, len(np.unique(np.concatenate(sets)))]))
        assert (np.maximum(k[0], k[1]) == union[0]).all()
        j, _ = neardup.likelihood(k[:1], k[1:], np.array([1000.0]), np.array([1000.0]), 0.75)
        assert abs(j[0] - both / (2000 - both)) < 0.12


def brute_repeats(texts, length=35):
    seen, out = Counter(), []
    for t in texts:
        w = WORDS.findall(t or "")
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    for t in texts:
        w = WORDS.findall(t or "")
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings(spark):
    texts = sample_texts(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.remove_repeats(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    assert substring.remove_repeats(table(spark, [])).collect() == []


def test_repeated_rows_lose_all_runs(spark):
    text = " ".join(map(str, range(50)))
    got = substring.remove_repeats(spark.createDataFrame([(None, text, "", "", 0)] * 2 + [(5, text[:60], "", "", 0)], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], len(r["text"])) for r in got) == [("5", 0, len(text[:60].rstrip())), ("None", 50, 0), ("None", 50, 0)]


def test_lines(spark):
    texts = sample_texts(3)
    docs, key = defaultdict(set), lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    df = table(spark, texts).withColumn("t", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("n_lines", F.lit(7))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    some = 0
    for i, t in enumerate(texts):
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= 40 and len(docs[key(x)]) >= 5 and i != max(docs[key(x)]))]
        n = len((t or "").split("\n"))
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"], got[i]["t"], got[i]["gone"]) == (n, n - len(kept), "\n".join(kept), 1, 2)
        some += n - len(kept)
    assert some and linededup.dedup_lines(table(spark, [])).collect() == []
    assert linededup.dedup_lines(spark.createDataFrame([(None, "x" * 50, "", "", 0)] * 6, SCHEMA)).filter("n_dropped > 0").isEmpty()


def brute_targets(size, most=3):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = sum(size.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * size[s]}
        if not full:
            return target | share
        target |= {s: most * size[s] for s in full}
        left -= sum(most * size[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark):
    texts = [t for k in range(8) for t in sample_texts(k)]
    df = table(spark, texts).withColumn("copy", F.lit(0)).withColumn("size", F.lit(9))
    rows, draws = (x.collect() for x in mixing.mix(df)[:2])
    size = defaultdict(int)
    for r in df.collect():
        size[r["source"]] += len(WORDS.findall(r["text"] or ""))
    target, copies = brute_targets(dict(size)), Counter(r["doc_id"] for r in draws)
    taken, smallest = defaultdict(int), defaultdict(lambda: 10**9)
    for r in rows:
        assert r["size"] == len(WORDS.findall(texts[r["doc_id"]] or "")) and r["source_size"] == size[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) and copies[r["doc_id"]] <= 3
        taken[r["source"]] += copies[r["doc_id"]] * r["size"]
    assert len(rows) == len(texts)
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 60
    assert len({(r["doc_id"], r["copy"]) for r in draws}) == len(draws)
    assert {(r["doc_id"], r["copy"], r["shard"]) for r in draws} == {(r["doc_id"], r["copy"], r["shard"]) for r in mixing.mix(df)[1].collect()}
    # small blocks: as near as half the longest text
    own = mixing.mix(df, block=8, shard_words=4000)
    draws = own.draws.persist()
    words_of = {r["doc_id"]: r["size"] for r in rows}
    for s in size:
        some = draws.filter(F.col("source").eqNullSafe(s)).collect()
        assert abs(sum(words_of[r["doc_id"]] for r in some) - target[s]) <= 3000
    mixed = mixing.mixed_rows(df.drop("size"), draws, own.shards)
    parts = mixed.select(F.spark_partition_id().alias("p"), "shard", "position").rdd.glom().collect()
    assert own.shards > 8 and len(parts) == own.shards and sum(map(len, parts)) == draws.count()
    for i, part in enumerate(parts):
        assert all(r["p"] == r["shard"] == i for r in part) and [r["position"] for r in part] == sorted(r["position"] for r in part)
    # shards are like the whole: no shard lacks the largest source, none has much of it
    share = {s: sum(r["source"] == s for r in draws.collect()) for s in size}
    for part in parts:
        assert len(part) > 0
    largest = max(share, key=share.get)
    counts = Counter(r["shard"] for r in draws.filter(F.col("source").eqNullSafe(largest)).collect())
    assert len(counts) > 0.8 * own.shards and max(counts.values()) < 5 * share[largest] / own.shards
    again = Counter(tuple(r) for r in mixing.mixed_rows(df, draws, own.shards).drop("position").collect())
    assert sum(again.values()) == draws.count() and "copy" in df.columns
    empty = mixing.mix(table(spark, []))
    assert empty[0].collect() == [] and empty[1].collect() == []


def test_quotas_split_exactly(spark, monkeypatch):
    quotas = spark.createDataFrame([(0, 700), (1, 0), (2, 41), (3, 3)], "sid int, quota long")
    monkeypatch.setattr(mixing, "TRUNK", 2)
    rows = mixing.split_quotas(quotas, 4).collect()
    by = defaultdict(int)
    for r in rows:
        by[r["sid"]] += r["blocks"]
        assert r["blocks"] >= 0
    assert dict(by) == {0: 700, 1: 0, 2: 41, 3: 3}
    shards = Counter()
    for r in rows:
        shards[r["shard"]] += r["blocks"]
    assert len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 4


def test_hypergeometric_mean(spark):
    u = (F.col("id") + 0.5) / 2000
    draw = mixing._hypergeometric(F.lit(30.0), F.lit(100.0), F.lit(40.0), u).alias("x")
    x = np.array([r["x"] for r in spark.range(2000).select(draw).collect()])
    assert abs(x.mean() - 12) < 0.05 and abs(x.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.2 and x.min() >= 0 and x.max() <= 30


def test_decontamination(spark):
    texts = sample_texts(4)
    items = [" ".join(texts[10].split()[5:40]), "x y z " * 10, None, "", "two words", texts[8][2000:2300], " ".join(texts[10].split()[60:67])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    shingled = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := [lower(x) for x in WORDS.findall(t or "")]) else set()
    want = set()
    for i, t in enumerate(texts):
        for j, b in enumerate(items):
            s, q = shingled(t), shingled(b)
            if q and 100 * len(s & q) >= 75 * len(q):
                want.add((i, j, len(s & q), len(q)))
    df = table(spark, texts).withColumn("item_id", F.lit(1))
    assert {tuple(r) for r in decontam.contaminated(df, bench).collect()} == want and len(want) > 20
    clean = decontam.decontaminate(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontam.contaminated(table(spark, []), bench).collect() == [] and decontam.contaminated(df, bench.limit(0)).collect() == []


def test_decontamination_in_passes(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = docs.union(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    one, clean = Counter(tuple(r) for r in decontam.contaminated(docs, bench).collect()), Counter(tuple(r) for r in decontam.decontaminate(docs, bench).collect())
    assert len(decontam._parts(bench, "item_id", "text", 5)[1]) == 1
    monkeypatch.setattr(decontam, "PASS_WORDS", 300)
    rows, passes = decontam._parts(bench, "item_id", "text", 5)
    assert len(passes) > 3 and sorted(r["id"] for c in passes for r in rows.filter(c).collect()) == sorted(r["item_id"] for r in bench.collect())
    assert Counter(tuple(r) for r in decontam.contaminated(docs, bench).collect()) == one and one
    assert Counter(tuple(r) for r in decontam.decontaminate(docs, bench).collect()) == clean


def test_containment_search_has_recall():
    """Items of many sizes, in long documents, whole and in parts, together and apart: the sketch is a part of a long item, and finds all the same."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [" ".join(word() for _ in range(n)) for n in (6, 9, 20, 40, 90, 400, 3000) for _ in range(12)]
    docs = []
    for t in items:
        w, filler = t.split(), [word() for _ in range(4000)]
        cut = len(w) // 2
        docs += [" ".join(filler[:1000] + w + filler[1000:]), " ".join(filler[:500] + w[:cut] + filler[500:900] + w[cut:] + filler[900:]), " ".join(w[: len(w) * 7 // 10] + filler)]
    index = decontam.Items(list(range(len(items))), items, 5, 75)
    assert sum(len(p.hashes) for p in index.parts) < sum(index.sizes) / 8
    # a partition of large items looks at few of a document's shingles, whatever small items there are beside it
    bounds = [p.bound / 2.0**64 for p in index.parts]
    assert bounds == sorted(bounds, reverse=True) and bounds[0] == 1 and bounds[-1] < 0.01 and len(bounds) > 4
    sets = [set(zip(*(t.encode().split()[i:] for i in range(5)), strict=False)) for t in docs]
    want = {(i, j) for i, s in enumerate(sets) for j, q in enumerate(index.sets) if 100 * len(s & q) >= 75 * len(q)}
    got = {(i, j) for i, j, _ in decontam.search(index, pa.array(docs))}
    assert got == want and len(want) > 120
    size, need, kept = 200, 150, 24
    draws = np.random.default_rng(0).hypergeometric(need, size - need, kept, 200_000)
    assert (draws < decontam.least_found(size, need, kept, 1e-3)).mean() <= 1.3e-3 and decontam.least_found(8, 6, 8) == 6


def brute_forward(p, pieces, word):
    word, ids = langid.MARK + word, {x: i for i, x in enumerate(pieces)}
    a = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in ids:
                a[j] += a[i] * p[ids[word[i:j]]]
            elif j - i == 1:
                a[j] += a[i] * p[len(pieces) + 1]
    return np.log(a[-1])


def test_forward_sums_all_segmentations():
    pieces = sorted([langid.MARK, langid.MARK + "a", "a", "b", "ab", "ba", "aba", langid.MARK + "ab"])
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 2, 2)) / 10
    p[-2] = 0
    words = ["abab", "a", "bxba", "ab" * 40, "b" * 33]
    got = langid.forward(langid.Pieces(pieces), p, [langid.MARK + w for w in words])
    for i, w in enumerate(words):
        assert np.allclose(got[i], [brute_forward(p[:, k], pieces, w) for k in range(2)], rtol=1e-9)


def test_words_of_any_length(spark, monkeypatch):
    """Long words: the same sums in chunks and segments, all letters in training, and a run of 2,000,000 letters in seconds."""
    pieces = sorted([langid.MARK, langid.MARK + "a", "a", "b", "ab", "ba", "aba", langid.MARK + "ab"])
    p = np.random.default_rng(0).random((len(pieces) + 2, 2)) / 4
    p[-2] = 0
    index, rng = langid.Pieces(pieces), random.Random(2)
    words = [langid.MARK + "".join(rng.choice("abx") for _ in range(n)) for n in (5, 40, 300, 497, 1000)]
    plain = langid.forward(index, p, words)
    monkeypatch.setattr(langid, "LONG", 4)
    for chunk in (1 << 15, 64, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(langid.forward(index, p, words), plain, rtol=1e-9)
    monkeypatch.undo()
    own = {}
    for w in ("a" * 25, "a" * 31, "ab" * 4000):
        for x in langid.stretches(w):
            own[x] = own.get(x, 0) + 1
    assert sum(len(x) * n for x, n in own.items()) == 25 + 31 + 8000 + 3
    uniform, counts = np.full((len(pieces) + 2, 1), 0.1), np.zeros((len(pieces) + 2, 1))
    uniform[-2] = 0
    langid.forward(index, uniform, list(own), counts, np.array(list(own.values()), float)[:, None])
    lengths = np.array([len(x) for x in pieces])
    assert abs((counts[:-2, 0] * lengths).sum() - (25 + 31 + 8000 + 3)) < 1e-6
    docs = spark.createDataFrame([(1, "the house of words", "en", "s", 1), (2, "x" * 2_000_000, "en", "s", 1), (3, "das haus der worte", "de", "s", 1)], SCHEMA)
    began = time.time()
    assert langid.train(docs)["langs"] == ["de", "en"]
    got = langid.identify(docs, langid.train(docs.filter("doc_id <> 2"))).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][::2] == ["en", "de"] and got[1]["lang_pred"] != "und" and time.time() - began < 60


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.learnable(docs), sample=100, rounds=2)
    got = langid.identify(docs, model).toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    assert (got.lang == got.lang_pred)[held].mean() > 0.95 and got.score.between(0, 1).all()
    odd = langid.identify(table(spark, [None, "", "12 ½ _", "x" * 5000, "the " * 3000]).withColumn("score", F.lit(2)), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[0]["score"] == 0 and odd[3]["lang_pred"] != "und"
    assert langid.identify(table(spark, []), model).collect() == []
    empty = langid.train(table(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs.limit(3), empty).collect()} == {"und"}


def test_archives(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 200_000, "a\r\n\r\nb\nWARC/1.1\r\n", "<p>é</p>", ""]
    rows = [(i if i != 3 else None, "http://a b/\n" if i % 2 else None, t) for i, t in enumerate(html)] + [(0, "u", "<p>é</p>")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((t or "").encode()), digest(t)) for i, _, t in rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[digest(t)] = min(first.get(digest(t), i), i)
    kinds = Counter((r["payload_digest"], r["record_type"]) for r in got)
    for d in first:
        assert kinds[d, "response"] == 1
    assert all(r["refers_to"] == (first[r["payload_digest"]] if r["record_type"] == "revisit" else None) for r in got)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_both_arc_versions():
    block = warc.http_response(7, b"body\nhttp://x 1.1.1.1 2 text/html 9\n")
    for version, rest in ((1, f"{len(block)}"), (2, f"200 - - 0 f {len(block)}")):
        raw = warc.arc_head(version, "20200101000000", "f") + f"http://x 1.1.1.1 20210203040506 text/html {rest}\n".encode() + block + b"\n"
        ((fields, got),) = warc.parse_arc(io.BytesIO(raw))
        assert got == block and fields["Archive-date"] == "20210203040506"
        ((headers, kept),) = warc.parse_warc(io.BytesIO(warc.to_warc("p", 0, fields, got, None)))
        assert kept == block and headers["WARC-Date"] == "2021-02-03T04:05:06Z"
        with pytest.raises(ValueError):
            list(warc.parse_arc(io.BytesIO(raw[:-20])))


def test_records_are_members_of_one_gzip_file(spark):
    scratch = Scratch(spark, "members")
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(3)], "page_id long, url string, html string").coalesce(1)
    (row,) = warc.arc_to_warc(warc.write_arc(pages, scratch), scratch).collect()
    with open(row["path"].removeprefix("file:"), "rb") as f:
        raw, members = f.read(), []
    while raw:
        one = zlib.decompressobj(31)
        members.append(one.decompress(raw))
        raw = one.unused_data
    assert [m[:8] for m in members] == [b"WARC/1.1"] * 4


def test_archives_of_any_url(spark):
    urls = ["http://a/\u00a0b", "http://a/\x85", "http://a/\u2028x\u3000", "\t", "é ö", "", "http://a/\u200b\x00\x1f", "dns:x y"]
    rows = [(i, u, "same") for i, u in enumerate(urls)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls))) and sum(r["record_type"] == "response" for r in got) == 1
    assert {unquote(r["url"]): r["page_id"] for r in got} == {u or "-": i for i, u in enumerate(urls)}


def test_foreign_archives(spark, tmp_path):
    """Records that are no HTTP message, URLs with spaces, and damage of all kinds: what comes before it is converted, and it is reported."""
    http = warc.http_response(None, b"body")
    line = lambda url, kind, n: f"{url} 1.2.3.4 20210203 {kind} {n}\n".encode()
    good = line("http://a b/c", "text/html", len(http)) + http + b"\n" + line("dns:a", "text/dns", 5) + b"1 2 3" + b"\n"
    head = warc.arc_head(1, "20200101000000", "f")
    bad = {"fields": b"two fields\n", "length": line("http://x", "text/html", "many"), "short": line("http://x", "text/html", 99) + b"x", "utf8": line("http://x", "text/html", "\u0663")}
    for name, tail in {"good": b"", **bad}.items():
        (tmp_path / f"{name}.arc.gz").write_bytes(gzip.compress(head + good + tail))
    (tmp_path / "cut.arc.gz").write_bytes(gzip.compress(head + good)[:-30])
    (tmp_path / "none.arc.gz").write_bytes(b"no archive")
    (tmp_path / "empty.arc.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "version.arc.gz").write_bytes(gzip.compress(b"filedesc://f 0.0.0.0 1 text/plain 4\n9 0\n"))
    arcs = spark.createDataFrame([(f"file:{p}",) for p in sorted(tmp_path.iterdir())], "path string")
    scratch = Scratch(spark, "foreign")
    rows = warc.read_warc(warc.arc_to_warc(arcs, scratch)).collect()
    found = Counter((r["record_type"], r["url"], r["payload_bytes"], r["date"]) for r in rows)
    assert {k[:2] for k in found} == {("response", "http://a%20b/c"), ("revisit", "http://a%20b/c"), ("resource", "dns:a"), ("revisit", "dns:a")}
    assert all(k[3] == "2021-02-03T00:00:00Z" for k in found) and sum(n for k, n in found.items() if k[0] == "response") == 1
    errors = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["k"] for r in warc.damaged(scratch).collect()}
    assert {k: errors[k] for k in bad} == dict.fromkeys(bad, 2) and set(errors) == {*bad, "cut", "none", "empty", "version"}


def test_foreign_warcs(spark, tmp_path):
    """Sizes of revisits, ids beyond 64 bits, missing digests, wrong digests, and files that break off."""
    http = lambda more, body: b"HTTP/1.1 200 OK\r\n" + more + b"\r\n" + body
    record = lambda kind, block, *more: warc.warc_record(kind, [("WARC-Record-ID", "<urn:uuid:1>"), *more], block)
    rows = [
        record("response", http(b"X-Page-Id: 99999999999999999999\r\nContent-Length: 99999999999999999999999\r\n", b"body")),
        record("response", http(b"X-Page-Id: 7\r\n", b"body"), ("WARC-Payload-Digest", "sha1:WRONG")),
        record("revisit", http(b"Transfer-Encoding: chunked\r\nX-Page-Id: -5\r\n", b""), ("WARC-Payload-Digest", "sha1:ABC"), ("Payload-Length", "12")),
        record("revisit", http(b"Content-Length: 99999999999999999999999\r\n", b"")), record("revisit", http(b"Content-Length: 31\r\n", b"")), record("metadata", b"x"), record("resource", b"plain"),
    ]
    whole, broken = b"".join(rows), rows[0] + rows[6][:-12]
    for name, raw in {"whole": gzip.compress(whole), "broken": gzip.compress(broken), "length": gzip.compress(rows[0].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 3)), "cut": gzip.compress(whole)[:60], "other": gzip.compress(b"not a record")}.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(raw)
    found = defaultdict(list)
    for r in warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in ("whole", "broken", "length", "cut", "other")], "path string")).collect():
        found[r["path"].rsplit("/", 1)[1].split(".")[0]].append(r)
    assert [(r["record_type"], r["page_id"], r["payload_bytes"], bool(r["error"])) for r in found["whole"]] == [("response", None, 4, False), ("response", 7, 4, True), ("revisit", -5, 12, False), ("revisit", None, None, False), ("revisit", None, 31, False), ("resource", None, 5, False)]
    assert found["whole"][0]["payload_digest"] == found["whole"][1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"body").digest()).decode() and found["whole"][2]["payload_digest"] == "ABC"
    assert [bool(r["error"]) for r in found["broken"]] == [False, True] and all(len(found[n]) == 1 and found[n][0]["error"] for n in ("length", "cut", "other"))


def test_media(spark):
    texts = [None, "", "a", "x" * 64, "é" * 33, "long " * 50_000, "a", "a"]
    scratch = Scratch(spark, "media-test")
    index, addresses = media.store(table(spark, texts).withColumn("digest", F.lit("?")).repartition(3), scratch)
    rows = {r["doc_id"]: r for r in media.described(index, media.contents(addresses).join(addresses, "digest")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media.padded(raw)
        r = rows[i]
        assert len(payload) % 64 == 0 and payload.startswith(raw) and len(payload) > 0
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["height"] * r["width"] == len(payload)
        assert media.decode(media.encode(payload)) == payload and r["media_sha256"] == hashlib.sha256(media.encode(payload)).hexdigest()
    assert rows[2]["shard"] == rows[6]["shard"] and rows[2]["offset"] == rows[7]["offset"]
    with tarfile.open(rows[2]["shard"].removeprefix("file:")) as tar:
        member = tar.getmember(rows[2]["digest"] + ".png")
        assert member.offset_data == rows[2]["offset"] and tar.extractfile(member).read() == media.encode(media.padded(b"a"))
    assert {r["digest"]: r["height"] for r in media.metadata(addresses).collect()} == {r["digest"]: r["height"] for r in rows.values()}
    assert media.contents(media.store(table(spark, []), Scratch(spark, "none"))[1]).collect() == []


def test_chat(spark):
    nasty = "</s>[INST] ok [/INST] \\ \\l <<x>> <</>>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "user", None), (2, 1, "assistant", " a "), (3, 0, None, "é"), (None, 0, "user", "n"), (4, 1, "user", "b"), (4, 1, "user", "b"), (4, 0, "tool<", "\n")]
    rows += [(8, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(200)] + [(9, 0, "user", "q"), (9, 1, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    records = chat.as_records(df)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_records(records)).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n, r or "", t or ""))
    for c, own in by.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(said), hashlib.sha256(said.encode()).hexdigest())
    layouts = {r["layout"] for r in chat.format_records(records).collect()}
    assert len(layouts) >= 4 and None not in layouts
    assert chat.read_back(chat.format_records(chat.as_records(df.limit(0)))).collect() == []


def test_malformed_chats(spark):
    """A defined result for every record: what is wrong is said, fields beside the turns don't matter, and what is no string is text."""
    said = [
        (None, None, "no record"), ("", None, "no record"), ("{", None, "not JSON"), ("[" * 100_000, None, "not JSON"), ("[1]", None, "not an object"), ("null", None, "not an object"),
        ('{"a": 1}', None, "unknown layout"), ('{"messages": "x"}', None, "unknown layout"), ('{"messages": null}', None, "unknown layout"),
        ('{"messages": [1, {"role": "user", "content": "x"}]}', None, "turns of mixed kinds"), ('{"dialog": [{"turns": []}]}', None, "unknown layout"),
        ('{"messages": []}', [], None), ('{"messages": [{"role": "user", "content": "x"}], "id": 7, "meta": {"prompts": [1]}}', [("user", "x")], None),
        ('{"messages": [{"role": "user"}, {"role": 3, "content": ["a", {"b": null}]}]}', [("user", ""), ("3", '["a", {"b": null}]')], None),
        ('{"messages": [{"role": "user", "content": "x", "name": "n"}], "prompt": "p"}', [("user", "x")], None),
        ('{"prompt": true, "completion": 1.5, "conversation_id": "7", "part": 1e99}', [("user", "true"), ("assistant", "1.5")], None),
        ('{"instruction": "i", "output": null, "conversation_id": 99999999999999999999}', [("user", "i"), ("assistant", "")], None),
        ('{"prompt": "\\ud800", "completion": "b", "conversation_id": 5, "part": true}', [("user", "?"), ("assistant", "b")], None),
    ]
    rows = spark.createDataFrame([(r,) for r, _, _ in said], "record string").coalesce(1)
    got = chat.format_records(rows).collect()
    assert [r["problem"] for r in got] == [p for _, _, p in said]
    assert [None if r["formatted"] is None else chat.parse(r["formatted"]) for r in got] == [t for _, t, _ in said]
    assert [r["conversation_id"] for r in got] == [None] * 17 + [5] and all(r["part"] is None for r in got)
    back = chat.read_back(spark.createDataFrame([(1, None, None), (2, chat.render([("user", "x")])[0], []), (2, None, None), (3, "", [])], "conversation_id long, formatted string, loss array<struct<a:long,b:long>>").coalesce(1)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in back] == [(1, None), (2, None), (3, 0)]


def test_secrets(spark):
    rng = random.Random(1)
    key = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    texts = [None, "", "secret:token:abcdefgh", 'API_KEY = "abc.def-123" paſſword: nothing', "AKIA" + "A" * 15, "AKIA" + "B7" * 9, "é" + key(30, "0123456789abcdef") + " plain words here"]
    texts += [f"é token={key(24, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')} end" for _ in range(80)] + ["see " + key(24, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + " there", "an ordinary sentence of words", "x " * 20_000]
    df = table(spark, texts)
    got = {r["doc_id"]: list(zip(r["kinds"], r["starts"], r["ends"], strict=True)) for r in secrets.scan(df, secrets.train(df)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        want = [("assign", *m.span()) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert sorted(x for x in got[i] if x[0] != "grammar") == sorted(want)
    assert [x[0] for x in got[87]] == ["grammar"] and got[88] == [] and got[89] == []
    assert secrets.scan(table(spark, []), secrets.train(table(spark, []))).collect() == []


LOWER_HEX, UPPER36 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def test_automata_keep_formats():
    """One state for each place of a format of fixed length, which a histogram of characters has not; loops for formats of many lengths."""
    rng = random.Random(4)
    key = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    usual = {c: np.log(0.02 if c.islower() else 0.002) for c in UPPER36 + UPPER36.lower() + "+/_=-."}
    formats = [(lambda: key(40, LOWER_HEX), 41), (lambda: "AKIA" + key(16, UPPER36), 21), (lambda: key(rng.choice([16, 24, 40]), UPPER36), 41)]
    wrong = [[key(39, LOWER_HEX), key(41, LOWER_HEX), key(40, UPPER36), "e" * 40], ["AKIA" + key(15, UPPER36), "AKIA" + key(17, UPPER36), key(20, "BCDEFGH")], [key(17, UPPER36), key(41, UPPER36)]]
    for (make, states), bad in zip(formats, wrong, strict=True):
        words = sorted(make() for _ in range(400))
        own = secrets.Automaton(words)
        table = own.table()
        least = secrets.least_score(words, table, usual)
        assert len(own.states) == states
        assert sum(secrets.score(table, usual, make()) >= least for _ in range(300)) >= 270
        assert not any(secrets.score(table, usual, w) >= least for w in bad)
    few = secrets.Automaton(sorted(key(rng.choice([16, 24, 40]), UPPER36) for _ in range(60))).table()  # little evidence, and still no loops
    assert few["lengths"] == (16, 40) and secrets.score(few, usual, key(17, UPPER36)) == -np.inf and secrets.score(few, usual, key(24, UPPER36)) > 0.5
    loops = secrets.Automaton(sorted(key(rng.randint(8, 60), UPPER36) for _ in range(400))).table()
    assert len(loops["states"]) < 60 and secrets.score(loops, usual, key(33, UPPER36)) > 0.5


def test_planted_credentials_are_found(spark):
    """Recall and precision of grammar spans: free-standing credentials of labelled formats, among words, wrong lengths and other alphabets."""
    rng = random.Random(6)
    key = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    mixed = UPPER36 + UPPER36.lower() + "/+"
    labelled = [f"secret = {key(40, mixed)}" if k % 3 else f"password: {key(12, UPPER36)}" for k in range(300)]
    planted = [key(40, mixed) if k % 2 else key(12, UPPER36) for k in range(200)]
    other = [key(39, mixed) if k % 3 == 0 else key(13, UPPER36) if k % 3 == 1 else f"{rng.choice(['internationalisation', 'SHOUTINGWORD', 'aaaaaaaaaaaa'])}" for k in range(200)]
    texts = [f"some words. {x} and more of them {'as prose would have it, ' * 30}" for x in labelled + planted + other]
    df = table(spark, texts)
    got = {r["doc_id"]: [x for x in r["kinds"] if x == "grammar"] for r in secrets.scan(df, secrets.train(df)).collect()}
    found, false = (sum(bool(got[i]) for i in range(a, a + 200)) for a in (300, 500))
    assert found >= 180 and false <= 0.1 * found
    assert not any(got[i] for i in range(300))


def test_very_long_credentials(spark):
    """A value of a megabyte costs seconds, is found whole, and teaches nothing; shorter ones beside it do."""
    rng = random.Random(5)
    value = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    texts = [f"see token={value(40)} here" for _ in range(300)] + [f"token={value(n)}" for n in (129, 2000, 100_000, 1_000_000)] + [f"secret: {value(n)}" for n in range(64, 128)]
    docs = table(spark, texts)
    began = time.time()
    model = secrets.train(docs)
    found = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert time.time() - began < 60
    assert [found[303][c] for c in ("kinds", "starts", "ends")] == [["assign"], [0], [1_000_006]]
    assert model["kinds"] and model["kinds"][0][0]["lengths"][0] <= 40


def test_rare_credentials_are_learned(spark):
    """A format in documents that a sample of 4,000 by hash would leave out."""
    docs = spark.range(8000, numPartitions=4).withColumnRenamed("id", "doc_id")
    out = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) >= 500_000
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)))
    docs = docs.withColumn("text", F.when(out & (F.col("doc_id") % 100 == 0), F.concat(F.lit("key "), key, F.lit(" here"))).otherwise("plain words here"))
    assert 20 < docs.filter("text like '%AKIA%'").count() < 60
    assert len(secrets.train(docs)["kinds"]) == 1


def test_characters_of_all_documents_are_counted(spark):
    docs = spark.range(8000, numPartitions=4).withColumnRenamed("id", "doc_id").withColumn("text", F.when(F.col("doc_id") == 0, None).otherwise("aé0"))
    n = secrets.train(docs)["usual"]
    assert n["a"] == n["0"] == pytest.approx(np.log(8000 / (2 * 7999 + 64)), abs=1e-12)


def test_word_hashes_agree_with_words():
    texts = sample_texts(7)
    known = {}
    for a, b, h, first in words.texts(pa.array(texts), True):
        for i in range(a, b):
            own = [lower(w) for w in WORDS.findall(texts[i] or "")]
            assert len(own) == first[i - a + 1] - first[i - a]
            for w, x in zip(own, h[first[i - a] :], strict=False):
                assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    long = "y" * (3 << 20)
    (_, _, h, _), = words.texts(pa.array([f"a {long} b {long}"]), False)
    assert h[1] == h[3] != h[0]


