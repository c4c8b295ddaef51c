"""Operators 11 to 13 against brute force, on odd rows, and their queries against their SQL on whole tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from poolscope.llm import panes, quality, variants
from poolscope.llm.oracles import ORACLES
from poolscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
HOUR, DAY = 3_600_000_000, 86_400_000_000


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_quality_rules", "op13_window_panes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("documents", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in got.select(*columns).collect()) == key(want.fetchall()) and set(got.columns) == set(columns)


# 11


def edits(a, b):
    """Whether one insertion, deletion or replacement makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, spoil=0, least_chars=7, least_n=2, times=10):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(w, v)] for w in words}
    form = {}
    for w, those in near.items():
        best = min(those, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def odd_words(seed=1):
    rng = random.Random(seed)
    stem = lambda k: "".join(rng.choice("abÀéß÷") for _ in range(k))
    words = [stem(rng.randrange(6, 11)) for _ in range(160)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa"]
    long = "".join(rng.choice("abc") for _ in range(400))
    for w in [*words[:60], long, "q" * 128, "q" * 129, "q" * 130, long[:200] + "x" + long[200:], long[:70] + "y" + long[71:], long[:-70] + long[-69:]]:
        words.append(w)
        for _ in range(2):
            p = rng.randrange(len(w))
            words += [w[:p] + w[p + 1 :], w[:p] + rng.choice("abé") + w[p:], w[:p] + "b" + w[p + 1 :]]
    texts = [" ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(words, k=60)) for _ in range(40)]
    texts += ["1 ".join(words), "-".join(words), "abcdefgh " * 1000 + "abcdefgx " * 100 + "abcdefyx " * 10 + "abcdezyx " * 2, None, "", "12 \n", "abcdefghi " * 9]
    return [(None if i % 17 == 3 else i % 50, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("spoil", [0, 3])
def test_variants(spark, monkeypatch, hot, spoil):
    """Every near pair once, also where segments are dealt to several shards, words are longer than a segment, and texts or ids are null."""
    if hot:
        monkeypatch.setattr(variants, "POSTINGS", 3)
        monkeypatch.setattr(variants, "SHARD", 25)
        monkeypatch.setattr(variants, "GATHERED", 5)
    rows = odd_words()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in variants.spelling_variants(docs, spoil=spoil).collect()]
    want = brute_variants(rows, spoil)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] is not None and r[1] != r[2] for r in want) and any(len(r[0]) > 300 and r[4] for r in want)


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(docs).collect() == []
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (None, ""), (2, "short words here")], "doc_id long, text string")).collect() == []


# 12

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p for those in at.values() if len(those) > 1 for i in those for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD_TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e f", "a a a a a a", "a b c d e " * 2, "x y " * 30, "same line here\n" * 5, "same line here\nsame line here \n\nsame line here",
    "#*$%&|<> " * 4, "the words of a text that is plain and clean and has no fault at all in it, as was to be shown by this", "a" * 100_000, "é à ü ñ " * 3, "\x0b".join("abcdefghijk"),
    " ".join(f"w{i}" for i in range(40_000)) + " " + " ".join(f"w{i}" for i in range(100)), "a\xa0b c d " * 3, "THE WORDS OF A TEXT THAT IS LOUD AND HAS NO OTHER FAULT", "- a\n- b\n* the c of d\n• e and f to g\n",
    "so it goes...\nand on and on it goes in the end …\nthe end", "\U0001f600 " * 12,
]


def test_rules_count_what_they_say(spark):
    texts = [*ODD_TEXTS, *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    docs = spark.createDataFrame([(i, t, "x", 7, None) for i, t in enumerate(texts)], "doc_id long, text string, kept string, words int, n_words long")
    rows = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, want = rows[i], brute_counts(t or "")
        assert tuple(r[c] for c in quality.COUNTS[:5]) == want, (i, t and t[:80])
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r["words"] == 7 and r["text"] == t
        assert r["kept"] == (not r["failed"]) and (not r["base_failed"] or not r["kept"])
    failed = {i: set(rows[i]["failed"]) for i in range(len(ODD_TEXTS))}
    assert failed[12] == set() and failed[18] == {"capitals"} and "bullet lines" in failed[19] and "cut lines" in failed[20] and "symbols to words" in failed[11]
    assert {"repeated words", "repeated lines"} <= failed[9] and failed[16] == {"stop words"}


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    own = [quality.Rule("length", "n_words", None, 2), quality.Rule("symbols", "n_symbols", 1, None)]
    out = quality.quality(docs, own, [own[0]])
    assert sorted((r["doc_id"], *r["failed"]) for r in out.collect()) == [(1, "length", "symbols"), (2, "symbols"), (2, "symbols")]
    assert [r["base_failed"] for r in out.orderBy("doc_id").collect()] == [True, False, False]
    assert "Python" not in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="no feature"):
        quality.quality(docs, [quality.Rule("x", "no such", 0, 1)])
    assert quality.quality(docs.filter("false")).collect() == []


def test_rules_keep_clean_documents(spark):
    """Held against labels that the rules have never seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, rows))
    assert share[1] > 0.99 and share[0] < 0.05


# 13


def brute_panes(rows, batches=8, due=6 * HOUR, keep=4 * DAY):
    """rows: (batch, click_id, event, hour, kind, cents)."""
    w, state, out = -math.inf, {}, []
    for b in range(batches):
        own = [r for r in rows if r[0] == b]
        fresh = {}
        for _, click, _, hour, kind, cents in own:
            if w >= (hour + 1) * HOUR + keep:
                out.append((b, hour, click, 1, cents, "late", kind))
            else:
                n, c = fresh.get((hour, kind), (0, 0))
                fresh[hour, kind] = n + 1, c + cents
        for (hour, kind), (n, c) in fresh.items():
            old = state.get((hour, kind), (0, 0, False))
            state[hour, kind] = (old[0] + n, old[1] + c, old[2])
            if old[2]:
                out += [(b, hour, -1, *old[:2], "retract", kind), (b, hour, -1, *state[hour, kind][:2], "replace", kind)]
        for (hour, kind), (n, c, emitted) in sorted(state.items()):
            if not emitted and w >= (hour + 1) * HOUR + due:
                out.append((b, hour, -1, n, c, "emit", kind))
                state[hour, kind] = n, c, True
            elif not emitted and b == batches - 1:
                out.append((b, hour, -1, n, c, "final", kind))
            if w >= (hour + 1) * HOUR + keep:
                del state[hour, kind]
        w = max([w, *(r[2] for r in own)])
    return sorted(out, key=str)


def test_panes(spark):
    """Two empty batches, hours before 1970, a hot pane, late rows, revisions in several batches."""
    rng = random.Random(3)
    rows = []
    for k in range(900):
        b = rng.choice([0, 1, 1, 2, 4, 4, 6, 7])
        event = (b - 1) * DAY + rng.randrange(DAY) - (rng.randrange(7 * DAY) if rng.random() < 0.2 else 0)
        if k % 3 == 0:
            event = 5 * HOUR + k
        rows.append((b, k, event, event // HOUR, rng.choice(["a", "none", "é"]), rng.randrange(-50, 500)))
    table = spark.createDataFrame(rows, "batch long, click_id long, event long, hour long, kind string, cents long").repartition(3)
    got = sorted((tuple(r) for r in panes.revised(table, shards=3).collect()), key=str)
    want = brute_panes(rows)
    assert got == want and {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"} and min(r[1] for r in want) < 0


def test_clicks_are_dealt_once(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [
        (1, t, t, "view", 1.005, "p"), (1, t, t, "view", 1.005, "p"), (1, t, t + timedelta(days=1), "view", 3.0, "p"), (2, None, t, "view", 1.0, None), (3, t, None, None, None, None), (None, t, t, "a", float("nan"), None),
        (None, t, t, "b", 2.0, None), (4, t - timedelta(days=400), t, "view", float("inf"), None), (5, t, t, "view", -0.005, None), (6, t, t, "view", 1e300, None),
    ]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp, arrived_at timestamp, kind string, value double, batch string")
    got = {r["click_id"]: r for r in panes.dealt(clicks).collect()}
    assert set(got) == {1, 3, None, 4, 5, 6} and got[1]["cents"] == math.floor(100 * 1.005 + 0.5) and got[3]["kind"] == "none" and got[3]["cents"] == 0
    assert got[None]["kind"] == "a" and [got[i]["cents"] for i in (None, 4, 5, 6)] == [0, 0, 0, 0]
    day = 19723
    for i, r in got.items():
        late = max(0, zlib.crc32(("" if i is None else str(i)).encode()) % 30 - 23)
        assert r["batch"] == min(7, day % 8 + late) and r["hour"] == r["event"] // HOUR
    assert got[1]["event"] == 12 * HOUR + day % 8 * DAY and got[4]["event"] == got[1]["event"] - 400 * DAY and got[4]["hour"] < 0


def test_no_clicks(spark):
    clicks = spark.createDataFrame([], "click_id long, ts timestamp, arrived_at timestamp, kind string, value double")
    assert panes.revised(panes.dealt(clicks), batches=2, shards=2).collect() == []
