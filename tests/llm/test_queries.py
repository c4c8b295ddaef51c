"""The columns of the queries that SQL cannot express, against their contracts, on whole tables and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from poolscope.llm import media
from poolscope.llm.queries import QUERIES
from tests.llm.test_operators import WORDS, brute_targets

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "é" * 33), (5, "word " * 40_000), (6, "same text"), (7, "same text"), (None, "no id"), (9, "x" * 64), (9, "again " * 3), (11, 'token="0123456789abcdef0123456789abcdef01234567" é PASSWORD: sécret')]


@pytest.fixture(scope="module", params=["fixture", "odd", "empty"])
def folder(request, spark, tmp_path_factory):
    if request.param == "fixture":
        return SF
    path = str(tmp_path_factory.mktemp(request.param))
    rows = [(i, t, "en" if k % 2 else None, ["a", None, "b"][k % 3], None, "clash") for k, (i, t) in enumerate(ODD)] if request.param == "odd" else []
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string").write.parquet(f"{path}/documents.parquet")
    return path


def both(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = QUERIES[name](spark, folder).collect()
    assert len(got) == len(docs)
    return docs, got


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def test_op1(spark, folder):
    docs, got = both(spark, folder, "op1_source_mixing")
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(WORDS.findall(d["text"] or ""))
    targets, taken, source = brute_targets(dict(size)) if docs else {}, defaultdict(int), {d["doc_id"]: d["source"] for d in docs}
    sizes = defaultdict(list)
    for d in docs:
        sizes[d["doc_id"]].append(len(WORDS.findall(d["text"] or "")))
    shards, longest = set(), defaultdict(int)
    for i, rows in by_id(got).items():
        assert sorted(r["size"] for r in rows) == sorted(sizes[i])
        for r in rows:
            s = source[i] if len(rows) == 1 else next(s for s in size if size[s] == r["source_size"])
            assert r["source_size"] == size[s] and r["target"] == pytest.approx(targets[s], abs=1e-6) and 0 <= r["taken"] <= 3 * r["size"]
            assert r["taken"] == r["size"] * len(r["shards"] or ())
            taken[s] += r["taken"]
            longest[s] = max(longest[s], r["size"])
            shards |= set(r["shards"] or ())
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(1, longest[s])
    if folder == SF:
        assert all(abs(taken[s] - t) <= 0.02 * t for s, t in targets.items()) and shards == set(range(8))
    key = lambda r: (str(r["doc_id"]), r["taken"], str(r["shards"]))
    assert sorted(map(key, got)) == sorted(map(key, QUERIES["op1_source_mixing"](spark, folder).collect()))


def test_op2(spark, folder):
    docs, got = both(spark, folder, "op2_language_id")
    texts, right = defaultdict(list), []
    for d in docs:
        texts[d["doc_id"]].append(d)
    learned = {d["lang"] for d in docs if d["lang"] and zlib.crc32(str(d["doc_id"]).encode()) % 5}
    for i, rows in by_id(got).items():
        assert sum(r["lang_pred"] == "und" for r in rows) == sum(not re.search(r"[^\W\d_]", d["text"] or "") for d in texts[i])
        for r in rows:
            assert r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1
            assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        if rows[0]["held_out"]:
            right += [r["lang_pred"] == d["lang"] for r, d in zip(rows, texts[i], strict=True) if d["lang"]]
    assert folder != SF or np.mean(right) > 0.97 and len(right) > 20


def test_op5(spark, folder):
    docs, got = both(spark, folder, "op5_media_columns")
    want = defaultdict(list)
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.encode(payload)
        assert media.decode(stored) == payload
        want[d["doc_id"]].append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload), 64, len(payload) // 64, 8))
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits"]
    for i, rows in by_id(got).items():
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want[i])


def test_op7(spark, folder):
    docs, got = both(spark, folder, "op7_secret_scan")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        found = [[("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]]
        found += [[(k, *m.span()) for m in re.finditer(p, t) if m.end() - m.start() >= n] for k, p, n in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))]
        spans = sorted((a, k, b) for k, own in enumerate(found) for _, a, b in own)
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want[d["doc_id"]].append((*map(len, found), hashlib.sha256(base.encode()).hexdigest(), base))
    for i, rows in by_id(got).items():
        assert sorted((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], ",".join(x for x in r["spans"].split(",") if x and not x.startswith("grammar"))) for r in rows) == sorted(want[i])
    assert not got or any(r["n_hex"] for r in got)
