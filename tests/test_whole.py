"""Queries against brute force where their SQL covers less than the whole table."""

import re
from collections import Counter, defaultdict
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscope.plans.queries import QUERIES, model_rows
from poolscope.sources.tables import table, texted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens(spark):
    """Every word of every document, apart from Spark's own split."""
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    out = {r[0]: [w for w in re.split(r"[\W_]+", (r[1] or "").lower()) if w] for r in rows}
    assert max(map(len, out.values())) > 1000
    return out


def bigrams(t):
    return [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)]


def test_document_terms_cover_whole_texts(spark, tokens):
    df = Counter(g for t in tokens.values() for g in set(bigrams(t)))
    assert {r["term"]: r["df"] for r in QUERIES["bigram_df"](spark, SF).collect()} == df
    both = Counter(g for t in tokens.values() for g in {*t, *bigrams(t)})
    assert {r["term"]: r["df"] for r in QUERIES["public_ngrams"](spark, SF).collect()} == {g: n for g, n in both.items() if n >= 20}
    hashed = defaultdict(int)
    for r in QUERIES["hashed_terms"](spark, SF).collect():
        hashed[r["id"]] += r["tf"]
    assert hashed == {i: len(t) + max(0, len(t) - 1) for i, t in tokens.items() if t}


def test_tfidf_covers_whole_texts(spark, tokens):
    fitted = list(tokens.values())
    df = Counter(w for t in fitted for w in set(t))
    idf = {w: log((1 + len(fitted)) / (1 + n)) + 1 for w, n in df.items()}
    got = defaultdict(dict)
    for r in QUERIES["tfidf_terms"](spark, SF).collect():
        got[r["id"]][r["term"]] = r["w"]
    for i, t in tokens.items():
        x = {w: n * idf[w] for w, n in Counter(t).items()}
        norm = sqrt(sum(v * v for v in x.values()))
        assert got[i] == pytest.approx({w: v / norm for w, v in x.items()}, abs=2e-6)


def test_support_is_of_volume_and_similarity(spark):
    rows = [r for r in model_rows(spark, SF).select("year", "c", "h", "v", "g").collect() if r["year"] <= 2000]
    want = {}
    for channel, pair in (("current", "ch"), ("recent", "vg")):
        q = {x: np.quantile([r[x] for r in rows if r[x] is not None], [0.25, 0.75]) for x in pair}
        for k, endpoint in enumerate(("low", "high")):
            want[channel, endpoint] = sum(all(r[x] is not None and abs(r[x] - q[x][k]) <= 0.1 * (q[x][1] - q[x][0]) for x in pair) for r in rows)
    got = QUERIES["support_count"](spark, SF).collect()
    assert {(r["channel"], r["endpoint"]): r["n"] for r in got} == want and len(got) == 4 and sum(want.values()) > 0


def test_texts_are_whole_and_masks_come_first(spark, tokens):
    assert {r["id"] % len(tokens): r["tokens"] for r in texted(spark, SF, field="description").collect()} == {i: t for i, t in tokens.items()}
    said = [r[0] for r in table(spark, SF, "conversations").filter("turn = 0").orderBy("conv_id").select("text").collect()]
    assert all(r["tokens"] == [w for w in re.split(r"[\W_]+", said[r["id"] % len(said)].lower()) if w] for r in texted(spark, SF).collect())
    plain, hidden = (texted(spark, SF, field="description", mask=m).select("tokens") for m in (False, True))
    digits = F.size(F.filter("tokens", lambda w: w.rlike("^[0-9]+$")))
    counts = [df.agg(F.sum(digits)).first()[0] for df in (plain, hidden)]
    assert counts[0] > 100 and counts[1] < counts[0] / 10
