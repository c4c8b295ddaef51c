import hashlib
import os
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolscope.functions.tails import chi2_upper, f_upper, t_quantile, t_two_sided
from poolscope.operators import effects, features, hdfe, holdout, pools, profile, qa, text
from poolscope.operators import homogeneity as hom
from poolscope.plans.oracles import ORACLES
from poolscope.plans.queries import QUERIES
from poolscope.plans.spec import DAY, SPEC
from poolscope.sources import sinks
from poolscope.sources.tables import micros

SF = "/root/testdata/sf0.001"
QUICK = [n for n in ORACLES if n not in ("residual_text", "homogeneity_audit", "recent_homogeneity_description", "zscore_interactions", "regime_by_year", "market_trigger")]


def plain(df):
    out = df[sorted(df.columns)].copy()
    rows = [tuple(None if pd.isna(v) else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v) for v in r) for r in out.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.sql(ORACLES[name]).df())


def listing(spark, rows):
    """rows: id, days listed, days to funding, sector."""
    return spark.createDataFrame([(i, int(a * DAY), int((a + b) * DAY), s) for i, a, b, s in rows], "id long, u0 long, u1 long, sector string")


def test_pool_boundaries(spark):
    rows = listing(spark, [(1, 0, 10, "a"), (2, 0, 10, "a"), (3, 10, 1, "a"), (4, 5, 0, "a"), (5, 5, 3, "b"), (6, 35, 1, "a"), (7, 65, 1, "a"), (8, 100, 1, "c")])
    n = {r["id"]: r["n"] for r in pools.pool(rows).collect()}
    assert n == {1: 1, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0}
    recent = {r["id"]: (r["n"], round(r["v"], 9)) for r in pools.pool(rows, "recent").collect()}
    assert recent[6] == (2, round(2 * 2**-5, 9))  # ages 35 count; 25 and 30 do not
    assert recent[7][0] == 2  # ages 55 and 60; 65 no longer
    assert recent[8] == (0, 0.0)


def test_sweep_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 400)), float(rng.integers(0, 90)), "abc"[int(rng.integers(3))]) for i in range(300)]
    got = {r["id"]: r["n"] for r in pools.pool(listing(spark, rows)).collect()}
    for i, a, _, s in rows:
        assert got[i] == sum(s == t and j != i and x <= a < x + y for j, x, y, t in rows)


@pytest.mark.parametrize("span", [40 * DAY, 3_600_000_000])
def test_sweep_of_distinct_instants(spark, span):
    """Every listing at a microsecond of its own, over a block or crowded into an hour of it, before and after 1970."""
    rng = np.random.default_rng(6)
    spec = replace(SPEC, lag_from_days=span / DAY / 10, lag_to_days=span / DAY / 3)
    rows = [(i, int(u), int(u + h), "ab"[int(s)]) for i, (u, h, s) in enumerate(zip(rng.integers(-span // 2, span // 2, 400), rng.integers(0, span // 4, 400), rng.integers(0, 2, 400), strict=True))]
    df = spark.createDataFrame(rows, "id long, u0 long, u1 long, sector string")
    found = [{r["id"]: r for r in pools.pools(df, ["current", "recent", "completed"], [], spec).collect()}]
    low, high = int(span / 10), int(span / 3)
    for i, u, _, _ in rows:
        near = [(u - x, y <= u) for j, x, y, _ in rows if j != i and low <= u - x < high]
        for got in found:
            assert got[i]["n_current"] == sum(x <= u < y for j, x, y, _ in rows if j != i) and got[i]["n_recent"] == len(near)
            assert got[i]["n_completed"] == sum(done for _, done in near)
            assert got[i]["v_recent"] == pytest.approx(sum(2 ** (-g / (7 * DAY)) for g, _ in near), abs=1e-9)


def test_weights_hold_over_any_span(spark):
    """Listings decades apart, in the same and in other groups, change nothing for the rest."""
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 200)), float(rng.integers(1, 60)), "ab"[int(rng.integers(2))]) for i in range(120)]
    far = [(1000 + k, a + 365.25 * years, 20.0, s) for k, (years, a, s) in enumerate([(-50, 0, "c"), (-50, 0, "a"), (-50, 40, "a"), (40, 3, "a"), (40, 45, "a"), (90, 1, "b")])]
    for kind in ("recent", "completed"):
        alone, both = ({r["id"]: (r["n"], round(r["v"], 9)) for r in pools.pool(listing(spark, x), kind).collect()} for x in (rows, rows + far))
        assert {i: both[i] for i in alone} == alone
        for i, a, _, s in rows + far:
            ages = [a - x for j, x, y, t in rows + far if t == s and j != i and 35 <= a - x < 65 and (kind == "recent" or x + y <= a)]
            assert both[i] == (len(ages), pytest.approx(sum(2 ** (-g / 7) for g in ages), abs=1e-9))
    words = spark.createDataFrame([(r[0], [f"t{int(x)}" for x in rng.integers(0, 40, 9)]) for r in rows + far], "id long, tokens array<string>")
    df = listing(spark, rows + far)
    vectors = text.vectors(words, F.col("tokens"), F.lit(True)).persist()
    one = hom.audit(hom.homogeneity(own_texts(df), packed(words), "recent"), hom.pairwise(df, vectors, df, "recent")).first()
    assert one["checks"] > 40 and one["max_error"] < 1e-9
    slow = replace(SPEC, half_life_days=400.0)
    got = {r["id"]: r["v"] for r in pools.pool(df, "recent", spec=slow).collect()}
    for i, a, _, s in rows + far:
        assert got[i] == pytest.approx(sum(2 ** (-(a - x) / 400) for j, x, y, t in rows + far if t == s and j != i and 35 <= a - x < 65), abs=1e-9)


def test_packed_vectors_weigh_copies(spark):
    """Texts that several training rows share count for each of them, and terms that no training row has are left out."""
    texts = {1: ["a", "b", "a"], 2: ["b", "c"], 3: ["z"], 4: []}
    copies = [1, 1, 1, 2, 4]
    rows = spark.createDataFrame([(k, i, texts[i]) for k, i in enumerate([*copies, 3])], "id long, text_id long, tokens array<string>")
    want = {(r["id"], r["term"]): r["w"] for r in text.vectors(rows, F.col("tokens"), F.col("id") < len(copies)).collect()}
    words = rows.select("text_id", "tokens").dropDuplicates(["text_id"])
    got = text.packed_vectors(words, rows.filter(F.col("id") < len(copies)).groupBy("text_id").agg(F.count("*").alias("n"))).collect()
    for k, i in enumerate([*copies, 3]):
        assert sorted(round(w, 12) for r in got if r["text_id"] == i for w in r["weights"]) == sorted(round(w, 12) for (j, _), w in want.items() if j == k)
    assert all(len(set(r["slots"])) == len(r["slots"]) for r in got)


def test_kinds_share_a_sweep(spark):
    rng = np.random.default_rng(5)
    rows = listing(spark, [(i, float(rng.integers(0, 150)), float(rng.integers(0, 60)), "ab"[int(rng.integers(2))]) for i in range(150)])
    kinds = ["current", "recent", "completed", "mirror14d"]
    together = {r["id"]: r for r in pools.pools(rows, kinds).collect()}
    for kind in kinds:
        for r in pools.pool(rows, kind).collect():
            assert r["n"] == together[r["id"]][f"n_{kind}"]
            assert "v" not in r or r["v"] == pytest.approx(together[r["id"]][f"v_{kind}"], abs=1e-12)


def own_texts(df):
    return df.withColumn("text_id", F.col("id"))


def packed(words):
    return text.packed_vectors(words.select(F.col("id").alias("text_id"), "tokens"), words.select(F.col("id").alias("text_id"), F.lit(1).alias("n")))


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_homogeneity_equals_pairs(spark, monkeypatch, step):
    kinds = ("current", "recent", "completed", "mirror14d")
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 200)), float(rng.integers(1, 60)), "abc"[int(rng.integers(3))]) for i in range(200)]
    words = spark.createDataFrame([(i, [f"t{int(x)}" for x in rng.integers(0, 60, 12)]) for i in range(200)], "id long, tokens array<string>")
    df = listing(spark, rows)
    vectors = text.vectors(words, F.col("tokens"), F.lit(True)).persist()
    monkeypatch.setattr(hom, "STEP", step)
    together = hom.similarities(own_texts(df), packed(words), list(kinds)).persist()
    for kind in kinds:
        pairs = hom.pairwise(df, vectors, df, kind).persist()
        for one in (hom.homogeneity(own_texts(df), packed(words), kind), together.select("id", F.col(f"h_{kind}").alias("h"))):
            found = hom.audit(one, pairs).first()
            assert found["checks"] > 20 and found["max_error"] < 1e-9


def panel(seed=3, n=400):
    rng = np.random.default_rng(seed)
    g, w = rng.integers(0, 8, n), rng.integers(0, 12, n)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 0.5 * x1 - 0.2 * x2 + g * 0.3 + w * 0.1 + rng.normal(size=n)
    return x1, x2, g, w, y


@pytest.mark.parametrize("most", [2000, 5])
def test_fixed_effects_equal_dummies(spark, monkeypatch, most):
    monkeypatch.setattr(hdfe, "MOST_LEVELS", most)  # 5: absorbed by the cluster
    x1, x2, g, w, y = panel()
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d), float(e)) for a, b, c, d, e in zip(x1, x2, g, w, y, strict=True)], "x1 double, x2 double, g int, w int, y double")
    df = df.withColumn("same", F.col("g"))  # a collinear effect
    fit = hdfe.fit(df, "y", ["x1", "x2"], ["g", "w", "same"], ["g", "w"])
    d = np.column_stack([g[:, None] == np.arange(8), w[:, None] == np.arange(12)]).astype(float)
    x = np.column_stack([x1, x2])
    full = np.column_stack([x, d])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.allclose(fit.beta, beta[:2], atol=1e-8)
    resid = y - full @ beta
    xt = x - d @ np.linalg.lstsq(d, x, rcond=None)[0]
    bread, cov = np.linalg.inv(xt.T @ xt), np.zeros((2, 2))
    for sign, key in ((1, g), (1, w), (-1, g * 100 + w)):
        groups = np.unique(key)
        s = np.array([(xt[key == k] * resid[key == k, None]).sum(0) for k in groups])
        cov += sign * s.T @ s * len(groups) / (len(groups) - 1)
    assert np.allclose(fit.cov, bread @ cov @ bread, atol=1e-8)
    assert fit.df == 7
    plain = hdfe.fit(df, "y", ["x1", "x2"], [], ["g"])
    assert np.allclose(plain.beta, np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)[0][:2], atol=1e-8)
    f, k, p = fit.joint(["x1", "x2"])
    assert k == 2 and f > 0 and 0 <= p <= 1


def test_tails():
    assert abs(t_two_sided(2.776445, 4) - 0.05) < 1e-6
    assert abs(f_upper(4.102821, 2, 10) - 0.05) < 1e-6
    assert abs(chi2_upper(3.841459, 1) - 0.05) < 1e-6
    assert abs(t_quantile(0.95, 45) - 2.014103) < 1e-5


def test_scenario_and_percent():
    fit = hdfe.Fit(["a", "b", "ab"], np.array([0.1, 0.2, 0.3]), np.eye(3) * 0.01, 10, 5)
    value, *_ = fit.contrast(effects.scenarios(fit, {"": ("a", "b", "ab")}, {"a": (-1.0, 1.0), "b": (-2.0, 3.0)})[""])
    assert abs(value - (0.1 * 2 + 0.2 * 5 + 0.3 * (3 - 2))) < 1e-12
    assert abs(hdfe.percent(np.log(2)) - 100) < 1e-9


def test_phrases_and_residual(spark):
    rows = spark.createDataFrame([(i, ["a", "b", "c", "d", "e", f"x{i}"], c) for i, c in enumerate(["p", "q", "r"])] + [(9, [], "p"), (10, ["z"], "q")], "id long, t array<string>, country string")
    found = text.recurring_phrases(rows, "t", 3, 3)
    assert [tuple(r) for r in found.collect()] == [("a b c d e", 3, 3)]
    assert text.recurring_phrases(rows, "t", 4, 3).isEmpty() and text.recurring_phrases(rows, "t", 3, 4).isEmpty()
    left = {r[0]: r[1] for r in text.residual(rows, "t", found).collect()}
    assert left == {0: ["x0"], 1: ["x1"], 2: ["x2"], 9: [], 10: ["z"]}


@pytest.mark.parametrize("counters", [1 << 14, 64])
def test_sketch_loses_no_frequent_term(spark, monkeypatch, counters):
    """Exact counts at any size of the sketch, of terms at the threshold, of hot ones, and with null, empty and repeated terms."""
    monkeypatch.setattr(text, "COUNTERS", counters)
    rng = np.random.default_rng(7)
    docs = [["hot", "hot", *(f"t{int(x)}" for x in rng.zipf(1.3, 30) % 5000), f"rare{i}"] for i in range(300)] + [None, [], [None, "", "hot"], ["", ""]]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, t array<string>")
    for least in (1, 5, 40, 1000):
        want = Counter(w for d in docs for w in set(d or []))
        got = text.document_counts(rows, F.col("t"), least).collect()
        assert {r["term"]: r["df"] for r in got} == {w: n for w, n in want.items() if n >= least} and len(got) == len({r["term"] for r in got})
    passed = text.frequent_terms(rows, F.col("t"), 40, ["id"])
    assert passed.columns == ["id", "term"] and (counters == 64 or passed.count() < 2 * sum(n for n in want.values() if n >= 40))
    assert text.document_counts(rows.limit(0), F.col("t"), 1).count() == 0


def test_char_ngrams_of_any_text(spark):
    texts = [None, "", "ab", "abc", "é😀b😀", "x" * 300_000 + "yz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["g"] for r in rows.select("id", text.char_ngrams(F.col("t")).alias("g")).collect()}
    assert got == {i: [t[k : k + 3] for k in range(len(t or "") - 2)] if t else [] for i, t in enumerate(texts)}


def test_masks_hide_names(spark):
    rows = spark.createDataFrame([("In new york and York on 2020-01-02, $5.00 or 12 of Yorkshire.",)], "t string")
    assert rows.select(text.masked(F.col("t"), ["York", "New York"])).first()[0] == "In <NAME> and <NAME> on <DATE>, <AMOUNT> or <NUMBER> of Yorkshire."


def test_dictionary_masks(spark):
    """Longest runs, overlapping and touching names, any case and separators, nulls, texts without words, names without words."""
    names = ["New York", "york city", "Ann", "O'Neil", "Zoë", "New", "!!", None, "a b c"]
    texts = ["In new  YORK city, Ann met o'neil; Anna and York did not.", "Zoë", " zoë-ann ", None, "", "...", "none here", "a b a b c, a b", "NEW new", "x" * 50_000 + " ann"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, w int")
    got = {r["id"]: (r["text"], r["n_names"]) for r in text.dictionary_masked(rows, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = ["In <NAME> met <NAME>; Anna and York did not.", "<NAME>", " <NAME> ", None, "", "...", "none here", "a b <NAME>, a b", "<NAME>", "x" * 50_000 + " <NAME>"]
    assert {i: t for i, (t, _) in got.items()} == dict(enumerate(want)) and [got[i][1] for i in range(10)] == [2, 1, 1, 0, 0, 0, 0, 1, 1, 1]
    assert text.dictionary_masked(rows, spark.createDataFrame([], "name string")).filter("n_names > 0").isEmpty()


def test_standardised_uses_training_rows(spark):
    rows = spark.createDataFrame([(1.0, True), (3.0, True), (100.0, False)], "a double, train boolean")
    z = [r["z_a"] for r in features.standardised(rows, ["a"], F.col("train")).orderBy("a").collect()]
    assert np.allclose(z, [-(2**-0.5), 2**-0.5, 98 / 2**0.5])


def test_verdicts_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0.1, 0.2), (-0.1, 0.005), (-0.1, 0.2)], "low double, high double")
    assert [r["verdict"] for r in effects.meaningful(rows, 0.01).collect()] == ["effect", "negligible", "inconclusive"]
    sinks.write_shards(spark.range(100).toDF("x"), str(tmp_path / "p"), 3)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 100
    sinks.write_csv(rows, str(tmp_path / "c"))
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 3
    assert sinks.manifest(spark, str(tmp_path / "j")).filter("length(sha256) = 64").count() >= 1
    assert "low" in sinks.write_report(rows, str(tmp_path / "r.txt"))
    assert profile.duplicate_ids(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").first()["n"] == 2
    (tmp_path / "big.bin").write_bytes(b"ab" * 10_000_000)
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in sinks.manifest(spark, str(tmp_path)).collect()}
    assert found["big.bin"] == (20_000_000, hashlib.sha256(b"ab" * 10_000_000).hexdigest())
    assert SPEC.table(spark).count() > 10


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 40)) / 40 if k % 2 else float(rng.random())) for k in range(300)] + [(1, 1.0), (0, 0.0), (0, 1.0)]
    pos, neg = ([p for y, p in rows if y == k] for k in (1, 0))
    want = np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in neg] for a in pos])
    assert abs(holdout.auc(spark.createDataFrame(rows, "flag int, prob double"), "flag", "prob").first()[0] - want) < 1e-12


def test_times_without_zone_are_utc(spark):
    df = spark.sql("select timestamp_ntz'2021-07-01 12:00:00' as a, timestamp'2021-07-01 12:00:00' as b")
    want = 1625140800000000
    assert [df.select(micros(df, c)).first()[0] for c in "ab"] == [want, want]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.sql("select timestamp_ntz'2021-07-01 12:00:00' as a").select(micros(df, "a")).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_gates_count_what_offends(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, n int")
    got = {r["gate"]: (r["passed"], r["offending"]) for r in qa.gates([(rows, {"known": F.col("n").isNull(), "positive": F.col("n") < 0, "small": F.col("id") > 9})]).collect()}
    assert got == {"known": (False, 1), "positive": (False, 1), "small": (True, 0)}
    assert QUERIES["qa_gates"](spark, SF).count() == 20
