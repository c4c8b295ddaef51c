"""Estimators against numpy: several models at once, many levels, permutations, group contrasts, selected quantiles."""

import io
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolscope.functions.tails import chi2_upper
from poolscope.operators import effects, features, hdfe, holdout, quantiles
from poolscope.plans.queries import QUERIES
from poolscope.sources import sinks

SF = "/root/testdata/sf0.001"


def demeaned(x, *groups, rounds=2000):
    """Columns less what the effects explain, by dummies."""
    d = np.column_stack([(g[:, None] == np.unique(g)).astype(float) for g in groups])
    return x - d @ np.linalg.lstsq(d, x, rcond=None)[0]


def panel(seed=3, n=500):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"a": rng.integers(0, 9, n), "b": rng.integers(0, 14, n), "c": rng.integers(0, 40, n)})
    for c in ("x1", "x2", "x3", "u"):
        df[c] = rng.normal(size=n)
    df["y"] = 0.5 * df.x1 - 0.2 * df.x2 + 0.1 * df.a + df.u
    df["y2"] = df.x3 - 0.3 * df.x1 + 0.05 * df.c + rng.normal(size=n)
    df.loc[df.index % 11 == 3, "x3"] = np.nan
    return df


def brute(df, models, groups, clusters):
    """Slopes of all models, and their joint covariance."""
    parts, betas, counts, dofs = [], [], [], []
    for ys, xs in models.values():
        own = df.dropna(subset=[*ys, *xs])
        v = demeaned(own[[*ys, *xs]].to_numpy(), *(own[g].to_numpy() for g in groups))
        y, x = v[:, : len(ys)], v[:, len(ys) :]
        bread = np.linalg.inv(x.T @ x)
        for o in range(len(ys)):
            beta = bread @ x.T @ y[:, o]
            parts.append((own.index, bread, x * (y[:, [o]] - x @ beta[:, None])))
            betas.append(beta)
        counts.append(len(own))
        dofs.append(min(own[c].nunique() for c in clusters) - 1)
    whole = np.zeros((sum(map(len, betas)),) * 2)
    keys = [(df[clusters[0]], 1), (df[clusters[1]], 1), (df[clusters[0]] * 1000 + df[clusters[1]], -1)]
    for key, sign in keys:
        u = []
        for index, bread, s in parts:
            sums = pd.DataFrame(s, index=index).groupby(key.loc[index]).sum()
            g = len(sums)
            u.append((sums @ bread).reindex(sorted(key.unique())).fillna(0).to_numpy() * np.sqrt(g / (g - 1)))
        u = np.concatenate(u, axis=1)
        whole += sign * u.T @ u
    return np.concatenate(betas), whole, counts, dofs


MODELS = {"one": (["y", "y2"], ["x1", "x2"]), "two": (["y"], ["x1", "x2", "x3"]), "three": (["y2"], ["x3"])}


@pytest.mark.parametrize("most", [2000, 3])
def test_models_share_jobs_and_clusters(spark, monkeypatch, most):
    """Models of unlike columns and rows: slopes, errors, covariances between models and the test of equal slopes are those of dummies. 3: conjugate gradients."""
    monkeypatch.setattr(hdfe, "MOST_LEVELS", most)
    monkeypatch.setattr(hdfe, "BLOCK", 7)
    df = panel()
    got = hdfe.fits(spark.createDataFrame(df), MODELS, ["a", "b", "c"], ["a", "b"])
    beta, cov, counts, dofs = brute(df, MODELS, ["a", "b", "c"], ["a", "b"])
    assert got.names[:4] == [("one", "y", "x1"), ("one", "y", "x2"), ("one", "y2", "x1"), ("one", "y2", "x2")]
    assert np.allclose(got.beta, beta, atol=1e-8) and np.allclose(got.cov, cov, atol=1e-8)
    assert list(got.n.values()) == counts and list(got.df.values()) == dofs and (got.rounds > 0) == (most == 3)
    pairs = [(("one", "y", "x1"), ("two", "y", "x1")), (("one", "y", "x2"), ("two", "y", "x2"))]
    r = np.zeros((2, len(beta)))
    for k, (a, b) in enumerate(pairs):
        r[k, got.names.index(a)], r[k, got.names.index(b)] = 1, -1
    each, f, df1, p = got.equal(pairs)
    v = r @ cov @ r.T
    assert df1 == 2 and f == pytest.approx(r @ beta @ np.linalg.inv(v) @ (r @ beta) / 2, rel=1e-6) and 0 <= p <= 1
    assert np.allclose([d for d, _ in each], r @ beta, atol=1e-8) and np.allclose([s for _, s in each], np.sqrt(np.diag(v)), atol=1e-8)


def test_rows_that_lack_a_level_or_number(spark):
    df = panel(n=200)
    rows = spark.createDataFrame(df).withColumn("a", F.when(F.col("u") > 1.5, None).otherwise(F.col("a"))).withColumn("x1", F.when(F.col("u") < -1.5, float("nan")).otherwise(F.col("x1")))
    own = df[(df.u <= 1.5) & (df.u >= -1.5)].reset_index(drop=True)
    got = hdfe.fit(rows, "y", ["x1"], ["a"], ["b"])
    v = demeaned(own[["y", "x1"]].to_numpy(), own.a.to_numpy())
    assert got.n == len(own) and got.beta[0] == pytest.approx(v[:, 0] @ v[:, 1] / (v[:, 1] @ v[:, 1]), abs=1e-9)
    with pytest.raises(ValueError, match="no complete rows"):
        hdfe.fit(rows.filter("false"), "y", ["x1"], ["a"], ["b"])


def test_many_levels(spark):
    """100,000 levels of one effect, which a short effect crosses, and two effects of thousands of levels, which conjugate gradients solve."""
    rng = np.random.default_rng(8)
    n, many = 300_000, 100_000
    big, small, x = rng.integers(0, many, n), rng.integers(0, 30, n), rng.normal(size=n)
    y = 0.7 * x + rng.normal(size=many)[big] + 0.1 * small + rng.normal(size=n)
    rows = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "big": big, "small": small, "k": big % 50}))
    got = hdfe.fit(rows, "y", ["x"], ["big", "small"], ["k"])
    v = np.column_stack([y, x, (small[:, None] == np.arange(30)).astype(float)])
    counts = np.maximum(np.bincount(big, minlength=many), 1)
    v = v - np.stack([np.bincount(big, c, many) / counts for c in v.T])[:, big].T
    beta = np.linalg.lstsq(v[:, 1:], v[:, 0], rcond=None)[0]
    assert got.beta[0] == pytest.approx(beta[0], abs=1e-8) and got.rounds == 0
    two = rng.integers(0, 2500, n)
    rows = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "one": big % 4000, "two": two, "k": big % 50}))
    got = hdfe.fit(rows, "y", ["x"], ["one", "two"], ["k"])
    one, w = big % 4000, np.column_stack([y, x])
    for _ in range(200):
        for g, m in ((one, 4000), (two, 2500)):
            w = w - np.stack([np.bincount(g, c, m) / np.maximum(np.bincount(g, minlength=m), 1) for c in w.T])[:, g].T
    assert got.beta[0] == pytest.approx(w[:, 0] @ w[:, 1] / (w[:, 1] @ w[:, 1]), abs=1e-8) and 0 < got.rounds < 60


def test_placebo_keeps_cells_and_has_no_effect(spark):
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"id": np.arange(2000), "cell": np.where(np.arange(2000) % 3 == 0, 0, rng.integers(0, 9, 2000)), "z": rng.normal(size=2000)})
    got = effects.permuted(spark.createDataFrame(df), "z", ["cell"], 5).toPandas().sort_values("id")
    dealt = np.array(got["dealt"].tolist())
    assert dealt.shape == (2000, 5)
    for k in range(5):
        for cell in range(9):
            at = df.cell == cell
            assert sorted(dealt[at, k]) == sorted(df.z[at])
        assert abs(np.corrcoef(dealt[:, k], df.z)[0, 1]) < 0.1 and (k == 0 or abs(np.corrcoef(dealt[:, k], dealt[:, 0])[0, 1]) < 0.1)


def test_group_contrasts_and_their_tests(spark):
    """Contrasts by group from one model, and the test of their equality with its covariance, against numpy."""
    df = panel(5, 900)
    df["p"], df["grp"] = df.x1 * df.x2, "g" + (df.c % 3).astype(str)
    points = {"x1": (-0.7, 0.6), "x2": (-0.5, 0.8)}
    got = effects.group_scenarios(spark.createDataFrame(df), "grp", ["g0", "g1", "g2"], "y", {"ch": ("x1", "x2", "p")}, points, ["y2"], ["a"], ["a", "b"]).collect()
    names = [f"{t}{k}" for k in range(3) for t in ("x1", "x2", "p")]
    for k in range(3):
        for t in ("x1", "x2", "p"):
            df[f"{t}{k}"] = df[t] * (df.grp == f"g{k}")
    beta, cov, _, _ = brute(df, {"m": (["y"], [*names, "y2"])}, ["a"], ["a", "b"])
    step = np.array([1.3, 1.3, 0.6 * 0.8 - 0.7 * 0.5])
    r = np.array([np.concatenate([np.kron(np.arange(3) == k, step), [0]]) for k in range(3)])
    v = r @ cov @ r.T
    assert np.allclose([x["delta"] for x in got], r @ beta, atol=1e-8) and np.allclose([x["se"] for x in got], np.sqrt(np.diag(v)), atol=1e-8)
    d = (r[1:] - r[0]) @ beta
    assert got[0]["f"] == pytest.approx(d @ np.linalg.inv((r[1:] - r[0]) @ cov @ (r[1:] - r[0]).T) @ d / 2, rel=1e-6)
    w = 1 / np.diag(v)
    q = float((w * (r @ beta - (w @ (r @ beta)) / w.sum()) ** 2).sum())
    assert got[0]["q"] == pytest.approx(q, rel=1e-6) and got[0]["q_p"] == pytest.approx(chi2_upper(q, 2), rel=1e-6)
    assert effects.group_scenarios(spark.createDataFrame(df), "grp", [], "y", {"ch": ("x1", "x2", "p")}, points, ["y2"], ["a"], ["a", "b"]).count() == 0


@pytest.mark.parametrize("few", [1000, 0])
def test_quantiles_are_exact(spark, monkeypatch, few):
    """As percentile gives them: ties, nulls, NaN, skew over many orders of size, both signs, one value, none."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(9)
    n = 5000
    df = pd.DataFrame({
        "plain": rng.normal(size=n), "ties": rng.integers(-3, 4, n).astype(float), "skew": np.exp(rng.normal(size=n) * 40) * rng.choice([-1, 1], n),
        "hot": np.where(rng.random(n) < 0.9, 0.0, -0.0) + (rng.random(n) < 0.05) * 1e-300, "one": 7.25, "ints": rng.integers(0, 10**12, n),
    })
    rows = spark.createDataFrame(df).withColumn("none", F.lit(None).cast("double")).withColumn("holes", F.when(F.rand(1) < 0.5, F.lit(None)).when(F.rand(2) < 0.2, float("nan")).otherwise(F.col("plain"))).persist()
    at = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    columns = [*df.columns, "none", "holes"]
    got = quantiles.quantiles(rows, {c: at for c in columns})
    for c in columns:
        want = rows.filter(~F.isnan(F.col(c).cast("double"))).agg(F.percentile(c, F.array(*map(F.lit, at)))).first()[0]
        assert got[c] == (pytest.approx(want, rel=1e-12, abs=0) if want else [None] * len(at))
    assert [quantiles._double(int(x)) for x in quantiles._ordered(np.array([-1.5, 0.0, -0.0, 2.5]))] == [-1.5, 0.0, 0.0, 2.5]
    low = features.scenario_quantiles(rows.withColumn("t", F.col("plain") > 0), ["plain", "none"], F.col("t")).collect()
    assert low[0]["low"] == pytest.approx(np.quantile(df.plain[df.plain > 0], 0.25)) and low[1]["low"] is None


def test_followed_rows_alone_count(spark):
    rows = spark.createDataFrame([(1.0, 1.5, 1, 0.8, True), (2.0, 2.0, 0, 0.4, True), (9.0, 0.0, 1, 0.0, False)], "y double, pred double, flag int, prob double, ok boolean")
    got = {r["metric"]: r["value"] for r in holdout.metrics(rows, "y", "pred", "flag", "prob", F.col("ok"), F.col("ok")).collect()}
    assert got["mae_log"] == pytest.approx(0.25) and got["brier"] == pytest.approx((0.04 + 0.16) / 2) and got["auc"] == 1.0
    assert {r["metric"]: r["value"] for r in holdout.metrics(rows, "y", "pred", "flag", "prob").collect()}["mae_log"] == pytest.approx(9.5 / 3)


def test_sparse_predictor_equals_numpy(spark):
    """Vectors against counts by hand, and both models against the minimum of their penalised loss, by the normal equations and by Newton's method."""
    rng = np.random.default_rng(8)
    words = {i: [f"w{int(x)}" for x in rng.integers(0, 25, int(rng.integers(0, 12)))] for i in range(60)} | {60: [], 61: None}
    texts = spark.createDataFrame(list(words.items()), "text_id long, tokens array<string>")
    grams = {i: Counter([*(t or []), *(f"{a} {b}" for a, b in zip(t or [], (t or [])[1:], strict=False))]) for i, t in words.items()}
    rows = [(k, int(rng.integers(0, 62)), float(rng.normal(3, 2)), k % 3 > 0) for k in range(300)]
    rows = [(k, i, a, bool(t), 0.3 * a + grams[i]["w1"] + float(rng.normal()), int(0.5 * a + grams[i]["w2"] + rng.normal() > 2)) for k, i, a, t in rows]
    df = spark.createDataFrame(rows, "id long, text_id long, a double, train boolean, y double, flag int")
    train = df.filter("train")
    found = {r["text_id"]: r["vector"].toArray() for r in holdout.text_vectors(texts, train, 1 << 20).collect()}
    fitted = [r for r in rows if r[3]]
    n = Counter(g for r in fitted for g in grams[r[1]])
    for i, own in grams.items():
        x = {g: c * np.log((1 + len(fitted)) / (1 + n[g])) for g, c in own.items()}
        norm = np.sqrt(sum(v * v for v in x.values())) or 1.0
        assert np.allclose(sorted(v for v in found[i] if v), sorted(v / norm for v in x.values() if v), atol=1e-12)
    vectors = holdout.text_vectors(texts, train, 64)
    both = df.join(vectors, "text_id")
    blank = both.limit(1).select("id", "text_id", F.lit(None).cast("double").alias("a"), F.lit(False).alias("train"), "y", "flag", "vector")
    got = {r["id"]: r for r in holdout.predict_sparse(both.filter("train"), both.filter("not train").union(blank), ["a"], "vector", "y", "flag", 0.01, 200, 1e-9).collect()}
    assert set(got) == {r[0] for r in rows if not r[3]}
    vector = {r["text_id"]: r["vector"].toArray() for r in vectors.collect()}
    a = np.array([r[2] for r in fitted])
    design = lambda rs: np.column_stack([np.ones(len(rs)), [(r[2] - a.mean()) / a.std(ddof=1) for r in rs], [vector[r[1]] for r in rs]])
    x, y, flag = design(fitted), np.array([r[4] for r in fitted]), np.array([r[5] for r in fitted])
    free = np.eye(x.shape[1])
    free[0, 0] = 0
    # the penalty of the line is in units of the outcome's deviation
    line = np.linalg.solve(x.T @ x / len(x) + 0.01 / y.std(ddof=1) * free, x.T @ y / len(x))
    logit = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ logit))
        logit -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + 0.01 * free, x.T @ (p - flag) / len(x) + 0.01 * free @ logit)
    hold = [r for r in rows if not r[3]]
    z = design(hold)
    assert np.allclose([got[r[0]]["pred"] for r in hold], z @ line, atol=1e-5)
    assert np.allclose([got[r[0]]["prob"] for r in hold], 1 / (1 + np.exp(-z @ logit)), atol=1e-5)


@pytest.mark.parametrize("name", ["hdfe_fit", "scenario_contrast", "joint_wald", "year_effects", "representation_test", "holdout_comparison", "subgroup_gaps"])
def test_model_queries_have_whole_results(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == {"hdfe_fit": 20, "scenario_contrast": 4, "joint_wald": 2, "year_effects": 12, "representation_test": 2, "holdout_comparison": 14, "subgroup_gaps": 14}[name]
    assert all(v is not None for r in rows for v in r)


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 20])
def test_sensitive_content_across_blocks(spark, tmp_path, step):
    """Hits that lie across the ends of steps, runs without white space, and binary files, against one search of the whole."""
    rng = np.random.default_rng(4)
    junk = lambda n: bytes(rng.integers(33, 127, n, np.uint8))
    parts = [b"write to ann@example.org or /home/ann/x.txt,", junk(50), b"password=hunter22 token:'abcdef123'", b"AKIA" + b"ABCDEFGH12345678", junk(9000), b" x@y.z.com AKIA" + b"Q" * 70, bytes(rng.integers(0, 256, 3000, np.uint8)), b"C:\\Users\\me\\a b@c.de"]
    whole = b" ".join(parts * 3) + b"\n" + b"/root/" + b"k" * 20
    want = sorted(((kind, m.start(), m.end() - m.start()) for kind, p in sinks.SENSITIVE for m in re.finditer(p, whole)), key=lambda x: (x[1], x[0]))
    got = sinks.hits_of(io.BytesIO(whole), sinks.SENSITIVE, step) if step > 1 else sinks.hits_of(io.BytesIO(whole[:3000]), sinks.SENSITIVE, 1)
    assert got == (want if step > 1 else sorted(((kind, m.start(), m.end() - m.start()) for kind, p in sinks.SENSITIVE for m in re.finditer(p, whole[:3000])), key=lambda x: (x[1], x[0])))
    assert len({k for k, _, _ in want}) == 4
    if step == 100:
        (tmp_path / "a").mkdir()
        (tmp_path / "a" / "one.bin").write_bytes(whole)
        (tmp_path / "two.txt").write_bytes(b"")
        rows = sinks.sensitive(spark, str(tmp_path), step=step).collect()
        assert sorted((r["kind"], r["offset"], r["bytes"]) for r in rows) == sorted(want) and all(r["path"].endswith("one.bin") for r in rows)
