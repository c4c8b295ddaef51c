"""Steps whose cost must not grow with what listings share."""

import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscope.operators import effects, features, hdfe, text
from poolscope.operators import homogeneity as hom
from poolscope.plans.spec import DAY, SPEC
from poolscope.sources import sinks

KINDS = ["current", "recent", "completed", "mirror14d"]


def listings(spark, n=240, texts=9, days=300, stays=50):
    rng = np.random.default_rng(3)
    rows = [(i, i % texts, int(u) * DAY // 2, int(u) * DAY // 2 + int(s) * DAY // 4, "ab"[int(k)]) for i, (u, s, k) in enumerate(zip(rng.integers(-days, days, n), rng.integers(0, 4 * stays, n), rng.integers(0, 2, n), strict=True))]
    words = [(i, [f"t{int(x)}" for x in rng.integers(0, 30, 12)]) for i in range(texts)]
    return spark.createDataFrame(rows, "id long, text_id long, u0 long, u1 long, sector string"), spark.createDataFrame(words, "text_id long, tokens array<string>")


@pytest.mark.parametrize("held,long", [(1 << 28, 0), (1 << 28, 1 << 30), (200, 16)])
def test_shared_texts_in_blocks_and_shards(spark, monkeypatch, held, long):
    """Listings that share texts and instants, over several blocks and shards of terms, against pairs."""
    monkeypatch.setattr(hom, "HELD", held)
    monkeypatch.setattr(hom, "LONG", long)
    df, words = listings(spark)
    vectors = text.packed_vectors(words, df.groupBy("text_id").agg(F.count("*").alias("n")))
    block, shards, _ = hom._cuts(df, vectors, ["sector"], KINDS, SPEC)
    assert block < 60 * DAY and (shards > 1) == (held == 200)
    swept = hom.similarities(df, vectors, KINDS).persist()
    own = text.vectors(df.join(words, "text_id"), F.col("tokens"), F.lit(True)).persist()
    for kind in KINDS:
        found = hom.audit(swept.select("id", F.col(f"h_{kind}").alias("h")), hom.pairwise(df, own, df, kind)).first()
        assert found["checks"] > 100 and found["max_error"] < 1e-9


def test_listings_are_dealt_without_their_terms(spark):
    """A text's vector is dealt once to each part that has listings of it, not with every move of every listing."""
    df, words = listings(spark, n=600, texts=2)
    vectors = text.packed_vectors(words, df.groupBy("text_id").agg(F.count("*").alias("n")))
    block, shards, high = hom._cuts(df, vectors, ["sector"], KINDS, SPEC)
    events = hom._events(df, ["sector"], KINDS, block, shards, high, SPEC)
    assert "weights" not in events.columns
    assert events.select("text_id", "sector", "block", "shard").distinct().count() * 10 < events.count()


def test_standardised_has_one_set_of_parameters(spark):
    """Parameters that differ in each pass, as sums of doubles do, leave z-scores and their quantiles as they are."""

    def shaken(batches):
        for x in batches:
            x["a"] = x["a"] + np.where(x["train"], (time.time_ns() % 1000) * 1e-9, 0)
            yield x

    rows = spark.range(3000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 3 == 0).alias("train")).mapInPandas(shaken, "a double, train boolean")
    z = features.standardised(rows, ["a"], F.col("train")).filter("not train")
    first, second = (sorted(r["z_a"] for r in z.select("z_a").collect()) for _ in range(2))
    assert first == second
    low = features.scenario_quantiles(z, ["z_a"], F.lit(True), replace(SPEC, low=0.1)).first()
    assert low["low"] == pytest.approx(np.quantile(first, 0.1), rel=1e-12)


def test_pairs_by_text_equal_pairs_by_listing(spark):
    """The audit's vectors have a row per term of a text, not of a listing."""
    df, words = listings(spark)
    vectors = text.text_vectors(words, df.filter("id % 2 = 0").groupBy("text_id").agg(F.count("*").alias("n"))).persist()
    own = text.vectors(df.join(words, "text_id"), F.col("tokens"), F.col("id") % 2 == 0).persist()
    assert vectors.count() * 10 < own.count()
    focal = df.filter("id % 5 = 0").select("id")
    for kind in KINDS:
        a, b = (f(df, v, focal, kind).persist() for f, v in ((hom.pairwise_texts, vectors), (hom.pairwise, own)))
        found = hom.audit(a, b).first()
        assert found["checks"] == a.count() == b.count() > 10 and found["max_error"] < 1e-12
        assert {(r["id"], r["n"]) for r in a.collect()} == {(r["id"], r["n"]) for r in b.collect()}


def test_phrases_of_shared_texts_equal_phrases_of_listings(spark):
    """Runs are taken from each text once; documents and countries are counted by the listings that have a text. Texts without listings count for nothing."""
    texts = spark.createDataFrame([(0, list("abcdefg")), (1, list("bcdefx")), (2, list("abcab")), (3, []), (4, None), (5, list("abcdefg"))], "text_id long, tokens array<string>")
    rows = spark.createDataFrame([(i, i % 5, f"c{i % 3}" if i % 7 else None) for i in range(60)], "id long, text_id long, country string")
    copies = rows.groupBy("text_id", "country").agg(F.count("*").alias("n"))
    for least, countries in ((13, 3), (25, 1)):
        want = text.recurring_phrases(rows.join(texts, "text_id"), "tokens", least, countries, 3).collect()
        got = text.shared_phrases(texts, copies, "tokens", least, countries, 3).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want) and (least == 25 or want)


def test_csv_of_any_size_is_not_written_by_one_task(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 3).withColumn("s", F.when(F.col("id") % 2 == 0, F.lit("a,b")))
    for whole, files in ((True, 1), (False, 3)):
        path = str(tmp_path / str(whole))
        sinks.write_csv(rows, path, whole)
        back = spark.read.schema("id long, s string").option("header", True).csv(path)
        assert len(back.inputFiles()) == files and back.exceptAll(rows).isEmpty() and back.count() == 3000


def test_a_long_text_is_scaled_once(spark):
    """Its length is summed up once, not for each of its terms: 60,000 distinct ones would be 3.6 billion steps."""
    words = spark.createDataFrame([(0, ["a", "b", "a"]), (1, [f"t{i}" for i in range(60_000)])], "text_id long, tokens array<string>")
    copies = words.select("text_id", F.lit(1).alias("n"))
    text.packed_vectors(words.filter("text_id = 0"), copies).collect()
    began = time.time()
    got = {r["text_id"]: r for r in text.packed_vectors(words, copies).collect()}
    assert time.time() - began < 25
    assert len(got[1]["slots"]) == len(set(got[1]["slots"])) == 60_000 and np.allclose(got[1]["weights"], 60_000**-0.5)
    assert sum(w * w for w in got[0]["weights"]) == pytest.approx(1)


def test_a_part_has_a_text_once_for_all_groups():
    """Rows of a part: its vectors first, then the listings of all groups, each group with sums of its own."""
    vectors = pa.table({"text_id": [7, 8], "slots": pa.array([[0, 1], [1]], pa.list_(pa.int32())), "weights": [[0.6, 0.8], [1.0]]}).to_batches()
    (pieces,) = hom._cut_up(vectors, 1)
    n, rows = 2, [("a", 1, 7, 0, 0, 0, 1), ("a", 2, 8, 5, 5, 1, 0), ("b", 3, 8, 0, 0, 0, 1), ("b", 4, 7, 5, 5, 1, 0), ("b", 5, 9, 6, 6, 1, 0)]
    sector, ids, text_id, at, u0, role, sign = zip(*rows, strict=True)
    blank = [None] * n
    batch = pa.table({
        "block": [0] * 7, "shard": [0] * 7, "sector": pa.array([*blank, *sector]), "text_id": [7, 8, *text_id], "id": pa.array([*blank, *ids], pa.int64()), "at": pa.array([*blank, *at], pa.int64()),
        "u0": pa.array([*blank, *u0], pa.int64()), "role": pa.array([*blank, *role], pa.int8()), "s_current": pa.array([*blank, *sign], pa.int8()),
        "slots": pa.array([*pieces["slots"].to_pylist(), *[b""] * 5]), "weights": pa.array([*pieces["weights"].to_pylist(), *[b""] * 5]),
    }).to_batches()[0]
    for cuts in ([0, 7], [0, 1, 3, 5, 7]):
        parts = [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        got = {i: (norm, dot) for found in hom._dots(parts, 1, ["current"], 1.0) for i, norm, dot in zip(*(c.to_pylist() for c in found.columns), strict=True)}
        assert got == {2: (pytest.approx(1), pytest.approx(0.8)), 4: (pytest.approx(1), pytest.approx(0.8))}


def test_models_of_the_same_rows_share_them(spark):
    """A listing is there once for all models that it counts in alike, and not once for each; those of other rows have their own."""
    rng = np.random.default_rng(4)
    rows = [(float(y), *(float(x) for x in xs), None if i % 4 else 1.0 * i, "abcde"[i % 5], i % 7) for i, (y, xs) in enumerate(zip(rng.normal(size=80), rng.normal(size=(80, 3)), strict=True))]
    df = spark.createDataFrame(rows, "y double, x0 double, x1 double, x2 double, rare double, a string, b int")
    models = {str(k): (["y"], [f"x{k % 3}"]) for k in range(20)} | {"rare": (["y"], ["rare"])}
    columns = ["y", "x0", "x1", "x2", "rare"]
    base = hdfe._rows(hdfe._flat(df, columns, ["a"], ["a", "b"]), models, columns)
    families = hdfe._families(base, models)
    assert [len(x) for x in families] == [20, 1]
    wide = hdfe._by_family(base, families, models, columns)
    assert {r["m"]: r["count"] for r in wide.groupBy("m").count().collect()} == {0: 80, 1: 20}
    both = hdfe.fits(df, models, ["a"], ["a", "b"], keep=False)
    for name in ("0", "5", "rare"):
        alone = hdfe.fit(df, "y", models[name][1], ["a"], ["a", "b"])
        assert np.allclose(both.one(name, "y").beta, alone.beta) and np.allclose(both.one(name, "y").cov, alone.cov) and both.n[name] == alone.n


@pytest.mark.parametrize("cell", [1 << 20, 200])
def test_deals_shuffle_no_row_for_each_deal(spark, monkeypatch, cell):
    """Cells of up to CELL rows are dealt where they lie: the plan has no exchange of a row for each deal. Larger ones are dealt by ranks; each way keeps cells."""
    monkeypatch.setattr(effects, "CELL", cell)
    rows = [(i, i % 5 if i % 3 else 9, float(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, cell int, z double")
    dealt = effects.permuted(df, "z", ["cell"], 19)
    assert ("Window" in dealt._jdf.queryExecution().toString()) == (cell == 200)
    got = {r["id"]: r for r in dealt.collect()}
    assert len(got) == 1500 and all(len(r["dealt"]) == 19 for r in got.values())
    for c in (0, 1, 2, 3, 4, 9):
        own = [r for r in got.values() if r["cell"] == c]
        assert all(sorted(r["dealt"][k] for r in own) == sorted(r["z"] for r in own) for k in range(19))
    assert 0 < sum(r["dealt"][0] == r["z"] for r in got.values()) + 1 < 60
    again = {r["id"]: r["dealt"] for r in effects.permuted(df.repartition(7), "z", ["cell"], 19).collect()}
    assert again == {i: r["dealt"] for i, r in got.items()}
