"""Counts of n-grams: against plain Python, at any size of a piece or batch, and what they shuffle."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from poolscope.operators import grams, text

DOCS = [(1, ["a", "b", "a", "b"]), (2, []), (None, ["a", "é😀"]), (1, ["b", "a"]), (3, None), (None, ["a", "é😀", "x" * 300]), (5, ["one"]), (4, [f"w{i % 50}" for i in range(3000)])]


def runs(words, sizes):
    return [" ".join(words[i : i + k]) for k in sizes for i in range(len(words or []) - k + 1)]


@pytest.fixture(params=[(8 << 20, 10_000), (40, 1)])
def small(request, spark, monkeypatch):
    """Pieces of a task, whole and tiny; a key's rows then lie in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param[1])
    monkeypatch.setattr(grams, "PIECE", request.param[0])
    yield request.param[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counts_by_key(spark, small):
    df = spark.createDataFrame(DOCS, "id long, t array<string>")
    want = Counter((i, g) for i, t in DOCS for g in runs(t, (1, 2)))
    got = grams.word_counts(df, "t", (1, 2)).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)
    hashed = df.select("id", F.explode(text.unigrams_and_bigrams(F.col("t"))).alias("g")).groupBy("id", text.hashed(F.col("g"), 16).alias("b")).count()
    got = grams.bucket_counts(df, "t", (1, 2), 16)
    assert got.dtypes == [("id", "bigint"), ("bucket", "int"), ("tf", "bigint")] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, hashed.collect())))
    assert grams.word_counts(df.limit(0), "t", (1,)).isEmpty() and grams.bucket_counts(df.filter("id = 2"), "t", (1,), 16).isEmpty()


def test_characters_by_key(spark, small):
    texts = [(1, "abcabc"), (2, None), (3, "ab"), (1, "bca"), (4, "é😀b😀ࠀ" * 40), (5, "")]
    want = Counter((i, t[k : k + 3]) for i, t in texts for k in range(len(t or "") - 2))
    got = grams.char_counts(spark.createDataFrame(texts, "id int, t string"), "t", 3).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


def test_runs_of_rows(spark, small):
    df = spark.createDataFrame(DOCS, "id long, t array<string>")
    got = Counter(tuple(r) for r in grams.listed(df, "t", (1, 2), ["id"]).collect())
    assert got == Counter((i, g) for i, t in DOCS for g in set(runs(t, (1, 2))))
    got = Counter(tuple(r) for r in grams.listed(df, "t", (2,), ["id"], places=True).collect())
    assert got == Counter((i, k, g) for i, t in DOCS for k, g in enumerate(runs(t, (2,))))


def test_rare_terms_are_not_let_through_as_they_grow(spark, monkeypatch):
    """Ten times more rare rows than bits: counters shared by terms would all reach the threshold."""
    monkeypatch.setattr(text, "COUNTERS", 1 << 10)
    rows = spark.range(10_240).select(F.concat(F.lit("rare"), "id").alias("term")).union(spark.range(8).select(F.lit("hot").alias("term")))
    assert [r[0] for r in text.often(rows, 5).distinct().collect()].count("hot") == 1 and text.often(rows, 5).count() < 8 + 100
