"""Text to weighted terms: masks, tokens, n-grams, hashing, TF-IDF, recurring phrases. Built-in expressions; runs of words are found by grams.py."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.operators.grams import listed, word_counts
from poolscope.plans.spec import SPEC, Spec
from poolscope.sources.sinks import kept

#: What hides dates, amounts, places and names, in this order.
MASKS = [
    (r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b", "<DATE>"),
    (r"[$€£]\s?\d[\d.,]*|\b\d[\d.,]*\s?(?:USD|EUR|GBP)\b", "<AMOUNT>"),
    (r"\b\d[\d.,]*\b", "<NUMBER>"),
]


def masked(c: Column, names: list[str] = ()) -> Column:
    """A text without dates, amounts and numbers, and without the given names or places: a small list; dictionary_masked() takes any number."""
    for pattern, mark in MASKS:
        c = F.regexp_replace(c, pattern, mark)
    if names:
        any_of = "|".join(rf"\Q{name}\E" for name in sorted(names, key=lambda x: (-len(x), x)))
        c = F.regexp_replace(c, rf"(?i)\b(?:{any_of})\b", "<NAME>")
    return c


#: What counts as a word of a name, and what hides a run of them.
WORD, NAME = r"[\p{L}\p{N}]+", "<NAME>"


def dictionary_masked(texts: DataFrame, names: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, text, n_names): texts in which each maximal run of words that names cover, with what stands between them, is one NAME.

    names: one column, of any number of names and places; a name is a sequence of words, whatever their case and what stands between them. Only words that
    begin a name are looked up further, as runs of the lengths that names with that word have, by joins; so the dictionary may be as large as the texts, and
    no pattern holds it. Names that overlap or touch hide one run. Text null: null, 0 names. A name without words hides nothing. Keys are unique.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))
    known = names.select(words(F.col(names.columns[0])).alias("w")).filter(F.size("w") > 0).select(F.col("w")[0].alias("first"), F.size("w").alias("n"), F.array_join("w", " ").alias("run")).distinct()
    lengths = known.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    longest = known.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    runs = texts.select(key, words(F.col(text)).alias("w"))
    runs = runs.select(key, F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("first"), F.slice(F.col("w"), i + 1, longest).alias("ahead")))).alias("at", "x")).select(key, "at", "x.*")
    runs = runs.join(lengths, "first").select(key, "at", "ahead", F.explode("lengths").alias("n")).filter(F.col("n") <= F.size("ahead"))
    found = runs.select(key, "at", "n", F.array_join(F.slice("ahead", 1, F.col("n")), " ").alias("run")).join(known.select("run").distinct(), "run", "left_semi")
    hidden = found.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("hidden"))
    # a text is its words, and what is before, between and behind them
    parts = texts.select(key, text, F.split(text, WORD).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("own")).join(hidden, key, "left")
    edge = lambda step: F.filter("hidden", lambda p, i: F.coalesce(F.get("hidden", i + step) != p + step, F.lit(True)))
    parts = parts.withColumns({"begins": edge(-1), "ends": edge(1)})
    piece = lambda a, b: F.array_join(F.transform(F.sequence(a, b), lambda j: F.concat(F.get("gaps", j), F.get("own", j))), "")
    ahead = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1)
    kept = lambda i, b: F.concat(F.when(b > ahead(i), piece(ahead(i), b - 1)).otherwise(""), F.get("gaps", b), F.lit(NAME))
    last = F.element_at("ends", -1) + 1
    rest = F.concat(F.when(F.size("own") > last, piece(last, F.size("own") - 1)).otherwise(""), F.element_at("gaps", -1))
    masked_text = F.when(F.col("hidden").isNull(), F.col(text)).otherwise(F.concat(F.array_join(F.transform("begins", lambda b, i: kept(i, b)), ""), rest))
    return parts.select(key, masked_text.alias(text), F.coalesce(F.size("begins"), F.lit(0)).cast("long").alias("n_names"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(c: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space; none of a shorter text."""
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))


def unigrams_and_bigrams(c: Column) -> Column:
    return F.concat(c, ngrams(c, 2))


def char_ngrams(c: Column, n: int = SPEC.char_gram) -> Column:
    """All runs of n characters. A text is split into characters once; substrings by place would be sought from its beginning each time."""
    grams = lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.concat(*(F.get(own, i + k) for k in range(n))))
    split = F.transform(F.array(F.split(c, "")), lambda own: F.when(F.size(own) >= n, grams(own)))
    return F.when(F.char_length(c) >= n, F.get(split, F.lit(0))).otherwise(F.array().cast("array<string>"))


def hashed(term: Column, buckets: int = SPEC.hash_buckets) -> Column:
    """A bucket by the MD5 of a term, which is the same in any engine."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def term_counts(df: DataFrame, terms: Column, key: str = "id") -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + N) / (1 + df)) + 1, of the documents given, which are the training rows."""
    n = documents.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def unit_vectors(counts: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """(key, term, w): tf * idf, scaled to length 1. Terms without a frozen weight are left out."""
    rows = counts.join(weights.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return rows.select(key, "term", (F.col("x") / norm).alias("w"))


#: Bits of a set of hashes of terms; a power of two, 64 or more.
COUNTERS = 1 << 24


def _bits(hashes: DataFrame) -> Column:
    """The set of the hashes in the one column of a table, as one value of a fixed size: COUNTERS bits in words of 64."""
    own = F.col(hashes.columns[0]).bitwiseAND(F.lit(COUNTERS - 1))
    words = hashes.select(own.alias("own")).groupBy(F.shiftright("own", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(own & 63 as int))")).alias("bits"))
    words = hashes.sparkSession.range(COUNTERS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"])).scalar()


def _maybe(term: Column, bits: Column) -> Column:
    """Whether a term may be in a set; never false for one that is."""
    own = F.xxhash64(term).bitwiseAND(F.lit(COUNTERS - 1))
    return F.getbit(F.get(bits, F.shiftright(own, 6).cast("int")), own.bitwiseAND(F.lit(63)).cast("int")) == 1


def often(rows: DataFrame, least: int) -> DataFrame:
    """Rows of those terms that may have `least` rows or more; no term that has is missing.

    A first pass counts rows by the 64-bit hash of their term, and only the rows of hashes that reach `least` go on, by a set of bits of a fixed size. So a
    rare term, as most are, is shuffled as a number, once, and never as text, however many of them there are. Terms that the bits let through beyond these are
    for the caller's exact count to drop; they are few while some ten million terms at most are frequent.
    """
    hashes = rows.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return rows.filter(_maybe(F.col("term"), _bits(hashes.select("h"))))


def frequent_terms(df: DataFrame, terms: Column, least: int, keep: list[str] = ()) -> DataFrame:
    """(keep, term): often() of the distinct terms of each document. Documents whose terms are null have none; a null among terms is a term."""
    return often(df.select(*keep, F.explode(F.array_distinct(terms)).alias("term")), least)


def document_counts(df: DataFrame, terms: Column, least: int) -> DataFrame:
    """(term, df) of the terms that at least so many documents have; one row of df is a document."""
    return frequent_terms(df, terms, least).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)


def recurring_phrases(df: DataFrame, toks: str, least_docs: int, least_countries: int, n: int = SPEC.phrase_words) -> DataFrame:
    """(phrase, docs, countries): runs of n words in at least so many documents and countries. Rare runs go before they are shuffled (often)."""
    rows = often(listed(df, toks, (n,), ["country"]), least_docs).withColumnRenamed("term", "phrase")
    found = rows.groupBy("phrase", "country").agg(F.count("*").alias("docs")).groupBy("phrase").agg(F.sum("docs").alias("docs"), F.count("country").alias("countries"))
    return found.filter((F.col("docs") >= least_docs) & (F.col("countries") >= least_countries))


def shared_phrases(texts: DataFrame, copies: DataFrame, toks: str, least_docs: int, least_countries: int, n: int = SPEC.phrase_words, key: str = "text_id") -> DataFrame:
    """recurring_phrases() of documents that share texts, whose runs are taken from each text once, not from each document.

    texts: (key, toks), one row per distinct text. copies: (key, country, n): how many documents of a country have a text.
    """
    total = copies.groupBy(key).agg(F.sum("n").alias("n"))
    runs = texts.join(total, key).select(key, "n", F.explode(F.array_distinct(ngrams(F.col(toks), n))).alias("phrase"))
    often = runs.groupBy("phrase").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least_docs).select("phrase")
    found = runs.select(key, "phrase").join(often, "phrase", "left_semi").join(copies, key).groupBy("phrase", "country").agg(F.sum("n").alias("docs"))
    return found.groupBy("phrase").agg(F.sum("docs").alias("docs"), F.count("country").alias("countries")).filter(F.col("countries") >= least_countries)


def residual(df: DataFrame, toks: str, phrases: DataFrame, n: int = SPEC.phrase_words, key: str = "id") -> DataFrame:
    """(key, residual): tokens that no recurring phrase covers, in order. Runs that no phrase's hash allows go where they are found, and only the places of the others are
    shuffled and joined; texts stay where they are until one join by key. Phrases are found once, whatever reads them."""
    phrases = kept(phrases.select("phrase"), "phrases")
    grams = listed(df, toks, (n,), [key], places=True).filter(_maybe(F.col("term"), _bits(phrases.select(F.xxhash64("phrase").alias("h")))))
    grams = grams.withColumnRenamed("term", "phrase").join(phrases, "phrase", "left_semi")
    covered = grams.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(F.expr(f"sequence(p, p + {n - 1})")))).alias("covered"))
    rows = df.select(key, F.col(toks).alias("t")).join(covered, key, "left")
    rest = F.array_except(F.sequence(F.lit(0), F.size("t") - 1), F.col("covered"))
    out = F.when(F.col("covered").isNull() | (F.size("t") == 0), F.col("t")).otherwise(F.transform(rest, lambda i: F.get("t", i)))
    return rows.select(key, out.alias("residual"))


def vectors(df: DataFrame, terms: Column, train: Column, key: str = "id") -> DataFrame:
    """Unit vectors of all rows, one row per key, under weights that are fitted on the training rows.

    Rows are dealt by key before their terms are exploded, so that counts, norms and a later join by key need no other shuffle of terms. A training row's
    distinct terms are counted where it is read.
    """
    training = df.filter(train)
    weights = idf(training.select(key, F.explode(F.array_distinct(terms)).alias("term")), training)
    return unit_vectors(term_counts(df.select(key, terms.alias("_terms")).repartition(key), F.col("_terms"), key), weights, key)


def text_vectors(texts: DataFrame, copies: DataFrame, key: str = "text_id", tokens: str = "tokens") -> DataFrame:
    """(key, term, w): unit vectors of distinct texts, under weights of the training rows that have them; copies as in packed_vectors()."""
    counts = kept(word_counts(texts, tokens, (1,), key), "counts")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = counts.join(copies, key).groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))
    return unit_vectors(counts, known.select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), key)


#: Shards that terms are dealt to by hash to be numbered.
SHARDS = 64


def packed_vectors(texts: DataFrame, copies: DataFrame, key: str = "text_id", tokens: str = "tokens") -> DataFrame:
    """(key, slots, weights): each text's unit vector; slots number the terms that training rows know, from 0.

    texts: (key, tokens), one row per distinct text. copies: (key, n): how many training rows have a text; a text without any has weights all the same, for
    those of its terms that training rows know. Weights are tf * idf of idf() over training rows, so a text that many rows share is counted, split and
    weighed once. Texts without known terms have no rows.
    """
    # read for the weights of terms and for the vectors
    counts = kept(word_counts(texts, tokens, (1,), key), "counts")
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = counts.join(copies, key).groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))
    known = known.select("term", F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int").alias("shard"), (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    # terms are numbered by turns of the shards, which are of about one size
    known = known.withColumn("slot", (F.row_number().over(W.partitionBy("shard").orderBy("term")) - 1) * F.lit(SHARDS) + F.col("shard"))
    rows = counts.join(known, "term").select(key, "slot", (F.col("tf") * F.col("idf")).alias("x")).repartition(key).sortWithinPartitions(key, "slot")
    schema = T.StructType([rows.schema[key], T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(partial(_packed, names=schema.names), schema)


def _packed(batches, names):
    """A row per key, its numbers as lists scaled to length 1, from rows sorted by key; the last key of a batch waits for what follows."""
    held = None

    def out(rows):
        keys, x = rows.column(0), rows.column(2).to_numpy()
        seen = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        ends = np.append(first, len(x)).astype(np.int32)
        weights = x / np.repeat(np.sqrt(np.add.reduceat(x * x, first)), np.diff(ends))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(first)), pa.ListArray.from_arrays(ends, rows.column(1)), pa.ListArray.from_arrays(ends, pa.array(weights))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        begin = pc.index(batch.column(0), batch.column(0)[-1]).as_py() if batch.column(0)[-1].is_valid else batch.num_rows - batch.column(0).null_count
        if begin:
            yield out(batch.slice(0, begin))
        held = batch.slice(begin)
    if held is not None:
        yield out(held)
