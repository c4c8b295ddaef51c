"""Repeated passages across documents: winnowed anchors as seeds, extension over their windows, removal of what repeats."""

from __future__ import annotations

from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

U = np.uint64
#: Words of a repeat that counts, and words of an anchor.
LENGTH, ANCHOR = 35, 10
Q = int(W.odd(1, 31)[0])
Q_BACK = pow(Q, -1, 1 << 64)


class Runs:
    """Hashes of any run of words of a block, each in constant time."""

    def __init__(self, h: np.ndarray):
        powers = lambda q: np.cumprod(np.concatenate([np.ones(1, U), np.full(len(h), q, U)]), dtype=U)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(h * powers(Q)[:-1], dtype=U)])
        self.back = powers(Q_BACK)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix((self.sums[b] - self.sums[a]) * self.back[a])


def _argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of g[s:s+width] is, for each s; the last of equal ones."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at, have = np.where(g[b] <= g[a], b, a), have + step
    return at


def anchors(h: np.ndarray, first: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """Each anchor of a block of texts: text, first window, windows, hash of its k words, hash of all words its windows cover.

    A window of `length` words selects the smallest hash of its k-word runs, the last of equal ones: a choice that depends on the window's words alone,
    so equal windows select equal anchors. Every window belongs to one anchor, and an anchor's windows follow one another.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U)
    run = Runs(h)
    starts = np.arange(len(h) - k + 1)
    g = run(starts, starts + k)
    chosen = _argmin(g, length - k + 1)[:n]
    s = np.flatnonzero(doc[:n] == doc[length - 1 :])
    chosen = chosen[s]
    new = np.concatenate([[True], chosen[1:] != chosen[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    low, count = s[at], np.diff(np.append(at, len(s)))
    context = W.mix(run(low, low + count + length - 1) + count.astype(U))
    return doc[low], low - first[doc[low]], count, g[chosen[at]], context


def _anchors(batches, length: int, k: int):
    for batch in batches:
        for a, _, h, first in W.texts(batch.column(2), False):
            d, low, count, anchor, context = anchors(h, first, length, k)
            take = pa.array(d + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(low.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(W.signed(anchor)), pa.array(W.signed(context))], ["doc_id", "t", "low", "n", "anchor", "context"])


def _windows(batches, length: int):
    """The hash of each window of the given ones; column 3 lists (low, n, anchor, copies) for each text."""
    for batch in batches:
        for a, b, h, first in W.texts(batch.column(2), False):
            asked = batch.column(3).slice(a, b - a)
            doc = np.repeat(np.arange(b - a), np.diff(np.asarray(asked.offsets)))
            low, n, anchor, copies = (np.asarray(x) for x in asked.flatten().flatten())
            row = np.repeat(np.arange(len(low)), n)
            s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
            where = s + first[doc[row]]
            w = Runs(h)(where, where + length)
            take = pa.array(doc[row] + a)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(W.signed(w)), pa.array(copies[row]), batch.column(0).take(take), batch.column(1).take(take), pa.array(s.astype(np.int32))], ["anchor", "w", "copies", "doc_id", "t", "low"])


def _removed(batches):
    """Texts without the words that a span covers; column 2 lists spans as first * 2^31 + words."""
    for batch in batches:
        data, at = W.utf8(batch.column(1))
        for a, b in W.blocks(data, at):
            out, words, gone = [], [], []
            spans = batch.column(2).slice(a, b - a)
            for i in range(b - a):
                text = data[at[a + i] : at[a + i + 1]].tobytes().split()
                n, drop = len(text), 0
                if spans[i].is_valid:
                    x = np.asarray(spans[i].values)
                    first, count = x >> 31, x & (2**31 - 1)
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + count, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    text = list(compress(text, keep.tolist()))
                    drop = n - len(text)
                out.append(b" ".join(text))
                words.append(n)
                gone.append(drop)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (the kept words, joined by one space).

    A word goes if some run of `length` words around it also starts anywhere else, in the same document too; runs are judged on the input.

    1. Every run selects a winnowed anchor of `anchor` words in it; about 7 anchors per 100 words. Anchors that occur once seed nothing.
    2. An anchor is extended over all words of the runs that select it. Where all occurrences of an anchor extend alike, or one extension occurs
       twice, those runs repeat, whatever the number of copies.
    3. Each extension that differs from others of its anchor is kept once, with its count, and compared run by run; runs that occur twice repeat.
       So the work grows with the occurrences of an anchor, never with their pairs.
    4. Overlapping runs join into maximal repeats, which leave the text.

    Text null, empty or below `length` words: nothing goes. Rows that repeat are documents of their own, so they lose all runs. doc_id may be null or repeat.
    An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    found = scratch.keep(docs.mapInArrow(partial(_anchors, length=length, k=anchor), "doc_id long, t long, low int, n int, anchor long, context long"), "anchors")
    shared = found.groupBy("anchor").agg(F.count("*").alias("many"), F.min("context").alias("x"), F.max("context").alias("y")).filter("many > 1")
    shared = scratch.keep(shared.select("anchor", (F.col("x") == F.col("y")).alias("alike")), "shared")
    seeds = scratch.keep(found.join(shared, "anchor"), "seeds")
    scratch.drop("anchors", "shared")
    unlike = seeds.filter("not alike")
    one = F.struct("doc_id", "t", "low", "n")
    contexts = scratch.keep(unlike.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(one).alias("one")), "contexts")
    twice = contexts.filter("copies > 1").select("anchor", "context")
    asked = contexts.select("one.*", "anchor", "copies").groupBy("doc_id", "t").agg(F.collect_list(F.struct("low", "n", "anchor", "copies")).alias("asked"))
    same = F.expr("d.t = x.t and d.doc_id <=> x.doc_id")
    texts = docs.alias("d").join(asked.alias("x"), same).select("d.doc_id", "d.t", "d.text", "x.asked")
    windows = scratch.keep(texts.mapInArrow(partial(_windows, length=length), "anchor long, w long, copies long, doc_id long, t long, low int"), "windows")
    repeated = scratch.keep(windows.groupBy("anchor", "w").agg(F.sum("copies").alias("c"), F.min("copies").alias("least")).filter("c > 1 and least = 1").select("anchor", "w"), "repeated")
    single = windows.filter("copies = 1").join(repeated, ["anchor", "w"]).select("doc_id", "t", "low", F.lit(1).alias("n"))
    whole = seeds.filter("alike").union(unlike.join(twice, ["anchor", "context"]).select(seeds.columns)).select("doc_id", "t", "low", "n")
    span = F.shiftleft(F.col("low").cast("long"), 31) + F.col("n") + (length - 1)
    spans = scratch.keep(whole.union(single).groupBy("doc_id", "t").agg(F.collect_set(span).alias("spans")), "spans")
    scratch.drop("seeds", "contexts", "windows", "repeated")
    out = docs.alias("d").join(spans.alias("x"), same, "left").select("d.doc_id", "d.text", "x.spans")
    return out.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, text string")
