"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment."""

from __future__ import annotations

from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

U = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
#: MinHash values that the smallest item of a partition has on average, and the chance of losing a document that holds just enough of an item.
SKETCH, MISSED = 12, 1e-6
#: Words of the items that one pass over the documents searches; also bounds what each task holds.
PASS_WORDS = 200_000


def partition_of(sizes: np.ndarray) -> np.ndarray:
    """Items of 2^p to 2^(p+1)-1 shingles make up partition p."""
    return np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def bound_of(p: np.ndarray) -> np.ndarray:
    """Hash values below the bound are a set's MinHash in partition p: SKETCH of 2^p shingles on average, all where there are no more.

    The bound is the same for items and documents, so the sketch of a document of any length holds the values that it shares with an item's, which a fixed
    number of minima of a long document would not.
    """
    share = np.minimum(1.0, SKETCH / 2.0**p)
    return np.where(share < 1, (share * 2.0**64).astype(np.float64), 2.0**64)


def least_found(size: int, need: int, kept: int, missed: float = MISSED) -> int:
    """How many of an item's `kept` MinHash values a document has that holds `need` of its `size` shingles, but for a chance of `missed`; 1 at least.

    Which shingles have the smallest hashes is chance, so the number found is hypergeometric. A document that holds more has more of them.
    """
    total, below = comb(size, kept), 0
    for k in range(max(0, kept - (size - need)), kept + 1):
        below += comb(need, k) * comb(size - need, kept - k)
        if below > missed * total:
            return max(1, k)
    return max(1, kept)


def lower(h: np.ndarray, bound: float) -> np.ndarray:
    """Which hashes lie below a bound of at most 2^64."""
    return np.ones(len(h), bool) if bound >= 2.0**64 else h < U(bound)


def below(h: np.ndarray, bound: float) -> np.ndarray:
    return h[lower(h, bound)]


class Part:
    """The items of one partition by size: the bound of their MinHash values, and the items by value."""

    def __init__(self, bound: float, sketches: list[np.ndarray], items: list[int]):
        self.bound = bound
        flat, item = np.concatenate(sketches), np.repeat(items, [len(s) for s in sketches])
        order = np.argsort(flat, kind="stable")
        self.hashes, start = np.unique(flat[order], return_index=True)
        self.start, self.item = np.append(start, len(flat)), item[order]

    def hits(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in self.hashes; -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def found(self, h: np.ndarray, doc: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item (one of `many`), and how many of the item's values are among the document's hashes."""
        place = self.hits(h)
        hit = place >= 0
        once = np.unique(doc[hit] * len(self.hashes) + place[hit])
        doc, place = once // len(self.hashes), once % len(self.hashes)
        n = self.start[place + 1] - self.start[place]
        which = np.repeat(self.start[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, count = np.unique(np.repeat(doc, n) * many + self.item[which], return_counts=True)
        return pair // many, pair % many, count


class Items:
    """Benchmark items: by partition of size their MinHash values, how many of them make a candidate, and their shingles as words."""

    def __init__(self, ids: list, texts: list[str | None], k: int, percent: int):
        self.k, self.percent = k, percent
        column = pa.array(texts, pa.string())
        own = []
        for a, b, h, first in W.texts(column, True):
            s, at = W.distinct(*W.shingles(h, first, k), b - a)
            own += [s[at[i] : at[i + 1]] for i in range(b - a)]
        full = [i for i, s in enumerate(own) if len(s)]
        self.ids = np.array([ids[i] for i in full], np.int64)
        self.sizes = np.array([len(own[i]) for i in full], np.int64)
        of = partition_of(self.sizes)
        sketches = [below(own[i], x) for i, x in zip(full, bound_of(of), strict=True)]
        self.least = np.array([least_found(n, -(-n * percent // 100), len(s)) for n, s in zip(self.sizes.tolist(), sketches, strict=True)], np.int64)
        self.sets = []
        for i in full:
            w = texts[i].encode().lower().split()
            self.sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))})
        # an item whose sketch is empty by chance is sought by its smallest value, among all of a document's
        empty = np.array([not len(s) for s in sketches], bool)
        sketches = [s if len(s) else own[i][:1] for s, i in zip(sketches, full, strict=True)]
        bounds = np.where(empty, 2.0**64, bound_of(of))
        self.parts = [Part(float(x), [sketches[i] for i in np.flatnonzero(bounds == x)], np.flatnonzero(bounds == x).tolist()) for x in np.unique(bounds)[::-1]]


def search(items: Items, column: pa.Array):
    """(text, item, shingles shared) of each text of a column that holds at least items.percent of an item's shingles.

    A document's shingles are reduced to its MinHash under the bound of each partition of the items, from the largest bound down, and sought in that
    partition's index alone: small items among many of the document's shingles, large ones among few. Items of which enough values are found for their size
    (least_found) are candidates, and candidates are verified on the words themselves.
    """
    for a, b, h, first in W.texts(column, True):
        s, d = W.shingles(h, first, items.k)
        found = []
        for part in items.parts:
            if part.bound < 2.0**64:
                keep = np.flatnonzero(lower(s, part.bound))
                s, d = s[keep], d[keep]
            found.append(part.found(s, d, max(1, len(items.ids))))
        if not found:
            continue
        x, item, count = (np.concatenate(c) for c in zip(*found, strict=True))
        ok = count >= items.least[item]
        by: dict[int, list[int]] = {}
        for i, j in zip(x[ok].tolist(), item[ok].tolist(), strict=True):
            by.setdefault(i, []).append(j)
        data = column.slice(a, b - a)
        for i, those in by.items():
            w = data[i].as_py().encode().lower().split()
            wanted = set().union(*(items.sets[j] for j in those))
            shared = {t for p in range(max(1, len(w) - items.k + 1)) if (t := tuple(w[p : p + items.k])) in wanted}
            for j in those:
                both = len(items.sets[j] & shared)
                if 100 * both >= items.percent * items.sizes[j]:
                    yield a + i, j, both


def _pairs(batches, items):
    items = items.value
    for batch in batches:
        found = list(search(items, batch.column(2)))
        x, item, both = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x)), batch.column(1).take(pa.array(x)), pa.array(items.ids[item]), pa.array(both), pa.array(items.sizes[item])], ["doc_id", "t", "item_id", "n_shared", "n_item"])


def _clean(batches, items):
    items = items.value
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for x, _, _ in search(items, batch.column(0)):
            keep[x] = False
        yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(keep))


def _parts(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> tuple[DataFrame, list[str]]:
    """The items with their partition p by size, and a condition for each pass: partitions next to each other, of about PASS_WORDS words together, or a share
    of a partition that has more. Of the partitions, some 40 at most, the driver knows their words."""
    n = F.regexp_count("text", F.lit(WORD))
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = rows.withColumn("words", F.coalesce(n, F.lit(0)).cast("long")).withColumn("p", F.floor(F.log2(F.greatest(F.col("words") - (k - 1), F.lit(1)))))
    passes, begin, total = [], 0, 0
    for p, words in sorted(map(tuple, rows.groupBy("p").agg(F.sum("words")).collect())):
        if total and total + words > PASS_WORDS:
            passes.append(f"p >= {begin} and p < {p}")
            begin, total = p, 0
        many = -(-words // PASS_WORDS)
        if many > 1:
            passes += [f"p = {p} and pmod(xxhash64(id), {many}) = {i}" for i in range(many)]
            begin = p + 1
        else:
            total += words
    return rows, [*passes, f"p >= {begin}"] if total or not passes else passes


def _part(rows: DataFrame, condition: str, k: int, percent: int):
    """The items of a pass, sent to the tasks once; their size is bounded by PASS_WORDS, but for an item that is longer by itself."""
    own = rows.filter(condition).select("id", "text").orderBy("id").collect()
    return rows.sparkSession.sparkContext.broadcast(Items([r[0] for r in own], [r[1] for r in own], k, percent))


def _found(docs: DataFrame, items: DataFrame, parts: list[str], k: int, percent: int, scratch: Scratch) -> DataFrame:
    """contaminated() over rows (doc_id, text, and t, a hash of the text); a pass ends, and its items go, before the next begins."""
    out, schema = None, "doc_id long, t long, item_id long, n_shared long, n_item long"
    for i, condition in enumerate(parts):
        sent = _part(items, condition, k, percent)
        part = docs.mapInArrow(partial(_pairs, items=sent), schema)
        if len(parts) > 1:
            part = scratch.keep(part, f"pass-{i}")
            sent.unpersist()
        out = part if out is None else out.union(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents that hold at least percent of an item's distinct lower-cased k-word shingles.

    Items are partitioned by size, and their MinHash values sought in the documents' (search()), in passes over partitions of bounded size; a pass is one scan
    of the documents, without a shuffle, whatever their skew. A document that holds just enough of an item is missed with a chance of MISSED.
    An item of fewer than k words has its whole sequence as one shingle, as a document has. Text null, empty or without words, in either table: no rows.
    item_id null: not searched. doc_id may be null or repeat: each row is searched. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    items, parts = _parts(benchmark, item_col, item_text_col, k)
    return _found(rows, items, parts, k, percent, Scratch(docs.sparkSession, "decontamination")).drop("t")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, that contaminated() would not name.

    Where the items fit in one pass, rows are dropped as they are read. Else each pass writes the ids and text hashes of what it finds, and the rows
    that have them leave by one join. doc_id may be null or repeat: a row goes by its own text.
    """
    items, parts = _parts(benchmark, item_col, item_text_col, k)
    if len(parts) == 1:
        own = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]  # whatever names they have, they are told apart
        clean = docs.select(docs[text_col].alias("text"), *own).mapInArrow(partial(_clean, items=_part(items, parts[0], k, percent)), docs.select(*own).schema)
        return clean.toDF(*docs.columns)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("t"), docs[text_col].alias("text"))
    gone = _found(rows, items, parts, k, percent, Scratch(docs.sparkSession, "decontamination")).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_t"]), "left_anti")
