"""Counts of n-grams per document: Spark deals the texts by key and sorts them, tasks count over Arrow batches."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task counts at a time, and rows of a batch that it returns; a single text may be longer.
PIECE, ROWS = 8 << 20, 1 << 16


def word_grams(lists: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, pa.Array]:
    """(place of the list, n-gram) of all runs of so many words, joined by a space."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
    left = np.cumsum(n)[row] - np.arange(len(row))
    rows, terms = [], []
    for k in sizes:
        at = np.flatnonzero(left >= k)
        rows.append(row[at])
        terms.append(words if k == 1 else pc.binary_join_element_wise(*(words.take(pa.array(at + j)) for j in range(k)), " ", null_handling="skip"))
    return np.concatenate(rows), pa.concat_arrays(terms)


def char_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """(place of the text, code) of all runs of n code points, 1 to 3; a code holds 21 bits for each."""
    many = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(texts.drop_null().to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(many)), many)
    at = np.flatnonzero(np.cumsum(many)[row] - np.arange(len(row)) >= n)
    code = np.zeros(len(at), np.int64)
    for k in range(n):
        code = (code << 21) | points[at + k]
    return row[at], pa.array(code)


def char_labels(codes: pa.Array, n: int) -> pa.Array:
    """The n characters of each code."""
    codes = codes.to_numpy()
    points = np.stack([(codes >> (21 * (n - 1 - k))) & 0x1FFFFF for k in range(n)], axis=1)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width.sum(axis=1))]).astype(np.int32)
    own = points.astype(np.uint32).tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(own))


def buckets(terms: pa.Array, many: int) -> pa.Array:
    """hashed() of each term; each distinct one is hashed once."""
    known = terms.dictionary_encode()
    words = pa.concat_arrays([known.dictionary])
    ends, own = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].tolist() if len(words) else [0], (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    sums = b"".join([hashlib.md5(own[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return pa.array((np.frombuffer(sums, ">u4")[::4] % many).astype(np.int32)).take(known.indices)


def _summed(rows: pa.Array, terms: pa.Array, n: pa.Array) -> pa.Table:
    return pa.table({"row": rows, "term": terms, "n": n}).group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).select(["row", "term", "n_sum"]).combine_chunks()


def _pieces(column: pa.Array):
    """(from, to) of stretches of some PIECE bytes."""
    if pa.types.is_list(column.type):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column.flatten()), 0).to_numpy(zero_copy_only=False) + 8)])
        size = np.diff(size[np.concatenate([[0], np.cumsum(n)])])
    else:
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _listed(batches, sizes, places, names):
    for batch in batches:
        for a, b in _pieces(batch.columns[-1]):
            part = batch.slice(a, b - a)
            row, terms = word_grams(part.columns[-1], sizes)
            if places:
                at = np.arange(len(row))
                own = [pa.array((at - np.maximum.accumulate(np.where(np.diff(row, prepend=-1) != 0, at, 0))).astype(np.int32)), terms]
            else:
                found = pa.table({"row": row, "term": terms}).group_by(["row", "term"], use_threads=False).aggregate([]).combine_chunks()
                row, own = found["row"].to_numpy(), [pa.concat_arrays(found["term"].chunks) if found.num_rows else terms.slice(0, 0)]
            for c in range(0, len(row), ROWS):
                keep = pa.array(row[c : c + ROWS])
                yield pa.RecordBatch.from_arrays([*(x.take(keep) for x in part.columns[:-1]), *(x.slice(c, ROWS) for x in own)], names)


def listed(df: DataFrame, toks: str, sizes: tuple[int, ...], keep: list[str], places: bool = False) -> DataFrame:
    """(keep, term): each distinct run of so many tokens of each row, found where the row lies; or with places, (keep, p, term) for each run of one size,
    from 0."""
    rows = df.select(*keep, F.col(toks).alias("_text"))
    more = [T.StructField("p", T.IntegerType())] if places else []
    schema = T.StructType([*(rows.schema[k] for k in keep), *more, T.StructField("term", T.StringType())])
    return rows.mapInArrow(partial(_listed, sizes=sizes, places=places, names=schema.names), schema)


def _counted(batches, grams, label, names, finish):
    """Rows of a key lie one after the other, in any number of batches: the counts of the last key wait for what follows."""
    held, kept = None, None  # the last key, as an array of one, and its (row, term, n)

    def out(keys, table):
        for a in range(0, table.num_rows, ROWS):
            part = table.slice(a, ROWS).combine_chunks()
            terms = part["term"].combine_chunks() if isinstance(part["term"], pa.ChunkedArray) else part["term"]
            own = keys.take(part["row"].combine_chunks())
            yield pa.RecordBatch.from_arrays([own, finish(terms), part["n_sum"].combine_chunks().cast(pa.int64())], names)

    for batch in batches:
        for a, b in _pieces(batch.column(1)):
            keys, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
            if not len(keys):
                continue
            # runs of equal keys, null equal to null
            seen = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.concatenate([[True], seen[1:] != seen[:-1]])
            run, own = np.cumsum(first) - 1, keys.take(pa.array(np.flatnonzero(first)))
            row, terms = grams(texts)
            terms = label(terms)
            table = _summed(pa.array(run[row]), terms, pa.array(np.ones(len(row), np.int64)))
            if held is not None and held[0].as_py() == own[0].as_py():
                both = pa.concat_tables([kept, table])
                table = _summed(both["row"], both["term"], both["n_sum"])
            elif held is not None:
                yield from out(held, kept)
            last = len(own) - 1
            yield from out(own, table.filter(pc.less(table["row"], last)))
            held, kept = own.slice(last), table.filter(pc.equal(table["row"], last))
            kept = kept.set_column(0, "row", pa.array(np.zeros(kept.num_rows, np.int64)))
    if held is not None:
        yield from out(held, kept)


def _same(x):
    return x


def _counts(df: DataFrame, column, key: str, grams, kind: T.DataType, label=_same, finish=_same, name: str = "term") -> DataFrame:
    rows = df.select(key, column.alias("_text")).repartition(key).sortWithinPartitions(key)
    schema = T.StructType([rows.schema[key], T.StructField(name, kind), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(partial(_counted, grams=grams, label=label, finish=finish, names=schema.names), schema)


def word_counts(df: DataFrame, toks: str, sizes: tuple[int, ...], key: str = "id") -> DataFrame:
    """(key, term, tf): how often each run of so many tokens is in the texts of a key. Only texts are shuffled, no terms."""
    return _counts(df, F.col(toks), key, partial(word_grams, sizes=sizes), T.StringType())


def bucket_counts(df: DataFrame, toks: str, sizes: tuple[int, ...], many: int, key: str = "id") -> DataFrame:
    """(key, bucket, tf): the same by hashed() buckets of terms, summed where they are counted."""
    return _counts(df, F.col(toks), key, partial(word_grams, sizes=sizes), T.IntegerType(), label=partial(buckets, many=many), name="bucket")


def char_counts(df: DataFrame, text: str, n: int, key: str = "id") -> DataFrame:
    """(key, term, tf): how often each run of n characters, 1 to 3, is in the texts of a key."""
    return _counts(df, F.col(text), key, partial(char_grams, n=n), T.StringType(), finish=partial(char_labels, n=n))
