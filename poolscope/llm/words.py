"""Whole columns of text to 64-bit word hashes, without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes depend on bytes alone, so they agree between processes and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one step turns into hashes; bounds the temporary arrays.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """n pseudorandom odd numbers, the same for the same seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95)) | U(1)


BYTES = odd(256, 11)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each text (one more entry than texts). inside: which bytes make up words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = inside[data]
    edge = np.empty(len(word), bool)
    edge[0] = word[0]
    np.greater(word[1:], word[:-1], out=edge[1:])
    inner = at[1:-1]
    inner = inner[inner < len(word)]
    edge[inner] = word[inner]
    starts = np.flatnonzero(edge)
    stop = np.empty(len(word), bool)
    stop[-1] = word[-1]
    np.greater(word[:-1], word[1:], out=stop[:-1])
    last = inner[inner > 0] - 1
    stop[last] = word[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z."""
    out = np.empty(len(starts), U)
    if not len(starts):
        return out
    table = BYTES[LOWER] if lower else BYTES
    lens = ends - starts
    cum = np.cumsum(lens)
    place = odd(min(int(lens.max()), STEP) + 1, 12)
    first = 0
    while first < len(starts):
        base = cum[first] - lens[first]
        stop = max(first + 1, int(np.searchsorted(cum, base + STEP, "right")))
        n = lens[first:stop]
        begin = np.cumsum(n) - n
        total = int(n.sum())
        inside = np.arange(total) - np.repeat(begin, n)
        if total > STEP:  # one word that is longer than a step
            long = data[starts[first] : ends[first]]
            h = U(0)
            for k in range(0, len(long), STEP):
                part = long[k : k + STEP]
                h = mix(np.array([h], U) * U(0x9E3779B97F4A7C15) + np.sum(table[part] * place[: len(part)], dtype=U))[0]
            out[first] = h
        else:
            b = data[np.repeat(starts[first:stop], n) + inside]
            out[first:stop] = np.add.reduceat(table[b] * place[inside], begin)
        first = stop
    return mix(out + lens.astype(U) * U(0x632BE59BD9B4E019))


def blocks(data: np.ndarray, at: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text stands alone."""
    out, a, n = [], 0, len(at) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1))
        out.append((a, b))
        a = b
    return out


def texts(column: pa.Array, lower: bool):
    """For each block of texts: the first text, the word hashes, and each text's first word (one more entry than texts)."""
    data, at = utf8(column)
    for a, b in blocks(data, at):
        part, where = data[at[a] : at[b]], at[a : b + 1] - at[a]
        starts, ends, first = bounds(part, where)
        yield a, b, hashes(part, starts, ends, lower), first


SHINGLE = odd(64, 13)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the text of each. A text of 1 to k-1 words has its whole sequence as one."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(words) >= k:
        n = len(words) - k + 1
        h = words[:n] * SHINGLE[0]
        for j in range(1, k):
            h += words[j : j + n] * SHINGLE[j]
        ok = doc[:n] == doc[k - 1 :]
        h, d = mix(h[ok]), doc[:n][ok]
    else:
        h, d = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        more = np.empty(len(short), U)
        for i, t in enumerate(short):
            w = words[first[t] : first[t + 1]]
            more[i] = np.sum(w * SHINGLE[32 : 32 + len(w)], dtype=U) + U(len(w))
        h, d = np.concatenate([h, mix(more)]), np.concatenate([d, short])
    return h, d


def distinct(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and where each of the n texts begins (one more entry)."""
    order = np.argsort(d, kind="stable") if len(d) and (np.diff(d) < 0).any() else slice(None)
    h, d = h[order], d[order]
    at = np.searchsorted(d, np.arange(n + 1))
    parts = []
    for i in range(n):
        x = np.sort(h[at[i] : at[i + 1]])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        parts.append(x)
    sizes = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
