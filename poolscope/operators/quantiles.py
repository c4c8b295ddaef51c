"""Exact quantiles of many columns at once, by selection: histograms of ever finer parts, then the few values left."""

from __future__ import annotations

from functools import partial
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a number that one pass tells apart, and values of a part that are few enough to be looked at one by one.
BITS, FEW = 12, 1000
COUNTS = "target int, part long, n long"


def _ordered(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(2**63))).view(np.uint64)


def _double(code: int) -> float:
    code = np.array([code], np.uint64)
    bits = np.where(code >> np.uint64(63) == 1, code & np.uint64(2**63 - 1), ~code)
    return float(bits.view(np.float64)[0])


def _counted(batches, columns: list[str], targets: list[tuple[int, int]], shift: int, bits: int):
    """How many values with each target's prefix (column, all bits above shift + bits) have each of the next bits; counted in a task before they are sent."""
    totals = [np.zeros(1 << bits, np.int64) for _ in targets]
    for batch in batches:
        for c in {c for c, _ in targets}:
            x = _ordered(batch[columns[c]].drop_null().to_numpy(zero_copy_only=False))
            for t, (of, prefix) in enumerate(targets):
                if of == c:
                    own = x if shift + bits >= 64 else x[x >> np.uint64(shift + bits) == np.uint64(prefix)]
                    totals[t] += np.bincount((own >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    for t, n in enumerate(totals):
        part = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array(part), pa.array(n[part])], ["target", "part", "n"])


def _left(batches, columns: list[str], targets: list[tuple[int, int]], shift: int):
    """The values with a target's prefix, and how often each occurs in a batch."""
    for batch in batches:
        for t, (c, prefix) in enumerate(targets):
            x = _ordered(batch[columns[c]].drop_null().to_numpy(zero_copy_only=False))
            value, n = np.unique(x[x >> np.uint64(shift) == np.uint64(prefix)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), t, np.int32)), pa.array(value.view(np.int64)), pa.array(n)], ["target", "part", "n"])


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """For each column its interpolated quantiles; None where a column has no value. Nulls and NaN are left out, ties count.

    A quantile lies between two ranks. Each pass over the rows counts, for the part that holds a rank, how many values each of 4,096 smaller parts has, so
    that a part of FEW values or of one value is left after at most six passes, whatever the distribution; its values are then looked at. Tasks send counts,
    never values but the last few: no task and no driver holds a column's distinct values. All columns share the passes.
    """
    columns = list(wanted)
    rows = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    n = rows.agg(*(F.count(c).alias(c) for c in columns)).first()
    ranks = {(c, r) for i, c in enumerate(columns) if n[c] for p in wanted[c] for r in (floor((n[c] - 1) * p), ceil((n[c] - 1) * p))}
    # where each rank is: the prefix of its part, and its rank there
    place = {(c, r): (columns.index(c), 0, r) for c, r in ranks}
    value: dict[tuple[str, int], float] = {}
    shift, many = 64, dict.fromkeys(place, FEW + 1)
    while place:
        if shift == 0 or shift < 64 and max(many[k] for k in place) <= FEW:
            targets = sorted({(c, prefix) for c, prefix, _ in place.values()})
            found: dict[int, list] = {}
            if shift:
                counts = rows.mapInArrow(partial(_left, columns=columns, targets=targets, shift=shift), COUNTS).groupBy("target", "part").agg(F.sum("n").alias("n"))
                for t, part, k in counts.collect():
                    found.setdefault(t, []).append((part % 2**64, k))
            for key, (c, prefix, r) in place.items():
                if not shift:
                    value[key] = _double(prefix)
                    continue
                for code, k in sorted(found[targets.index((c, prefix))]):
                    if r < k:
                        value[key] = _double(code)
                        break
                    r -= k
            break
        bits = min(BITS, shift)
        shift -= bits
        targets = sorted({(c, prefix) for c, prefix, _ in place.values()})
        counts = rows.mapInArrow(partial(_counted, columns=columns, targets=targets, shift=shift, bits=bits), COUNTS).groupBy("target", "part").agg(F.sum("n").alias("n"))
        found = {}
        for t, part, k in counts.collect():
            found.setdefault(t, []).append((part, k))
        for key, (c, prefix, r) in place.items():
            for part, k in sorted(found[targets.index((c, prefix))]):
                if r < k:
                    place[key], many[key] = (c, prefix << bits | part, r), k
                    break
                r -= k
    out: dict[str, list[float | None]] = {}
    for c in columns:
        own = []
        for p in wanted[c]:
            if not n[c]:
                own.append(None)
                continue
            at = (n[c] - 1) * p
            low, high = value[c, floor(at)], value[c, ceil(at)]
            own.append(low if low == high else (ceil(at) - at) * low + (at - floor(at)) * high)
        out[c] = own
    return out
