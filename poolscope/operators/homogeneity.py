"""Mean similarity of a listing to its pool: the dot product with the pool's mean vector, never pairs."""

from __future__ import annotations

from dataclasses import replace
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.operators.pools import interval, pools, weighs
from poolscope.operators.pools import own as of_itself
from poolscope.plans.spec import DAY, SPEC, Spec
from poolscope.sources.sinks import kept


#: Parts that the work is cut into at least, unless listings stay too long for as many blocks; bytes of vectors that a task should hold; and bytes that a
#: listing's events take where they are dealt.
BLOCKS, HELD, EVENTS = 24, 1 << 28, 150


def _cuts(rows: DataFrame, vectors: DataFrame, keys: list[str], kinds: list[str], spec: Spec) -> tuple[int, int, int]:
    """Length of a block of time, shards of terms, and the last question's instant. They are that a task holds some HELD bytes of vectors: those of the texts
    in a block.

    Blocks are no shorter than listings stay in a pool on average, since a listing is carried into every block that it stays into; what is too much for
    such a block is cut by terms. A block gets each of its texts once, and a shard each listing of its block: of the cuts that are possible, the one that deals
    fewest bytes is taken, so that texts that many listings share are rather cut by terms, and others by time.
    """
    stays = [F.avg(F.greatest(F.lit(0), leave - enter)).alias(f"stay_{k}") for k in kinds for enter, leave in (interval(k, spec),)]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("u0").alias("low"), F.max("u0").alias("high"), *stays)
    found = groups.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.max(f"stay_{k}").alias(f"stay_{k}") for k in kinds)).first()
    texts = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("slots")), F.lit(0)).alias("terms")).first()
    if not found["n"] or not texts["n"]:
        return DAY, 1, 0
    span, stay = found["high"] - found["low"] + 1, max(1, ceil(max(found[f"stay_{k}"] or 0 for k in kinds)))
    each, most = 12 * texts["terms"] / texts["n"], max(1.0, span / stay)

    def cut(blocks: float) -> tuple[float, float, int]:
        carried = found["n"] * (1 + blocks / most)
        held = min(texts["n"], carried / blocks) * each
        shards = max(ceil(held / HELD), ceil(min(BLOCKS, most) / blocks))
        return blocks * held + shards * carried * EVENTS, blocks, shards

    _, blocks, shards = min(cut(min(most, BLOCKS * 2.0**k)) for k in range(-2, 9))
    return max(ceil(span / blocks), stay), shards, found["high"]


def _events(rows: DataFrame, keys: list[str], kinds: list[str], block: int, shards: int, high: int, spec: Spec) -> DataFrame:
    """What happens to each listing, by block and shard, with its instant: it moves in or out of a pool (role 0, a sign per kind), or asks (role 1).

    A listing is in the sums of every block that it stays into: from the block's beginning, where it came before. So a block needs no other's sums.
    """
    first = lambda at: ((at - F.pmod(at, F.lit(block))) / F.lit(block)).cast("long")
    none, many = F.lit(0).cast("byte"), F.array(*(F.lit(s) for s in range(shards)))
    found = [rows.select("*", first(F.col("u0")).alias("block"), F.col("u0").alias("at"), F.lit(1).cast("byte").alias("role"), *(none.alias(f"s_{k}") for k in kinds))]
    for k in kinds:
        enter, leave = interval(k, spec)
        live = rows.select("*", enter.alias("enter"), F.least(leave, F.lit(high + 1)).alias("leave")).filter("enter < leave")
        blocks = live.select("*", F.explode(F.sequence(first(F.col("enter")), first(F.col("leave") - 1))).alias("block"))
        begin = F.col("block") * F.lit(block)
        moves = [F.struct(F.greatest("enter", begin).alias("at"), F.lit(1).cast("byte").alias("sign")), F.struct(F.col("leave").alias("at"), F.lit(-1).cast("byte").alias("sign"))]
        inside = F.filter(F.array(*moves), lambda e: (e["sign"] == 1) | (e["at"] < begin + F.lit(block)))
        moved = blocks.select(*rows.columns, "block", F.explode(inside).alias("e"))
        found.append(moved.select(*rows.columns, "block", "e.at", none.alias("role"), *((F.col("e.sign") if x == k else none).alias(f"s_{x}") for x in kinds)))
    events = found[0]
    for more in found[1:]:
        events = events.union(more)
    return events.select("id", "text_id", *keys, "u0", "block", F.explode(many).alias("shard"), "at", "role", *(f"s_{k}" for k in kinds))


def _binary(x: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Numbers as byte strings of so many numbers each."""
    ends = np.concatenate([[0], np.cumsum(lens) * x.itemsize]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in byte strings, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    own = column.buffers()[2]
    return np.frombuffer(own.slice(int(ends[0]), int(ends[-1] - ends[0])) if own else b"", kind), np.diff(ends) // np.dtype(kind).itemsize


def _cut_up(batches, shards: int):
    for batch in batches:
        lens = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        slots, weights = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
        cell = np.repeat(np.arange(len(lens)), lens) * shards + slots % shards
        order = np.argsort(cell, kind="stable")
        cell, lens = np.unique(cell, return_counts=True)
        own = [batch.column(0).take(pa.array(cell // shards)), pa.array((cell % shards).astype(np.int32)), _binary((slots // shards)[order].astype(np.int32), lens), _binary(weights[order], lens)]
        yield pa.RecordBatch.from_arrays(own, ["text_id", "shard", "slots", "weights"])


def _pieces(vectors: DataFrame, shards: int) -> DataFrame:
    """(text_id, shard, slots, weights): vectors cut by terms, their numbers as bytes; slots of a shard are numbered from 0."""
    kind = vectors.schema["text_id"].dataType.simpleString()
    return vectors.select("text_id", "slots", "weights").mapInArrow(partial(_cut_up, shards=shards), f"text_id {kind}, shard int, slots binary, weights binary")


#: Terms that a step of a sweep takes at once, and half-lives that it may span; both keep running sums exact to 1e-12 or so.
STEP, SPAN = 1 << 18, 8
#: Terms of a run of moves, or of questions, from which on it is added up by itself.
LONG = 256


class _Sums:
    """Running sums of one group, block and shard, per kind and slot; those of kinds whose ages weigh are as of `ref`."""

    def __init__(self, kinds: list[str], half_life: float):
        self.kinds, self.half_life, self.ref = kinds, half_life, None
        self.sums = np.zeros((len(kinds), 0))

    def step(self, at, u0, role, signs, place, held) -> np.ndarray:
        """The dot product of each row with the sums at its place, by kind; rows are in order, and moves come before what asks at their instant."""
        if self.ref is None:
            self.ref = int(at[0])
        if held.top > self.sums.shape[1]:
            self.sums = np.zeros((len(self.kinds), held.top))
        fades = [weighs(k) for k in self.kinds]
        if any(fades):
            self.sums[fades] *= 2.0 ** ((self.ref - int(at[0])) / self.half_life)
            self.ref = int(at[0])
        lens = held.lens[place]
        total = int(lens.sum())
        own = np.repeat(held.begin[place] - (np.cumsum(lens) - lens), lens) + np.arange(total)
        runs = np.flatnonzero(np.diff(role, prepend=-1))
        way = self._by_run if total >= LONG * len(runs) else self._by_slot
        out = way(u0, role, signs, lens, held.slots[own], held.weights[own], fades, runs)
        for k, fade in enumerate(fades):
            if fade:
                out[k] *= np.exp2((self.ref - at) / self.half_life)
        return out

    def _sign(self, k: int, u0, signs, fades) -> np.ndarray:
        return signs[k] * np.exp2((u0 - self.ref) / self.half_life) if fades[k] else signs[k]

    def _by_run(self, u0, role, signs, lens, slots, weights, fades, runs) -> np.ndarray:
        """Runs of moves are added to the sums, and runs of questions look them up: where listings share instants."""
        out, place = np.zeros((len(self.kinds), len(role))), np.concatenate([[0], np.cumsum(lens)])
        sign = [self._sign(k, u0, signs, fades) for k in range(len(self.kinds))]
        for a, b in zip(runs, np.append(runs[1:], len(role)), strict=True):
            own, row = slice(place[a], place[b]), np.repeat(np.arange(b - a), lens[a:b])
            for k in range(len(self.kinds)):
                if role[a]:
                    out[k, a:b] = np.bincount(row, self.sums[k][slots[own]] * weights[own], minlength=b - a)
                elif (there := signs[k][a:b] != 0).any():
                    moved = (sign[k][a:b][row] * weights[own], slots[own])
                    if not there.all():
                        moved = tuple(x[there[row]] for x in moved)
                    np.add.at(self.sums[k], moved[1], moved[0])
        return out

    def _by_slot(self, u0, role, signs, lens, slots, weights, fades, runs) -> np.ndarray:
        """All rows at once, as running sums by slot: where instants are distinct."""
        row = np.repeat(np.arange(len(role)), lens)
        order = np.argsort(slots, kind="stable")
        slots, row, weights = slots[order], row[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        own = slots[first]
        size = np.diff(np.append(first, len(slots)))
        asks = role[row] == 1
        out = np.zeros((len(self.kinds), len(role)))
        for k in range(len(self.kinds)):
            run = np.cumsum(self._sign(k, u0, signs, fades)[row] * weights)
            before = np.concatenate([[0.0], run])[first]
            total = run[first + size - 1] - before
            held = run - np.repeat(before - self.sums[k][own], size)
            self.sums[k][own] += total
            out[k] = np.bincount(row[asks], held[asks] * weights[asks], minlength=len(role))
        return out


class _Held:
    """Vectors of a block's texts in a shard."""

    def __init__(self):
        self.parts, self.texts = [], None

    def add(self, batch: pa.RecordBatch) -> None:
        slots, lens = _numbers(batch["slots"], np.int32)
        self.parts.append((batch["text_id"], lens, slots, _numbers(batch["weights"], np.float64)[0]))

    def close(self) -> None:
        texts, lens, slots, weights = zip(*self.parts, strict=True) if self.parts else ((), (), (), ())
        self.parts, self.texts = [], pa.chunked_array(texts).combine_chunks() if texts else pa.array([])
        self.lens = np.concatenate([*lens, np.zeros(0, np.int64)]).astype(np.int64)
        del lens
        self.slots, self.weights = np.concatenate([*slots, np.zeros(0, np.int32)]), np.concatenate([*weights, np.zeros(0)])
        self.begin = np.cumsum(self.lens) - self.lens
        self.top, self.norms = int(self.slots.max(initial=-1)) + 1, np.add.reduceat(self.weights**2, self.begin) if len(self.begin) else np.zeros(0)
        self.order = None
        if pa.types.is_integer(self.texts.type) and not self.texts.null_count:
            numbers = self.texts.to_numpy()
            self.order = np.argsort(numbers)
            self.numbers = numbers[self.order]

    def places(self, texts: pa.Array) -> np.ndarray:
        """The place of each text, or -1 where it has no vector."""
        if self.texts is None:
            self.close()
        if not len(self.texts):
            return np.full(len(texts), -1)
        if self.order is None or texts.null_count:
            return pc.index_in(texts, value_set=self.texts).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = texts.to_numpy()
        at = np.minimum(np.searchsorted(self.numbers, own), len(self.numbers) - 1)
        return np.where(self.numbers[at] == own, self.order[at], -1)


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Where rows begin that differ from those before them, null being equal to null."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def _dots(batches, keys: int, kinds: list[str], half_life: float):
    """(id, norm, dot per kind) of each row that asks, from rows sorted by block, shard, group, instant and role; a part's vectors come first, without group and
    instant. A task holds one part's vectors, one group's sums, and a step's terms."""
    now, sums, held = None, None, None
    for batch in batches:
        columns = [batch.column(i) for i in range(keys + 2)]
        new = _runs(columns)
        for begin, end in zip(new, np.append(new[1:], batch.num_rows), strict=True):
            begin, end = int(begin), int(end)
            group = tuple(c[begin].as_py() for c in columns)
            if now is None or group[:2] != now[:2]:
                held = _Held()
            if group != now:
                now, sums = group, _Sums(kinds, half_life)
            part = batch.slice(begin, end - begin)
            vectors = part["at"].null_count
            if vectors:
                held.add(part.slice(0, vectors))
            part = part.slice(vectors)
            if not part.num_rows:
                continue
            place = held.places(part["text_id"])
            part, place = part.filter(pa.array(place >= 0)), place[place >= 0]
            at, u0, role = (part[c].to_numpy(zero_copy_only=False) for c in ("at", "u0", "role"))
            role, signs = role.astype(np.int8), [part[f"s_{k}"].to_numpy(zero_copy_only=False).astype(float) for k in kinds]
            offsets = np.concatenate([[0], np.cumsum(held.lens[place])])
            a = 0
            while a < len(at):
                b = min(int(np.searchsorted(offsets, offsets[a] + STEP, side="right")) - 1, int(np.searchsorted(at, at[a] + SPAN * half_life, side="right")))
                b = max(a + 1, b)
                dots = sums.step(at[a:b], u0[a:b], role[a:b], [s[a:b] for s in signs], place[a:b], held)
                ask = np.flatnonzero(role[a:b] == 1)
                if len(ask):
                    yield pa.RecordBatch.from_arrays([part["id"].slice(a, b - a).take(pa.array(ask)), pa.array(held.norms[place[a:b][ask]]), *(pa.array(d[ask]) for d in dots)], ["id", "norm", *(f"dot_{k}" for k in kinds)])
                a = b


def similarities(loans: DataFrame, vectors: DataFrame, kinds: list[str], keys: list[str] | None = None, spec: Spec = SPEC, sizes: DataFrame | None = None) -> DataFrame:
    """id, and for each kind n_<kind>, h_<kind>, and where ages weigh v_<kind>: mean cosine of each listing to each of its pools; null where a pool is empty.

    vectors: packed_vectors() by text_id, which loans has too; both are written once to the folder that all executors share. Listings move in and out of all
    pools and ask, in order of time, in one task per block of time and shard of terms, which keeps running sums per group and term (_Sums). A task has a text's
    vector once, however many listings and groups of its part share it; listings themselves are shuffled without their terms. Own weight times sum, less the listing itself,
    over the pool's size is the mean of all cosines. sizes: pools() of these kinds without logs, where it is there already.
    """
    keys = ["sector"] if keys is None else keys
    rows = loans.select("id", "text_id", *keys, "u0", "u1").filter(" and ".join(f"{c} is not null" for c in ("u0", *keys)))
    if not keys:
        rows, keys = rows.withColumn("everyone", F.lit(0)), ["everyone"]
        grouped = []
    else:
        grouped = keys
    # read for the parts, the moves, the pools and the result
    rows, vectors = kept(rows, "listings"), kept(vectors, "vectors")
    block, shards, high = _cuts(rows, vectors, keys, kinds, spec)
    part = ["block", "shard"]
    events = _events(rows, keys, kinds, block, shards, high, spec)
    there = _events(rows, keys, kinds, block, 1, high, spec).select("text_id", "block").distinct()
    needed = there.join(_pieces(vectors, shards), "text_id")
    blank = lambda names, of: [F.lit(None).cast(of.schema[c].dataType).alias(c) for c in names]
    own = [*keys, "id", "at", "u0", "role", *(f"s_{k}" for k in kinds)]
    # empty bytes and not null: the writer of Arrow batches steps through all nulls before a row to tell a batch's size
    empty = [F.lit(b"").alias(c) for c in ("slots", "weights")]
    grouping = [*part, *keys]
    both = needed.select(*part, *blank(keys, events), "text_id", *blank(own[len(keys) :], events), "slots", "weights").union(events.select(*grouping, "text_id", *own[len(keys) :], *empty))
    both = both.repartition(*part).sortWithinPartitions(*grouping, "at", "role")
    schema = f"id {loans.schema['id'].dataType.simpleString()}, norm double, " + ", ".join(f"dot_{k} double" for k in kinds)
    found = both.mapInArrow(partial(_dots, keys=len(keys), kinds=kinds, half_life=spec.half_life_days * DAY), schema)
    if shards > 1:
        found = found.groupBy("id").agg(F.sum("norm").alias("norm"), *(F.sum(f"dot_{k}").alias(f"dot_{k}") for k in kinds))
    dots = rows.join(found, "id").select("id", *((F.col(f"dot_{k}") - of_itself(k, spec) * F.col("norm")).alias(f"dot_{k}") for k in kinds))
    out = (pools(rows, kinds, grouped, replace(spec, log_volume=False)) if sizes is None else sizes).join(dots, "id", "left")
    columns = []
    for k in kinds:
        size = F.col(f"v_{k}") if weighs(k) else F.col(f"n_{k}").cast("double")
        h = F.when(F.col(f"n_{k}") > 0, F.coalesce(f"dot_{k}", F.lit(0.0)) / size)
        columns += [F.col(f"n_{k}"), h.alias(f"h_{k}")]
        if weighs(k):
            columns.append((F.log1p(f"v_{k}") if spec.log_volume else F.col(f"v_{k}")).alias(f"v_{k}"))
    return out.select("id", *columns)


def homogeneity(loans: DataFrame, vectors: DataFrame, kind: str = "current", keys: list[str] | None = None, spec: Spec = SPEC) -> DataFrame:
    """id, n, h (and v where ages weigh): similarities() of one kind."""
    out = similarities(loans, vectors, [kind], keys, spec)
    return out.select("id", F.col(f"n_{kind}").alias("n"), *([F.col(f"v_{kind}").alias("v")] if weighs(kind) else []), F.col(f"h_{kind}").alias("h"))


def pairwise(loans: DataFrame, vectors: DataFrame, focal: DataFrame, kind: str = "current", keys: list[str] | None = None, spec: Spec = SPEC) -> DataFrame:
    """The same by pairs, for the focal ids alone: an audit."""
    keys = ["sector"] if keys is None else keys
    enter, leave = interval(kind, spec)
    age = F.pow(F.lit(2.0), (F.col("their_u0") - F.col("u0")) / F.lit(spec.half_life_days * DAY)) if weighs(kind) else F.lit(1.0)
    pool = loans.select(F.col("id").alias("other"), *keys, enter.alias("enter"), leave.alias("leave"), F.col("u0").alias("their_u0"))
    asked = loans.join(focal.select("id"), "id", "left_semi").select("id", *keys, "u0")
    pairs = asked.join(pool, keys).filter("enter <= u0 and u0 < leave" + (" and id <> other" if spec.exclude_self else "")).select("id", "other", age.alias("g"))
    theirs = vectors.select(F.col("id").alias("other"), "term", F.col("w").alias("w2"))
    sizes = pairs.groupBy("id").agg(F.count("*").alias("n"), F.sum("g").alias("v"))
    dots = pairs.join(vectors, "id").join(theirs, ["other", "term"]).groupBy("id").agg(F.sum(F.col("w") * F.col("w2") * F.col("g")).alias("dot"))
    return sizes.join(dots, "id", "left").select("id", "n", (F.coalesce("dot", F.lit(0.0)) / F.col("v")).alias("h"))


def pairwise_texts(loans: DataFrame, vectors: DataFrame, focal: DataFrame, kind: str = "current", keys: list[str] | None = None, spec: Spec = SPEC) -> DataFrame:
    """pairwise() over (text_id, term, w), a text's vector once for all listings that share it. Focal listings are few: their own vectors are sent to all tasks."""
    keys = ["sector"] if keys is None else keys
    enter, leave = interval(kind, spec)
    age = F.pow(F.lit(2.0), (F.col("their_u0") - F.col("u0")) / F.lit(spec.half_life_days * DAY)) if weighs(kind) else F.lit(1.0)
    pool = loans.select(F.col("id").alias("other"), F.col("text_id").alias("theirs"), *keys, enter.alias("enter"), leave.alias("leave"), F.col("u0").alias("their_u0"))
    asked = loans.join(F.broadcast(focal.select("id")), "id", "left_semi").select("id", "text_id", *keys, "u0")
    pairs = pool.join(F.broadcast(asked.drop("text_id")), keys).filter("enter <= u0 and u0 < leave" + (" and id <> other" if spec.exclude_self else ""))
    shared = pairs.select("id", "theirs", age.alias("g")).groupBy("id", "theirs").agg(F.count("*").alias("n"), F.sum("g").alias("g"))
    sizes = shared.groupBy("id").agg(F.sum("n").alias("n"), F.sum("g").alias("v"))
    own = asked.select("id", "text_id").join(vectors, "text_id").select("id", "term", "w")
    dots = shared.join(vectors.select(F.col("text_id").alias("theirs"), "term", F.col("w").alias("w2")), "theirs").join(F.broadcast(own), ["id", "term"])
    dots = dots.groupBy("id").agg(F.sum(F.col("w") * F.col("w2") * F.col("g")).alias("dot"))
    return sizes.join(dots, "id", "left").select("id", "n", (F.coalesce("dot", F.lit(0.0)) / F.col("v")).alias("h"))


def audit(swept: DataFrame, paired: DataFrame) -> DataFrame:
    """checks, max_error: the largest difference between the two ways."""
    both = paired.select("id", F.col("h").alias("h2")).join(swept.select("id", "h"), "id")
    return both.agg(F.count("*").alias("checks"), F.max(F.abs(F.col("h") - F.col("h2"))).alias("max_error"))


def dense_mean_cosine(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """key, n, h: mean cosine of each dense vector to the others of its group, by the group's sum vector. Zero vectors have similarity 0."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    unit = rows.select(key, group, x.alias("x"), norm.alias("norm")).select(key, group, F.transform("x", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(0.0)).alias("u"))
    sums = unit.select(group, F.posexplode("u").alias("i", "v")).groupBy(group, "i").agg(F.sum("v").alias("s"))
    sums = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s"))
    sizes = unit.groupBy(group).agg(F.count("*").alias("n"))
    both = unit.join(sums.join(sizes, group), group)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    h = (dot("u", "s") - dot("u", "u")) / F.nullif(F.col("n") - 1, F.lit(0))
    return both.select(key, (F.col("n") - 1).alias("n"), h.alias("h"))
